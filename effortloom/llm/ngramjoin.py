"""N-gram Jaccard join by T-occurrence search.

Texts are sets of word shingles. Two sets link when their Jaccard likeness reaches p/q; then a set of n shingles shares
T = ceil(p n / q) of them or more with every partner. Shingles have one order, that of their hashes, so two sets that
share T share the first few shingles of that common part within the first n - T + few of either: each set is listed under
these only (`head`), and a partner occurs `few` times or more on the lists of a set's head. That is the T-occurrence
problem, solved per set by DivideSkip: short lists are merged by a heap that skips what cannot reach the threshold, long
lists are left out of the merge and probed by binary search.

Lists that are long for the whole corpus, above ``crowded`` entries, are not sent around at all. A set with c of them in
its head has to be met few - c times on the others; every candidate is then settled by binary probes of the whole sets.
Sets with too many crowded lists go on:

1. They are first compared with one well-connected set of every crowded list, and what links becomes one group. Lists of
   one group are dead, as only links between groups are still of use: a group of thousands of near copies mostly ends
   here.
2. Sets whose head is still mostly crowded are searched again with their whole sets as heads.
3. Sets with over p/q of all their shingles crowded and groups apart are compared in blocks: each task counts the common
   shingles of two blocks of bounded size by a matrix product and returns the links that join groups.

Equal sets are one node, so copies are one row. Links inside a group are not all returned, links that join groups all are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.llm.common import pin_python
from effortloom.llm.components import connected_components
from effortloom.session import pin

#: Lists with more sets than this are crowded.
CROWDED = 32
#: Sets and shingles that a block of the last step holds at most (one set alone may be longer).
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
#: A head holds one more shingle for each so many of the set, so that partners meet several times.
EXTRA = 20


def shingle_set(text: str | None, shingle: int = 3) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles of a text: words between blanks, A-Z lower-cased; a shorter text is one
    shingle, a text without words has none."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly the six blanks
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], stops[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops[width - 1 :].tolist(), strict=True)], dtype=np.uint64))


def divide_skip(lists: list[list[int]], need: int, mu: float = 0.5) -> dict[int, int]:
    """Numbers that occur on ``need`` of the sorted ``lists`` or more, and how often.

    The longest lists are set aside, as many as pay off at ``need`` over the logarithm of their length. On the others a
    heap holds the front of every list: if the smallest front does not come up often enough, need - 1 fronts are taken
    off and all skip forward to the next front by binary search. What comes up is looked for in the long lists.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < need:
        return {}
    aside = min(need - 1, int(need / (mu * np.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = need - aside
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while len(heap) >= least:
        front, taken = heap[0][0], []
        while heap and heap[0][0] == front:
            taken.append(heapq.heappop(heap))
        if len(taken) >= least:
            count = len(taken)
            for at, x in enumerate(long):
                if count + len(long) - at < need:
                    break
                spot = bisect_left(x, front)
                count += spot < len(x) and x[spot] == front
            if count >= need:
                found[front] = count
            target = front + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, k, at in taken:
            spot = at + 1 if short[k][at] == front and target == front + 1 else bisect_left(short[k], target, at)
            if spot < len(short[k]):
                heapq.heappush(heap, (short[k][spot], k, spot))
    return found


class Likeness:
    """The threshold p/q in whole numbers, as plain and as column arithmetic."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def overlap(self, n: int) -> int:
        """Shingles that a set of ``n`` shares with any partner; also the least size of a partner."""
        return -(-self.part * n // self.whole)

    def overlap_col(self, n: Column) -> Column:
        return F.floor((self.part * n + self.whole - 1) / self.whole).cast("long")

    def sizes_fit(self, a: str, b: str) -> Column:
        return self.whole * F.least(a, b) >= self.part * F.greatest(a, b)

    def alone(self, n: int) -> bool:
        """Whether no other set can be like enough: not even one with one shingle more."""
        return self.whole * n < self.part * (n + 1)


def _marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, like: Likeness) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``node`` (a number of the set), its size ``n`` and ``head`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, heads = [], [], []
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(2).slice(at, 64).to_pylist():
                    found = shingle_set(text, shingle)
                    n = len(found)
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
                    sizes.append(n)
                    heads.append(found[: 0 if like.alone(n) else n - like.overlap(n) + 1 + n // EXTRA].view(np.int64))
            nodes = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
            arrays = [*batch.columns[:2], nodes, pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "node", "n", "head"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return pin_python(rows.mapInArrow(run, "doc_id bigint, digest bigint, node bigint, n bigint, head array<bigint>"))


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``node`` and ``s``, the whole set, of the nodes in ``wanted`` (node, digest): one text of each is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = [shingle_set(text, shingle).view(np.int64) for text in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "s"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(text).alias("digest"), text.alias("text")).join(wanted, "digest")
    one = rows.groupBy("node").agg(F.first("text").alias("text"))
    return pin_python(one.mapInArrow(run, "node bigint, s array<bigint>"))


def _verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Those of the pairs ``a``, ``b`` that are like enough: the shingles of the smaller set are probed in the larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for x, y in zip(some.column(2), some.column(3), strict=True):
                    a, b = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                    if len(a) > len(b):
                        a, b = b, a
                    spots = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    both = int((b[spots] == a).sum())
                    keep.append(like.whole * both >= like.part * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the groups that ``edges`` make."""
    roots = connected_components(edges)
    return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _alive(rows: DataFrame, apart: bool = False) -> DataFrame:
    """``rows`` (node, n, root, token) on the lists that hold two groups or more, with the ``size`` of the list; with
    ``apart`` every node is a group."""
    if apart:
        lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    else:
        ends = F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")
        lists = rows.groupBy("token").agg(*ends).where("low != high")
    live = pin(lists.select("token", "size"))
    return pin(rows.drop("size").join(live, "token").select("token", "node", "n", "root", "size"))


def _central(rows: DataFrame, like: Likeness, few, crowded: int) -> DataFrame:
    """Pairs of the sets of a crowded list with the one of them that has the most of itself on crowded lists: where near
    copies of one text meet, that is the text with the fewest changes. Pairs that meet too seldom are left to the search."""
    many = rows.where(F.col("size") > crowded)
    weight = many.groupBy("node").agg((F.count(F.lit(1)) / F.first("n")).alias("w"))
    many = many.join(weight, "node")
    centre = many.groupBy("token").agg(F.max(F.struct("w", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("root_b"))).alias("c"))
    both = many.select("token", F.col("node").alias("a"), F.col("n").alias("na"), "root").join(centre.select("token", "c.b", "c.nb", "c.root_b"), "token")
    fit = both.where((F.col("root") != F.col("root_b")) & like.sizes_fit("na", "nb"))
    met = fit.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.first(F.least("na", "nb")).alias("n"))
    return met.where(2 * F.col("met") >= few(F.col("n"))).select("a", "b")


def _search(rows: DataFrame, heavy: DataFrame, like: Likeness, few, crowded: int) -> DataFrame:
    """Candidates ``a``, ``b`` between groups: for every set the T-occurrence search on its lists that are not crowded.

    ``few`` (sizes) is how often partners meet at least, ``heavy`` (node, c) the crowded lists of a set. The smaller set
    of a pair (by size, then number) is found from the larger one. A pair is only sought where its crowded lists leave
    something of ``few``; for the others both sets are searched again later.
    """
    short = rows.where(F.col("size") <= crowded).join(heavy, "node", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    lists = short.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "node", "root", "c"))).alias("entries"))
    mine = lists.select(F.posexplode("entries").alias("at", "e"), "entries")

    def needed(x: Column) -> Column:
        return few(F.least(x["n"], F.col("e.n"))) - F.least(x["c"], F.col("e.c"))

    def may(x: Column) -> Column:
        fits = like.whole * x["n"] >= like.part * F.col("e.n")
        return fits & (x["root"] != F.col("e.root")) & (needed(x) > 0)

    before = F.filter(F.slice("entries", F.lit(1), F.col("at")), may)
    some = mine.select("e", F.transform(before, lambda x: F.struct(x["node"].alias("node"), needed(x).alias("need"))).alias("x"))
    queries = some.where(F.size("x") > 0).groupBy(F.col("e.node").alias("node")).agg(F.collect_list("x").alias("lists"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for node, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                inner = lists.values
                nodes, need = (x.to_numpy() for x in inner.flatten().flatten())
                names, number = np.unique(nodes, return_inverse=True)
                wanted = np.zeros(len(names), dtype=np.int64)
                wanted[number] = need
                cuts = np.cumsum(inner.value_lengths().to_numpy())
                found = divide_skip([sorted(x.tolist()) for x in np.split(number, cuts[:-1])], int(need.min()))
                hits = [k for k, count in found.items() if count >= wanted[k]]
                a += names[hits].tolist()
                b += [node] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return queries.mapInArrow(run, "a bigint, b bigint")


def _blocks(sets: DataFrame, like: Likeness) -> DataFrame:
    """Links ``a``, ``b`` that join groups among all of ``sets`` (node, n, root, s), in blocks of sets of like size.

    Sizes of partners differ by a factor p/q at most, so they fall into the same or the next class of sizes. A class is
    dealt into blocks, each pair of blocks is a task. It counts common shingles by products of 0/1 matrices, some
    thousand shingles at a time, and returns a link only if it joins two groups that its links have not joined yet.
    """
    step = float(np.log(like.whole / like.part))
    sized = sets.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int"))
    counts = sized.groupBy("band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    counts = pin(counts.select("band", parts.alias("parts")))
    above = counts.select((F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = counts.select((F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    dealt = sized.join(counts, "band").join(above, "band", "left").join(below, "band", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), "parts").cast("int"))
    key = lambda band, i, j, step: F.struct(band.alias("band"), i.alias("i"), j.alias("j"), F.lit(step).alias("step"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(every("parts"), lambda k: key(F.col("band"), F.least("part", k), F.greatest("part", k), 0))
    up = F.when(F.col("above").isNotNull(), F.transform(every("above"), lambda k: key(F.col("band"), F.col("part"), k, 1)))
    down = F.when(F.col("below").isNotNull(), F.transform(every("below"), lambda k: key(F.col("band") - 1, k, F.col("part"), 1)))
    none = F.array().cast("array<struct<band:int,i:int,j:int,step:int>>")
    keys = F.concat(own, F.coalesce(up, none), F.coalesce(down, none))
    tasks = dealt.select(F.explode(keys).alias("key"), "node", "n", "root", "s")

    def run(table: pa.Table) -> pa.Table:
        nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
        sizes = table.column("n").to_numpy()
        lists = table.column("s").combine_chunks()
        values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), lists.value_lengths().to_numpy())
        shingles, column = np.unique(values, return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
        for at in range(0, len(shingles), 4096):
            low, high = np.searchsorted(column, [at, at + 4096])
            grid = np.zeros((len(nodes), min(4096, len(shingles) - at)), dtype=np.float32)
            grid[owner[low:high], column[low:high] - at] = 1
            common += grid @ grid.T
        both = common.astype(np.int64)
        close = like.whole * both >= like.part * (sizes[:, None] + sizes[None, :] - both)
        _, group = np.unique(roots, return_inverse=True)
        parent = list(range(int(group.max()) + 1))

        def top(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        a, b = [], []
        for x, y in np.argwhere(np.triu(close, 1)).tolist():
            gx, gy = top(group[x]), top(group[y])
            if gx != gy:
                parent[gx] = gy
                a.append(nodes[x])
                b.append(nodes[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tasks.groupBy("key").applyInArrow(run, "a bigint, b bigint")


def links(
    docs: DataFrame, marks: DataFrame, text_col: str, shingle: int, like: Likeness, crowded: int = CROWDED
) -> DataFrame:
    """Edges ``a``, ``b`` between nodes of ``marks`` that join the same nodes into groups as all links together do."""
    nodes = marks.where(F.size("head") > 0).groupBy("node").agg(
        F.min("n").alias("n"), F.min("digest").alias("digest"), F.first("head").alias("head")
    )
    nodes = pin(nodes)
    listed = nodes.select("node", "n", F.explode("head").alias("token"))
    rows = _alive(listed.withColumn("root", F.col("node")), apart=True)

    def few_of_head(n: Column) -> Column:
        return 1 + F.floor(n / EXTRA)

    # only sets that meet others often enough can have a partner
    met = rows.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
    able = met.where(F.col("met") >= few_of_head(like.overlap_col(F.col("n")))).select("node")
    rows = _alive(rows.join(able, "node", "left_semi"), apart=True)

    def whole(some: DataFrame) -> DataFrame:
        return _sets(docs, nodes.select("node", "digest").join(some, "node", "left_semi"), text_col, shingle)

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = pin_python(pairs)
        both = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        return _verified(pairs, whole(both), like)

    edges = None
    for few in (few_of_head, like.overlap_col):
        if not rows.where(F.col("size") > crowded).isEmpty():
            found = links_of(_central(rows, like, few, crowded))
            edges = pin(found if edges is None else edges.union(found))
            rows = _alive(_rooted(rows, edges))
        heavy = pin(rows.where(F.col("size") > crowded).groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")))
        found = links_of(_search(rows, heavy.select("node", "c"), like, few, crowded))
        edges = pin(found if edges is None else edges.union(found))
        left = pin(heavy.where(F.col("c") >= few(like.overlap_col(F.col("n")))).select("node", "n"))
        if left.isEmpty():
            return edges
        sets = pin(_rooted(left.join(whole(left), "node"), edges))
        if few is few_of_head:
            rows = _alive(sets.select("node", "n", "root", F.explode("s").alias("token")))
    return edges.union(pin(_blocks(sets, like)))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    likeness: tuple[int, int] = (90, 100),
    crowded: int = CROWDED,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` (size of the set), ``component_id`` (smallest ``doc_id`` reachable by links, itself
    included) and ``digest`` (xxhash64 of the text) for every row.

    Words lie between blanks, A-Z are lower-cased; a set is the distinct shingles, with fewer words the whole sequence.
    Texts without words, NULL included, have the empty set and link with nothing, not with each other either: their
    component is their own id. Rows with equal ids stay apart and share a component if their texts do. A row without an
    id gets the smallest id of its component, NULL if the component has none. Sets are held by 64-bit hashes of their
    shingles. An empty table gives an empty result.
    """
    like = Likeness(*likeness)
    marks = _marks(docs, id_col, text_col, shingle, like)
    roots = connected_components(links(docs, marks, text_col, shingle, like, crowded)).select("node", "root")
    firsts = marks.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id")).join(roots, "node", "left")
    firsts = pin(firsts.select("node", "first_id", F.coalesce("root", "node").alias("root")))
    named = firsts.join(firsts.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return marks.select("doc_id", "digest", "node", "n").join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), "digest"
    )
