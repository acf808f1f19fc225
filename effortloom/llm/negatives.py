"""Hard negatives by shared candidate lists of anchor clusters.

The score of a row for an anchor is the inner product of their vectors. Anchors are clustered by direction; for a cluster
with centre c whose members lie within the angle w of it, no member of norm |a| scores a row x above

    |a| |x| cos(max(0, angle(x, c) - w))

so one order of the rows by |x| cos(...) serves the whole cluster. Every member walks that list from the top and stops
when the bound of the next row cannot beat what it holds: that certifies its result. Anchors walk twice, first for their
positives - the best rows of their own label -, then for the negatives of each positive: the best rows of other labels
whose score lies between a share of the positive's and the positive's own.

Rows are never shuffled and nothing is made per pair. Anchors go through in portions of bounded size that are sent to all
tasks; a task sorts its rows once per cluster, block by block, and keeps the results over its blocks, so that later walks
end early. What tasks return, a few rows an anchor, is merged by window functions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortloom.session import pin, shared_folder

#: Anchors that go through together, about: what is sent to the tasks and through the driver at once.
PORTION = 2048
#: Anchors that the cluster centres are fitted on, at most, and the number of clusters, at most.
SAMPLE, CLUSTERS = 4096, 32
#: Rows of a list that is sorted at once.
BLOCK = 8192
#: Components are held as whole numbers up to this size.
LIMIT = float(2**31 - 1)
#: Relative slack of a bound against rounding.
SLACK = 1e-9


def whole_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """``id``, ``label``, ``q`` (components as whole numbers: floor of ``scale`` times the component) and ``row_key`` of
    the rows (id, label, vector) that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten()
            x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            stops = np.cumsum(sizes)
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            fine = (wrong[stops] == wrong[stops - sizes]) & vectors.is_valid().to_numpy(zero_copy_only=False)
            fine &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * np.where(np.isfinite(x), x, 0)), -LIMIT, LIMIT).astype(np.int64)
            q = q[np.repeat(fine, sizes)]
            offsets = np.concatenate(([0], np.cumsum(sizes[fine]))).astype(np.int32)
            mask = pa.array(fine)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(q))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), lists], names=["id", "label", "q"])

    return rows.mapInArrow(run, "id bigint, label bigint, q array<bigint>").withColumn("row_key", F.xxhash64("id", "label", "q"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, longer ones are cut at ``width``, the longest length on the other side."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        out[:] = flat.reshape(len(sizes), width)
    else:
        at = np.concatenate(([0], np.cumsum(sizes)))
        for k in range(len(sizes)):
            n = min(sizes[k], width)
            out[k, :n] = flat[at[k] : at[k] + n]
    return out


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(norms, 1e-300)[:, None], norms


def cluster_centres(sample: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Unit centres by spherical k-means, started from evenly spaced rows of the sample."""
    unit, norms = _directions(sample)
    unit = unit[norms > 0]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    centres = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        moved, lengths = _directions(sums)
        centres = np.where(lengths[:, None] > 0, moved, centres)
    return centres


class Portion:
    """Anchors of a portion, cluster by cluster, with what their walks need."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, cluster: np.ndarray, centres: np.ndarray):
        order = np.argsort(cluster, kind="stable")
        self.keys, self.ids, self.labels, self.q, self.cluster = keys[order], ids[order], labels[order], q[order], cluster[order]
        self.names, self.begin = np.unique(self.cluster, return_index=True)
        self.end = np.append(self.begin[1:], len(order))
        unit, self.norms = _directions(self.q)
        self.centres = centres[self.names]
        cosines = np.clip((unit * centres[self.cluster]).sum(axis=1), -1, 1)
        angles = np.where(self.norms > 0, np.arccos(cosines), 0)
        self.reach = np.array([angles[a:b].max() for a, b in zip(self.begin, self.end, strict=True)])


def exact_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors; by floating point where that is exact, else in whole numbers, cut to 64 bits."""
    if not a.size or not x.size or np.sqrt((a * a).sum(axis=1).max() * (x * x).sum(axis=1).max()) < 2.0**52:
        return a @ x.T
    long = np.iinfo(np.int64)
    return np.clip(a.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T, long.min, long.max)


class Best:
    """The best entries of many slots: highest score first, ties by the smaller id."""

    def __init__(self, slots: int, depth: int):
        self.depth = depth
        self.slot = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.id = np.zeros(0, dtype=np.int64)
        self.last = np.full(slots, -np.inf)  # score of the last entry of a full slot

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begin = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - begin
        keep = place < self.depth
        full = place == self.depth - 1
        last = score[full].astype(np.float64)
        self.last[slot[full]] = np.where(np.abs(last) < 2.0**53, last, np.nextafter(last, -np.inf))
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


def _walk(portion: Portion, rows: tuple, step, wanted) -> None:
    """Every member of every cluster walks the block ``rows`` (ids, labels, vectors, keys) in the order of its cluster.

    ``wanted`` (members) is the score that a row must reach to be of use to a member now; ``step`` (members, scores,
    rows) takes what a stretch of the list gives.
    """
    ids, labels, x, keys = rows
    unit, norms = _directions(x)
    for k in range(len(portion.names)):
        cosines = np.clip(unit @ portion.centres[k], -1, 1)
        bound = norms * np.cos(np.maximum(0, np.arccos(cosines) - portion.reach[k]))
        bound = bound + SLACK * np.abs(norms) + SLACK
        order = np.argsort(-bound, kind="stable")
        members = np.arange(portion.begin[k], portion.end[k])
        at, length = 0, 128
        while at < len(order):
            top = bound[order[at]]
            members = members[portion.norms[members] * top + SLACK >= wanted(members)]
            if not len(members):
                break
            some = order[at : at + length]
            scores = exact_scores(portion.q[members], x[some])
            step(members, scores, (ids[some], labels[some], keys[some]))
            at, length = at + length, min(2048, 2 * length)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), _matrix(some.column(2), width), some.column(3).to_numpy()))
        while sum(len(h[0]) for h in held) >= BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _run_walks(rows: DataFrame, portion: Portion, slots: int, depth: int, make) -> DataFrame:
    """``slot``, ``score``, ``id``: the best of every task; ``make`` (portion) gives the ``step`` and ``wanted`` of a task
    around its ``Best``. The portion travels with the function; Spark broadcasts it once it is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(slots, depth)
        step, wanted = make(portion, best)
        for block in _blocks(batches, portion.q.shape[1]):
            _walk(portion, block, step, wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.slot, pa.int64()), pa.array(best.score, pa.int64()), pa.array(best.id, pa.int64())], names=["slot", "score", "id"]
        )

    return rows.select("id", "label", "q", "row_key").mapInArrow(run, "slot bigint, score bigint, id bigint")


def _merged(found: DataFrame, depth: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth)


def _positives(rows: DataFrame, portion: Portion, depth: int) -> np.ndarray:
    """``slot``, ``score``, ``id``, ``place`` of the best rows of each anchor's label, the anchor itself left out."""

    def make(portion: Portion, best: Best):
        def wanted(members: np.ndarray) -> np.ndarray:
            return best.last[members]

        def step(members: np.ndarray, scores: np.ndarray, some: tuple) -> None:
            ids, labels, keys = some
            use = (scores >= best.last[members][:, None]) & (portion.labels[members][:, None] == labels[None, :])
            use &= portion.keys[members][:, None] != keys[None, :]
            r, c = np.nonzero(use)
            best.add(members[r], scores[r, c].astype(np.int64), ids[c])

        return step, wanted

    merged = _merged(_run_walks(rows, portion, len(portion.keys), depth, make), depth)
    found = merged.orderBy("slot", "place").toPandas()  # at most ``depth`` rows an anchor of the portion
    return found[["slot", "score", "id", "place"]].to_numpy(dtype=np.int64).reshape(-1, 4)


def _negatives(rows: DataFrame, portion: Portion, positives: np.ndarray, depth: int, share: tuple[int, int]) -> DataFrame:
    """``slot`` (a row of ``positives``), ``score``, ``id``, ``place`` of the best rows of other labels in the band of it."""
    owner, high = positives[:, 0], positives[:, 1]
    # least whole score in the band, above ``high`` where that is negative; in two parts, so that it stays in 64 bits
    low = share[0] * (high // share[1]) - (-share[0] * (high % share[1]) // share[1])
    first = np.searchsorted(owner, np.arange(len(portion.keys) + 1))

    def make(portion: Portion, best: Best):
        places = int((first[1:] - first[:-1]).max(initial=0))
        slots = np.where(first[:-1, None] + np.arange(places) < first[1:, None], first[:-1, None] + np.arange(places), -1)
        top = np.where(slots >= 0, high[slots], -1) if places else np.zeros((len(slots), 0), dtype=np.int64)
        bottom = np.where(slots >= 0, low[slots], 0) if places else top
        empty = (slots < 0) | (bottom > top)

        def needed(members: np.ndarray) -> np.ndarray:
            return np.where(empty[members], np.inf, np.maximum(bottom[members], best.last[slots[members]]))

        def wanted(members: np.ndarray) -> np.ndarray:
            return needed(members).min(axis=1, initial=np.inf)

        def step(members: np.ndarray, scores: np.ndarray, some: tuple) -> None:
            ids, labels, _ = some
            least, other = needed(members), portion.labels[members][:, None] != labels[None, :]
            for place in range(places):
                use = other & (scores >= least[:, place][:, None]) & (scores <= top[members, place][:, None])
                r, c = np.nonzero(use)
                best.add(slots[members[r], place], scores[r, c].astype(np.int64), ids[c])

        return step, wanted

    return _merged(_run_walks(rows, portion, max(1, len(positives)), depth, make), depth)


def hard_negatives(
    rows: DataFrame,
    anchor: str,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    portion: int = PORTION,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Rows without an id or a label, without a vector, or with a NULL or non-finite component take no part. ``anchor`` is a
    condition on the columns that says which rows are anchors. Components become the floor of ``scale`` times them;
    those beyond 2**31 are cut there. An anchor's positives are the first ``positives`` other rows of its label, scores
    descending, ties by the smaller id; per positive the first ``negatives`` rows of other labels follow whose score is
    at least ``share`` of the positive's and at most the positive's - none if that score is negative.

    Vectors of unlike length are compared as if the shorter one ended in zeros. Rows that share an id are rows of their
    own; equal anchor rows are mined once and are no positives of each other, and anchors that share an id are mined
    each for itself. A label held by the anchor alone gives no rows. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    plain = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("q"), F.expr(anchor).alias("anchor"),
    )
    vectors = pin(whole_vectors(plain.select("id", "label", "q"), scale))
    # the condition is on columns that the whole-number table no longer has, so it is met again by row key
    chosen = whole_vectors(plain.where("anchor").select("id", "label", "q"), scale)
    anchors = pin(chosen.dropDuplicates(["row_key"]))
    out = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    total, width = anchors.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if not total:
        return spark.createDataFrame([], schema)
    width = max(1, width)
    sample = anchors.orderBy(F.xxhash64("row_key"), "row_key").limit(SAMPLE).select("q").toArrow().column("q").combine_chunks()
    centres = cluster_centres(_matrix(sample, width), max(1, min(CLUSTERS, total // 64)))
    parts = -(-total // portion)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, _ = _directions(_matrix(batch.column(2), width))
            nearest = (unit @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int64())], names=["id", "label", "q", "row_key", "cluster"])

    placed = anchors.mapInArrow(assign, "id bigint, label bigint, q array<bigint>, row_key bigint, cluster bigint")
    # portions of about equal size, each a stretch of clusters so that few lists are walked in it
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before)  # at most CLUSTERS rows
    inside = F.pmod(F.xxhash64(F.lit(5), "row_key"), "n")
    number = F.floor((F.col("before") + inside) / portion).cast("int")
    placed = pin(placed.join(starts, "cluster").withColumn("portion", F.least(number, F.lit(parts - 1))))
    for k in range(parts):
        some = placed.where(F.col("portion") == k).select("row_key", "id", "label", "q", "cluster").toArrow()  # about ``portion`` rows
        if not some.num_rows:
            continue
        column = {name: some.column(name).combine_chunks() for name in some.column_names}
        group = Portion(
            column["row_key"].to_numpy(), column["id"].to_numpy(), column["label"].to_numpy(), _matrix(column["q"], width),
            column["cluster"].to_numpy(), centres,
        )
        held = _positives(vectors, group, positives)
        found = _negatives(vectors, group, held, negatives, share)
        names = spark.createDataFrame(
            pa.table({
                "slot": pa.array(np.arange(len(held))), "anchor_id": pa.array(group.ids[held[:, 0]]),
                "positive_id": pa.array(held[:, 2]), "positive_score": pa.array(held[:, 1]),
            })
        )
        found.join(names, "slot").select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
