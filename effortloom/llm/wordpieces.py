"""Token counts by greedy longest match in linear time.

Greedy word-piece cutting takes the longest vocabulary piece at the front of the word, then the longest piece of the rest,
and so on. Done naively that is quadratic. Here the vocabulary is a trie whose nodes carry a failure link and the number
of pieces popped on it: when a node has no edge for the next byte, the pieces that greedy cutting would have taken off
the front are counted from the node, and matching goes on at the link - the rest of what was read, as a node of the trie.
Each byte is looked at once, and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortloom.llm.common import pin_python
from effortloom.llm.encode import default_tokenizer

#: Symbol for the end of a word, after the byte values.
END = 256
CACHE_WORDS = 300_000


def byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write for bytes: printable bytes stand for themselves, others follow from
    code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    letters.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in own))
    return letters


def vocabulary_pieces(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary with word ends as symbol sequences."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    letters, out = byte_letters(), []
    for token in tokens:
        ended = token.endswith("</w>")
        out.append((*[letters[c] for c in (token[:-4] if ended else token)], *[END] * ended))
    return out


class Automaton:
    """Trie with failure links and popped counts. Node 0 is the root."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.edges: dict[int, int] = {}
        parent, symbol, accepts = [0], [0], [False]
        for piece in pieces:
            node = 0
            for s in piece:
                key = node * 512 + s
                if key not in self.edges:
                    self.edges[key] = len(parent)
                    parent.append(node)
                    symbol.append(s)
                    accepts.append(False)
                node = self.edges[key]
            if piece:
                accepts[node] = True
        children: list[list[int]] = [[] for _ in parent]
        for node in range(1, len(parent)):
            children[parent[node]].append(node)
        # link -1: what was read cannot be cut into pieces
        self.link, self.popped = [-1] * len(parent), [0] * len(parent)
        queue = deque(children[0])
        while queue:
            node = queue.popleft()
            queue.extend(children[node])
            if accepts[node]:  # all that was read is a piece
                self.link[node], self.popped[node] = 0, 1
                continue
            at, count = self.link[parent[node]], self.popped[parent[node]]
            while at >= 0 and at * 512 + symbol[node] not in self.edges:
                count, at = count + self.popped[at], self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.edges[at * 512 + symbol[node]], count

    def count(self, word: bytes) -> int:
        """Pieces of ``word`` and its end symbol; -1 if they cannot be cut."""
        edges, link, popped = self.edges, self.link, self.popped
        node, total = 0, 0
        for s in (*word, END):
            while True:
                step = edges.get(node * 512 + s)
                if step is not None:
                    node = step
                    break
                total += popped[node]
                node = link[node]
                if node < 0:
                    return -1
        while node > 0:  # what is left is cut by the popped pieces of its nodes
            total += popped[node]
            node = link[node]
        return total if node == 0 else -1


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown`` of every row.

    Words are what lies between blanks (space, controls 9 to 13), lower-cased; each is cut by greedy longest match
    against the pieces of the vocabulary file, with the word's end as a symbol of its own. A word that cannot be cut is
    one token and counted in ``n_unknown``. NULL and empty texts have none. Rows with equal ids are counted one by one.
    An empty table gives an empty result. The automaton is broadcast; its size is that of the vocabulary, not the data.
    """
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Automaton(vocabulary_pieces(vocabulary or default_tokenizer())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shipped.value.count
        known: dict[bytes, int] = {}
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(1).slice(at, 64).to_pylist():
                    words = (text or "").lower().encode().split()
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    for w in set(words).difference(known):
                        known[w] = count(w)
                    found = [known[w] for w in words]
                    unknown = found.count(-1)
                    rows.append((len(words), sum(found) + 2 * unknown, unknown))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pin_python(rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"))
