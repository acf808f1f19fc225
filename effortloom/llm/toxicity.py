"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic documents are labelled for the learner; the rest of the text is unlabelled and holds toxic documents
too, at the class prior. The risk of a linear classifier is estimated from both: the positives' own loss, plus the loss of
the unlabelled as negatives less the prior's share of positives in it. That difference estimates a loss and cannot be
negative; where a batch makes it so, the step goes the other way (the non-negative correction), so the classifier does
not learn the unlabelled toxic documents by heart.

Words are hashed on the executors. The classifier is fitted in numpy on a bounded sample: at most ``max_positive``
confirmed documents and ``max_unlabelled`` others, chosen by a digest of their id, and scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.llm.common import pin_python

BUCKETS = 1 << 22
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def word_buckets(text: str | None) -> list[int]:
    """Distinct hashed words of a text: runs of letters, lower-cased; ASCII signs and digits separate words."""
    words = set((text or "").lower().encode().translate(_LETTERS).split())
    return sorted({zlib.crc32(w) % BUCKETS for w in words})


class Model:
    """Linear score of the words present. ``features`` is sorted."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def margins(self, documents: list[list[int]]) -> np.ndarray:
        at, columns = _rows(documents, self.features)
        return _times(at, columns, self.weights, len(documents)) + self.bias


def _rows(documents: list[list[int]], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the features present."""
    sizes = np.fromiter(map(len, documents), dtype=np.int64, count=len(documents))
    flat = np.fromiter((b for d in documents for b in d), dtype=np.int64, count=int(sizes.sum()))
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(features, flat), len(features) - 1)
    hit = features[place] == flat
    return np.repeat(np.arange(len(documents)), sizes)[hit], place[hit]


def _times(at: np.ndarray, columns: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=weights[columns], minlength=n)


def fit(
    positive: list[list[int]],
    unlabelled: list[list[int]],
    prior: float,
    *,
    least_documents: int = 4,
    least_z: float = 4.5,
    max_features: int = 3000,
    steps: int = 300,
    rate: float = 0.1,
    penalty: float = 1e-4,
    seed: int = 7,
) -> Model:
    """Train on hashed documents. ``prior`` is the share of toxic documents in the unlabelled text.

    Words of at least ``least_documents`` sampled documents are candidates; those whose rate among the positives differs
    from the unlabelled by ``least_z`` standard errors are features, ``max_features`` at most. Adam on random halves of the sample, logistic loss.
    """
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / (1 - min(prior, 0.999999)))))
    seen_p, count_p = np.unique(np.concatenate([np.asarray(d, np.int64) for d in positive]), return_counts=True)
    seen_u, count_u = np.unique(np.concatenate([np.asarray(d, np.int64) for d in unlabelled]), return_counts=True)
    every = np.union1d(seen_p, seen_u)
    p, u = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, seen_p)], u[np.searchsorted(every, seen_u)] = count_p, count_u
    share_p, share_u = p / len(positive), u / len(unlabelled)
    pooled = (p + u) / (len(positive) + len(unlabelled))
    z = (share_p - share_u) / np.sqrt(pooled * (1 - pooled) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    z[(p + u < least_documents) | (np.abs(z) < least_z)] = 0
    best = np.lexsort((every, -np.abs(z)))[:max_features]
    features = np.sort(every[best[z[best] != 0]])

    xp, xu = _rows(positive, features), _rows(unlabelled, features)
    n_p, n_u = len(positive), len(unlabelled)
    w, b = np.zeros(len(features)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    rng = np.random.default_rng(seed)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(x / 2))

    for step in range(1, steps + 1):
        half_p, half_u = rng.random(n_p) < 0.5, rng.random(n_u) < 0.5
        half_p[rng.integers(n_p)], half_u[rng.integers(n_u)] = True, True
        wp, wu = half_p / half_p.sum(), half_u / half_u.sum()
        fp, fu = _times(*xp, w, n_p) + b, _times(*xu, w, n_u) + b
        sp, su = sigmoid(fp), sigmoid(fu)
        negative = wu @ np.logaddexp(0, fu) - prior * (wp @ np.logaddexp(0, fp))
        # derivatives by the margins: positives as positives; unlabelled as negatives less positives as negatives
        gp, gn_p, gn_u = prior * wp * (sp - 1), -prior * wp * sp, wu * su
        if negative >= 0:
            gp, gu = gp + gn_p, gn_u
        else:
            gp, gu = -gn_p, -gn_u
        g = np.append(
            np.bincount(xp[1], weights=gp[xp[0]], minlength=len(w)) + np.bincount(xu[1], weights=gu[xu[0]], minlength=len(w)) + penalty * w,
            gp.sum() + gu.sum(),
        )
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(features, w, b)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def hashed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_buckets(t) for at in range(0, batch.num_rows, 64) for t in batch.column(0).slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["buckets"])

    return docs.select("text").mapInArrow(run, "buckets array<int>")


def train(
    docs: DataFrame, labels: DataFrame, held_out: int = 2, max_positive: int = 5000, max_unlabelled: int = 15_000, **settings
) -> Model:
    """Fit on the folds other than ``held_out``. ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    own = F.coalesce(fold() != held_out, F.lit(False))
    known = labels.where(own & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n, toxic = known.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("int"))).first()

    def sample(rows: DataFrame, bound: int) -> list[list[int]]:
        # the bound is the proof that the ids can be broadcast
        ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        texts = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi")
        table = pin_python(hashed(texts)).toArrow()["buckets"].combine_chunks()
        flat, stops = table.flatten().to_numpy(), np.cumsum([0, *table.value_lengths().to_pylist()])
        return [flat[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    positive = sample(known.where("toxic = 1"), max_positive)
    unlabelled = sample(docs.where(own), max_unlabelled)
    return fit(positive, unlabelled, (toxic or 0) / n if n else 0.0, **settings)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: int = 2,
    threshold: float = 0.3,
    **settings,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row.

    A document is held out if crc32(doc_id as text) mod 4 is ``held_out``; rows without an id are not held out and never
    learnt from. Labels of held-out documents are never read. NULL and empty texts score what a text without known words
    does. Repeated rows score alike. Without labels or texts to learn from the score is the prior. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(rows, labels.select("doc_id", "toxic"), held_out, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for at in range(0, batch.num_rows, 256):
                margins = model.margins([word_buckets(t) for t in batch.column(2).slice(at, 256).to_pylist()])
                out.append(0.5 * (1 + np.tanh(margins / 2)))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    marked = rows.select("doc_id", F.coalesce(fold() == held_out, F.lit(False)).alias("held_out"), "text")
    return pin_python(marked.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int"))
