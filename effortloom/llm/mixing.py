"""Mixing to target weights with soft domain membership, in DataFrame expressions alone.

Documents do not belong to one domain each: a classifier fitted on a labelled table gives every document a posterior over
the domains. Documents then get nonnegative rates - expected numbers of copies - such that the expected tokens of every
domain come out at its target. Rates stay as near to one copy each as they can: the unknowns are as many as documents,
the equations as few as domains.

The fit is projected gradient descent on the dual of a least-squares objective, with the projection - no rate below zero - applied
to the sum of all steps. One pass over the posteriors gives the few domain totals, the driver solves a system of that
size for the step, and every rate moves by the dot product of the step and its posterior. Rates are never stored.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.llm.common import BLANKS
from effortloom.session import pin

#: Levels of a count of telling words: none, one, two or three, four to seven, and so on.
LEVELS = 6
#: A target counts as met when its domain comes this near to it, as a share of all tokens.
MET = 1e-4


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Add ``_w``, the words of the text, and ``_n``, their number."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    cut = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    return df.withColumn("_w", cut).withColumn("_n", F.size("_w").cast("long"))


def with_marks(df: DataFrame, text: str, telling: list[list[str]]) -> DataFrame:
    """Add ``_m``, what the classifier sees of a text: per domain the level of how many of its telling words occur, then
    how far words repeat (tenths) and how long they are. Absence counts too: it is level zero."""
    levels = []
    for some in telling:
        hits = F.size(F.array_intersect(F.col("_w"), F.split(F.lit("\t".join(some)), "\t"))) if some else F.lit(0)
        levels.append(F.least(F.floor(F.log2(hits + 1.0)), F.lit(LEVELS - 1)).cast("int"))
    n = F.greatest(F.col("_n"), F.lit(1))
    repeat = F.floor(10 * F.size(F.array_distinct("_w")) / n).cast("int")
    length = F.least(F.floor(F.coalesce(F.length(F.col(text)), F.lit(0)) / n), F.lit(20)).cast("int")
    return df.withColumn("_m", F.array(*levels, repeat, length))


class Classifier:
    """Naive Bayes on the marks: ``base`` log priors, ``tables`` log likelihoods by mark, value and domain."""

    def __init__(self, domains: list[str], telling: list[list[str]], base: np.ndarray, tables: list[np.ndarray]):
        self.domains, self.telling, self.base, self.tables = domains, telling, base, tables

    def scores(self) -> Column:
        def score(d: int) -> Column:
            parts = [F.get(F.array(*[F.lit(float(x)) for x in t[:, d]]), F.get(F.col("_m"), F.lit(k))) for k, t in enumerate(self.tables)]
            return functools.reduce(operator.add, parts, F.lit(float(self.base[d])))

        return F.array(*[score(d) for d in range(len(self.domains))])


def softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), operator.add))


def fit_classifier(
    docs: DataFrame,
    labelled: DataFrame,
    domains: list[str],
    max_labelled: int = 20_000,
    vocabulary: int = 200,
    least_documents: int = 5,
) -> Classifier:
    """Fit on at most ``max_labelled`` rows of ``labelled`` (doc_id, domain), chosen by a digest of the id.

    Telling words of a domain are those of ``least_documents`` sampled documents or more whose rate in it exceeds their
    rate elsewhere by most standard errors, four at least; ``vocabulary`` a domain. ``docs`` has doc_id and text.
    """
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    ids = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    ids = pin(ids)  # its size is bounded, so it may be broadcast
    sample = pin(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("domain", "text"))

    def each(name: str) -> list[Column]:
        return [F.count(F.when(F.col("domain") == d, 1)).alias(f"{name}{k}") for k, d in enumerate(domains)]

    sizes = np.array(sample.agg(*each("n")).first(), dtype=float)
    total = sizes.sum()
    present = with_words(sample, "text").select("domain", F.explode(F.array_distinct("_w")).alias("word"))
    counts = present.groupBy("word").agg(*each("c"), F.count(F.lit(1)).alias("c")).where(
        (F.col("c") >= least_documents) & ~F.col("word").contains("\t")
    )
    counts = pin(counts)
    telling: list[list[str]] = []
    pooled = F.col("c") / F.lit(max(total, 1.0))
    for k, n in enumerate(sizes):
        rest = total - n
        if not n or not rest:
            telling.append([])
            continue
        apart = F.col(f"c{k}") / F.lit(n) - (F.col("c") - F.col(f"c{k}")) / F.lit(rest)
        z = apart / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n + 1 / rest) + F.lit(1e-12))
        best = counts.select("word", z.alias("z")).where("z >= 4").orderBy(F.desc("z"), "word").limit(vocabulary)
        telling.append([r["word"] for r in best.collect()])
    marked = with_marks(with_words(sample, "text"), "text", telling)
    seen = marked.select("domain", F.posexplode("_m").alias("mark", "value")).groupBy("mark", "value").agg(*each("c")).collect()
    widths = [LEVELS] * len(domains) + [11, 21]
    tables = [np.ones((width, len(domains))) for width in widths]
    for r in seen:
        tables[r["mark"]][r["value"]] += [r[f"c{k}"] for k in range(len(domains))]
    return Classifier(
        domains, telling, np.log((sizes + 1) / (total + len(domains))), [np.log(t / t.sum(axis=0)) for t in tables]
    )


def with_posterior(df: DataFrame, text: str, classifier: Classifier) -> DataFrame:
    """Add ``_n`` (tokens, here words) and ``_p`` (posterior)."""
    scored = with_marks(with_words(df, text), text, classifier.telling).withColumn("_s", classifier.scores())
    return scored.withColumn("_p", softmax(F.col("_s"))).drop("_w", "_m", "_s")


def rate(pull: Sequence[float]) -> Column:
    """The rate of a row: one, less the dot product of ``pull`` with its posterior, never below zero."""
    dot = functools.reduce(operator.add, [F.get(F.col("_p"), F.lit(k)) * F.lit(float(z)) for k, z in enumerate(pull)])
    return F.greatest(F.lit(0.0), 1 - dot)


def fit_rates(
    posteriors: DataFrame,
    weights: Sequence[float],
    total: float | None = None,
    repeat: float | None = None,
    tolerance: float = 1e-6,
    passes: int = 40,
) -> list[float]:
    """The ``pull`` of ``fit`` alone."""
    return fit(posteriors, weights, total, repeat, tolerance, passes)[0]


def fit(
    posteriors: DataFrame,
    weights: Sequence[float],
    total: float | None = None,
    repeat: float | None = None,
    tolerance: float = 1e-6,
    passes: int = 40,
) -> tuple[list[float], list[float]]:
    """The ``pull`` whose ``rate`` brings the expected tokens of the domains to ``weights`` of ``total``, and the shares
    that the domains then have.

    ``posteriors`` has ``_n`` and ``_p``. Without ``total`` it is the one at which the domain of the largest weight keeps
    all its tokens. A scarce domain is raised by rates above one. Shares that no rates give - a weight beyond its share in
    every document - are not met: then, or with ``repeat`` at once, a domain is asked for at most ``repeat`` (else one)
    times what it has, rather than the rates running off. The shares tell.
    The objective is the dual of being nearest to one copy each, counting a document by its tokens; its slope is the miss of
    the domain totals. Gradients of all rates are the posteriors times one short vector, so their sum over the passes - the
    pull - is all that is kept, and the cut at zero is applied to it anew in every pass. The step solves the miss by the
    token-weighted Gram matrix of the posteriors whose rates are not cut, summed up in the same pass; a step that does not
    lower the objective is halved. Ends when every domain is within ``tolerance`` of ``total`` or after ``passes``; the
    pull with the smallest miss is returned.
    """
    k = len(weights)
    w = np.asarray(weights, dtype=float) / sum(weights)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def p(j: int) -> Column:
        return F.get(F.col("_p"), F.lit(j))

    def sums_at(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Domain totals, Gram matrix, token-weighted squares of the rates and the largest rate."""
        rows = posteriors.withColumn("_r", rate(pull)).withColumn("_a", F.when(F.col("_r") > 0, F.col("_n")).otherwise(0))
        sums = rows.agg(
            *[F.sum(F.col("_n") * F.col("_r") * p(j)) for j in range(k)],
            *[F.sum(F.col("_a") * p(a) * p(b)) for a, b in pairs], F.sum(F.col("_n") * F.col("_r") * F.col("_r")),
            F.max("_r"),
        ).first()
        gram = np.zeros((k, k))
        for (a, b), x in zip(pairs, sums[k:-2], strict=True):
            gram[a, b] = gram[b, a] = x or 0.0
        return np.array([x or 0.0 for x in sums[:k]]), gram, sums[-2] or 0.0, sums[-1] or 0.0

    def solve(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Pull, totals and largest miss."""
        at, (totals, gram, squares, _) = np.zeros(k), start
        value = squares / 2
        best = (at, totals, float(np.abs(totals - wanted).max()))
        miss = totals - wanted
        step = None
        for _ in range(passes):
            if best[2] <= tolerance * total:
                break
            if step is None:
                step = np.linalg.pinv(gram + 1e-9 * np.trace(gram) * np.eye(k), hermitian=True) @ miss
                if not step @ miss > 0:
                    break
            trial = at + step
            totals, trial_gram, squares, most = sums_at(trial)
            size = float(np.abs(totals - wanted).max())
            if size < best[2]:
                best = (trial, totals, size)
            trial_value = squares / 2 + trial @ wanted
            if most <= 1 and trial @ wanted < 0:
                break  # this pull takes from no document less than nothing, yet from the goal: no rates give it
            if trial_value <= value - 1e-4 * (step @ miss) + 1e-12 * abs(value):
                at, gram, miss, value, step = trial, trial_gram, totals - wanted, trial_value, None
            else:
                step = step / 2
        return best

    start = sums_at(np.zeros(k))
    totals = start[0]
    if not totals.sum():
        return [0.0] * k, [0.0] * k
    if total is None:
        total = float(totals[w.argmax()] / w.max())
    wanted = total * w if repeat is None else np.minimum(total * w, repeat * totals)
    pull, sums, miss = solve(wanted)
    if repeat is None and miss > MET * total:
        pull, sums, _ = solve(np.minimum(wanted, totals))
    return pull.tolist(), (sums / max(sums.sum(), 1e-300)).tolist()


class Mix:
    """The fitted mix of a table: classifier, posteriors (written), pull and ``shares``, those the domains reach."""

    def __init__(
        self,
        docs: DataFrame,
        labelled: DataFrame,
        targets: dict[str, float],
        id_col: str = "doc_id",
        text_col: str = "text",
        total: float | None = None,
        repeat: float | None = None,
        **settings,
    ):
        self.docs, self.domains, self.text_col = docs, list(targets), text_col
        plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.classifier = fit_classifier(plain, labelled.select("doc_id", "domain"), self.domains, **settings)
        self.posteriors = pin(with_posterior(plain, "text", self.classifier).select("doc_id", "_n", "_p"))
        self.pull, shares = fit(self.posteriors, [targets[d] for d in self.domains], total, repeat)
        self.shares = dict(zip(self.domains, shares, strict=True))

    def _columns(self) -> list[Column]:
        each = [F.get(F.col("_p"), F.lit(k)).alias(f"p_{d}") for k, d in enumerate(self.domains)]
        return [F.col("_n").alias("n_tokens"), *each, rate(self.pull).alias("rate")]

    def rates(self) -> DataFrame:
        """``doc_id``, ``n_tokens``, ``p_<domain>`` for every domain and ``rate`` of every row.

        NULL and empty texts have no tokens and a posterior from the absence of words. Rows with equal ids and texts get the
        same rate. Labels of other domains, without a domain or without an id are ignored; with no labels at all every
        posterior is even. An empty table gives an empty result.
        """
        return self.posteriors.select("doc_id", *self._columns())

    def rows(self) -> DataFrame:
        """The same with ``row``, the document as a struct, in place of the id. Texts are scored again rather than joined
        to their rates: that would shuffle them."""
        rows = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("row"))
        rows = rows.withColumn("_text", F.col(f"row.`{self.text_col}`").cast("string"))
        return with_posterior(rows, "_text", self.classifier).select("row", *self._columns())


def copies(mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """The rows of the mix: a document comes as often as the whole part of its rate, and once more with the chance of
    the rest, drawn by a digest of its id and text. Columns are those of the documents.

    Rows that share an id are drawn apart unless their texts are equal too; a NULL id or text counts as one more value.
    The rated rows are written first: a filter on a rate that is still an expression would be pushed below the scoring
    and repeat it for every use of a score.
    """
    mixed = pin(mixed)
    digest = F.xxhash64(F.lit(seed), F.col(f"row.`{id_col}`"), F.xxhash64(F.col(f"row.`{text_col}`").cast("string")))
    draw = F.pmod(digest, F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("rate") + draw).cast("int")
    return mixed.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("_t")).select("row.*")


def quality_domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` (clean, low, toxic) of a table of ``quality`` and ``toxic`` marks."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
