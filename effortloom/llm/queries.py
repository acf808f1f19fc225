"""The registered queries of this folder, one per operator, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effortloom.llm import lines, minhash, mixing, negatives, ngramjoin, packing, phrases, quality, secrets, shards, simhash, toxicity, wordpieces
from effortloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and the verdict by divergence from the language references."""
    return quality.judge(read(spark, folder, "documents"), min_words=50)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under SimHash fingerprints of three-word shingles at three bits or fewer."""
    return simhash.near_duplicates(read(spark, folder, "documents"), shingle=3, distance=3).select(
        "doc_id", "fingerprint", "component_id"
    )


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """One-permutation MinHash of every document and of its edited copy."""
    return minhash.edited_likeness(read(spark, folder, "documents"))


def _span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, hidden ones included."""
    found = secrets.scan_documents(read(spark, folder, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(_span_text("base"), 256).alias("base_sha256"), _span_text("spans").alias("spans"), "layers", "layers_cut",
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learnt without the held-out labels."""
    return toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"), held_out=2, threshold=0.3)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy word-piece count of every document."""
    return wordpieces.count_tokens(read(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shards 0 to 23 of near equal bytes."""
    placed = shards.shard(read(spark, folder, "documents"), shards=24, row_overhead=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that every document loses and the digest of what stays."""
    return lines.dedup_lines(read(spark, folder, "documents"), min_chars=20, min_docs=3).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id < common.top AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2,048 tokens."""
    return packing.pack_documents(read(spark, folder, "documents"), capacity=2048)


#: Target shares of tokens by domain.
TARGETS = {"clean": 0.94, "low": 0.04, "toxic": 0.02}


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of every document at which the expected tokens of the domains meet their targets."""
    domains = mixing.quality_domains(read(spark, folder, "labels"))
    return mixing.Mix(read(spark, folder, "documents"), domains, TARGETS).rates()


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels of every seventh moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, folder, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(rows, anchor="vec_id % 100 = 0", scale=256, positives=5, negatives=5, share=(80, 100))


OP11_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_dot_product(a.q, x.q)::BIGINT AS score
  FROM e a JOIN e x ON x.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), f AS (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM f WHERE rank <= 5
"""


def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under a likeness of three-word shingle sets of 0.9 or more."""
    found = ngramjoin.near_duplicates(read(spark, folder, "documents"), shingle=3, likeness=(90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return phrases.collocations(read(spark, folder, "documents"), least=30, top=2000)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT id, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS no
  FROM (SELECT id, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS p FROM d)
), w AS (
  SELECT lang, id, no, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT lang, id, no, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces)
), win AS (
  SELECT lang, word AS w1, lead(word, 1) OVER s AS w2, lead(word, 2) OVER s AS w3, lead(word, 3) OVER s AS w4
  FROM w WINDOW s AS (PARTITION BY id, no ORDER BY pos)
), f AS (
  SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM win GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM win WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM win WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM win WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM c JOIN (SELECT unnest([1, 2, 3]) AS k) k ON k.k < c.m
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k.k + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT c.lang, array_to_string(c.ws[s.s:s.s + q.q - 1], ' ') AS phrase, max(c.a) AS most
  FROM c JOIN (SELECT unnest([2, 3]) AS q) q ON q.q < c.m JOIN (SELECT unnest([1, 2, 3]) AS s) s ON s.s + q.q - 1 <= c.m
  GROUP BY ALL
), alive AS (
  SELECT scored.* FROM scored LEFT JOIN inner_phrases i ON i.lang = scored.lang AND i.phrase = scored.phrase
  WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * scored.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alive
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_minhash": op3_minhash,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_negatives": op11_negatives,
    "op12_ngram_join": op12_ngram_join,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op11_negatives": OP11_SQL, "op13_collocations": OP13_SQL}
