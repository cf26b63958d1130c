"""The contract queries: whole tables in, full results out, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm._spark import table
from shardloom.llm.balltree import exact_top_k, integer_vectors
from shardloom.llm.compactwindows import passage_dedup
from shardloom.llm.decontaminate import THRESHOLD, decontaminate
from shardloom.llm.mixing import mix_sources
from shardloom.llm.ngramjoin import ngram_components
from shardloom.llm.ngramlm import kneser_ney_scores
from shardloom.llm.quality import fit_quality, score_quality
from shardloom.llm.suffixdedup import substring_dedup
from shardloom.llm.toxicity import fit_toxicity, score_toxicity
from shardloom.llm.warc import warc_round_trip


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity (expected grade), grade, toxic; a fifth of the labels is left out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), train_rows=fold(5) != 0)
    return score_toxicity(docs, model).select("doc_id", "severity", "grade", "toxic")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, coverage and item_id of the benchmark item covered most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("coverage") >= THRESHOLD).alias("contaminated"), "coverage", "item_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_components(docs, 4, 85, 100).select("doc_id", "n_shingles", "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and repeats, the ids of the documents that keep what was removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passage_dedup(docs).select("doc_id", "n_words", "n_removed", "n_spans", "repeats")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = integer_vectors(table(spark, sf_dir, "embeddings"))
    return exact_top_k(points, F.col("id") % 20 == 0, 20)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out"))
    scored = kneser_ney_scores(docs, ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train_rows=fold(5) != 0)
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_join": op4_ngram_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_warc": op7_warc,
    "op8_topk": op8_topk,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_quality": op10_quality,
}

ORACLES = {
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, least_id) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT e.b, min(r.least_id) FROM r JOIN e ON r.doc_id = e.a JOIN recurring.r AS o ON o.doc_id = e.b GROUP BY e.b, o.least_id HAVING min(r.least_id) < o.least_id)
SELECT doc_id, n_shingles, least_id AS component_id FROM n JOIN r USING (doc_id)
""",
    "op5_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
c AS (SELECT doc_id, x, unnest(range(0, n_bytes - 199, 256)) AS first FROM h WHERE n_bytes >= 200),
y AS (SELECT doc_id, first, substring(x, 2 * first + 1, 2 * 455) AS piece FROM c),
p AS (SELECT doc_id, first, piece, unnest(range(0, strlen(piece) // 2 - 199)) AS i FROM y),
m AS (SELECT doc_id, first + i AS pos, md5(substring(piece, 2 * i + 1, 400)) AS k FROM p),
t AS (SELECT k FROM m GROUP BY k HAVING count(*) > 1),
o AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM m SEMI JOIN t USING (k)),
i AS (SELECT doc_id, pos, sum((before IS NULL OR pos > before + 200)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM o),
r AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 200 AS b FROM i GROUP BY ALL),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS done FROM r),
u AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substring(x, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS head
  FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN u USING (doc_id)
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_page, count(*) AS n FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.n > 1 AND d.page_id IS DISTINCT FROM f.first_page AND f.first_page IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.n > 1 AND d.page_id IS DISTINCT FROM f.first_page THEN f.first_page END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
""",
    "op8_topk": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 20
""",
}
