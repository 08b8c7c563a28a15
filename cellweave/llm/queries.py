"""The operators' queries over the driver's tables, and their SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from . import bpe, divergence, embedding_dedup, language, mixing, periods, pieces, simhash, suffix_dedup, token_records, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources to weights 3, 1, 2 takes of each document; nulls count 0 words, repeated rows are rows of their own."""
    return mixing.mix_report(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in at most 2 bits; texts without words share the fingerprint 0."""
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all vectors by cosine 0.95; null, zero and non-finite vectors stand alone."""
    return embedding_dedup.embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that a 50-byte string of an earlier one covers; null texts have none, a null doc_id is the last."""
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from two thirds of the labelled documents and predicted for all; texts without a letter are und."""
    return language.identify(_table(spark, sf_dir, "documents"), folds=3, fold=1)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector with all others; null and non-finite vectors take no part."""
    vectors = topk.whole_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text through the pair occurrence index and back; null texts are empty."""
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a record of token files, in order of doc_id, read back from them; null texts hold the end id alone."""
    return token_records.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, by way of ARC, read back from the archives; null pages are empty payloads."""
    found = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a network that learned from three quarters of the labelled ones; empty texts are scored too."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=4, fold=2, threshold=0.3)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text through the score-ordered agenda and back."""
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole text, every tenth document's end made periodic first."""
    return periods.run_report(_table(spark, sf_dir, "documents"), plant=True)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each language's sources lie from each other, and each group's most telling terms."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), least=10, top=10)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_embeddings": op2_embeddings,
    "op3_simhash": op3_simhash,
    "op4_topk": op4_topk,
    "op5_bpe": op5_bpe,
    "op6_tokens": op6_tokens,
    "op7_repeats": op7_repeats,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_pieces": op11_pieces,
    "op12_periods": op12_periods,
    "op13_divergence": op13_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {}

# The mix of op1.  Weights 3, 1, 2 repeat over the sources in code-point order;
# a source is capped when the level of those from it on, in order of cap over
# weight, lifts it above its cap.
ORACLE_SQL["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY source),
weighed AS (
  SELECT source, total, [3, 1, 2][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
         2 * total AS cap, least(1.5 * CAST(sum(total) OVER () AS DOUBLE), 2.0 * CAST(sum(total) OVER () AS DOUBLE)) AS budget
  FROM totals),
levels AS (
  SELECT *, (budget - coalesce(CAST(sum(cap) OVER b AS DOUBLE), 0.0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, total,
         least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, CAST(cap AS DOUBLE) / w) FROM levels WHERE level * w <= cap) * w, CAST(cap AS DOUBLE))) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN total > 0 THEN CAST(floor(target) AS BIGINT) // total ELSE 0 END AS epochs,
         CAST(floor(target) AS BIGINT) - CASE WHEN total > 0 THEN CAST(floor(target) AS BIGINT) // total ELSE 0 END * total AS rest
  FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.total, p.target, p.epochs, p.rest,
         coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT), 0) AS upto,
         CAST(sum(s.size) OVER (PARTITION BY s.source, s.k) AS BIGINT) AS unit
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target,
       epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - unit <= rest AND unit > 0 THEN size * (rest - upto + unit) // unit ELSE 0 END AS taken
FROM placed
"""

ORACLE_SQL["op4_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

ORACLE_SQL["op9_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
m AS (SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM m
"""

ORACLE_SQL["op2_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.u, p.w FROM reach r JOIN pairs p ON r.w = p.u),
c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

# A 50-byte string starts at p; runs of such starts at most 50 apart remove one span.
ORACLE_SQL["op7_repeats"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, b[p:p + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS p FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.doc_id, w.p FROM w JOIN m ON m.s = w.s WHERE w.doc_id > m.first),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM h)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 49 AS z FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, count(*) AS n_spans, sum(z - a + 1) AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE
    list_reduce(list_transform(range(0, n_spans + 1), lambda j: b[(CASE WHEN j = 0 THEN 1 ELSE z[j] + 1 END):(CASE WHEN j = n_spans THEN n ELSE a[j + 1] - 1 END)]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLE_SQL["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(s.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l ON l.lang = g.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) AS BIGINT) AS p,
         1 + CAST(1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS BIGINT) AS whole
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - whole) * (p - whole) // (p + whole) FROM shares WHERE n > 0 AND p > whole),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
