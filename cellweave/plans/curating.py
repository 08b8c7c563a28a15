"""Curation rules as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as ops
from ..operators.compare import last_by_key
from ..operators.running import running_sums
from .tables import CELLS_SQL, cells, raw_cells, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def confidence_tiers(spark, sf_dir):
    """F10, A20."""
    return ops.pseudo_label_report(cells(spark, sf_dir).withColumn("tier", ops.tier(F.col("confidence"))))


ORACLE_SQL["confidence_tiers"] = f"WITH {CELLS_SQL} SELECT number, count(*) FILTER (confidence >= 0.95) AS high, count(*) FILTER (confidence >= 0.8 AND confidence < 0.95) AS med, count(*) AS total FROM cells GROUP BY number"


def _checked(spark, sf_dir):
    c = raw_cells(spark, sf_dir)
    return c.select("number", "confidence", ops.digit_consistency(F.col("number"), F.col("part").cast("string"), F.round(F.col("price") % 200 / 100, 2)).alias("error"))


@_query
def digit_consistency(spark, sf_dir):
    """F11, F12, A21, X23, T8."""
    return ops.reason_counts(_checked(spark, sf_dir))


_CHECKED = """
checked AS (
  SELECT 1 + l_partkey % 27 AS n, l_discount * 10 AS confidence, CAST(l_partkey AS VARCHAR) AS d, round(l_extendedprice % 200 / 100, 2) AS ar FROM lineitem),
e AS (SELECT n, confidence, CASE WHEN len(d) <> len(CAST(n AS VARCHAR)) THEN 'digit_mismatch' WHEN n < 10 AND ar > 1.3 THEN 'single_digit_too_wide' WHEN n >= 10 AND ar < 0.85 THEN 'double_digit_too_narrow' END AS reason FROM checked)
"""
ORACLE_SQL["digit_consistency"] = f"WITH {_CHECKED} SELECT reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY reason"


@_query
def rejection_rollup(spark, sf_dir):
    """Reports of counts by reason, summed as maps."""
    per = _checked(spark, sf_dir).where("error is not null").groupBy("number", F.substring_index("error", "(", 1).alias("reason")).agg(F.count(F.lit(1)).alias("c"))
    reports = per.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("reason", "c"))).alias("rejection_reasons"))
    return ops.merge_reason_maps(reports)


ORACLE_SQL["rejection_rollup"] = f"WITH {_CHECKED} SELECT reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY reason"


@_query
def quality_gate(spark, sf_dir):
    """brightness, spread and sharpness of parts stand for those of images."""
    p = table(spark, sf_dir, "part")
    verdict = ops.quality_verdict(F.col("p_retailprice") % 260, F.col("p_size") * 1.0, F.col("p_partkey") % 400 * 1.0, F.col("p_size") == 13)
    return p.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["quality_gate"] = "SELECT CASE WHEN p_size = 13 THEN 'empty_image' WHEN p_retailprice % 260 < 30 THEN 'too_dark' WHEN p_retailprice % 260 > 230 THEN 'too_bright' WHEN p_size < 5 THEN 'empty' WHEN p_partkey % 400 < 50 THEN 'blurry' ELSE 'ok' END AS verdict, count(*) AS n FROM part GROUP BY verdict"


@_query
def strategy_select(spark, sf_dir):
    """An order's lines are read by three strategies in turn; of one strategy's lines the dearest counts."""
    r = raw_cells(spark, sf_dir).withColumn("strategy", (F.col("col") - 1) % 3 + 1)
    one = last_by_key(r, ["puzzle", "row", "strategy"], ["price", "part", "confidence", "col"]).select("puzzle", "row", "strategy", F.when(F.col("number") <= 24, F.col("number")).alias("number"), "confidence")
    return ops.choose_strategy(one, ["puzzle", "row"])


ORACLE_SQL["strategy_select"] = f"""
WITH s AS (
  SELECT CAST(floor(l_orderkey / 12) AS BIGINT) AS puzzle, CAST(l_orderkey % 12 AS INT) AS row, CAST((l_linenumber - 1) % 3 + 1 AS INT) AS strategy, CAST(1 + l_partkey % 27 AS INT) AS number, l_discount * 10 AS confidence,
         row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) % 3 ORDER BY l_extendedprice DESC, l_partkey DESC, l_discount DESC, l_linenumber DESC) AS nth
  FROM lineitem),
r AS (
  SELECT *, row_number() OVER (PARTITION BY puzzle, row ORDER BY CASE WHEN confidence > 0.95 THEN 0 ELSE 1 END, CASE WHEN confidence > 0.95 THEN 0 ELSE -confidence END, strategy) AS i
  FROM s WHERE nth = 1 AND number <= 24)
SELECT puzzle, row, strategy, number, confidence FROM r WHERE i = 1
"""


@_query
def stratified_split(spark, sf_dir):
    """D4."""
    return ops.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


_SPLIT = """
WITH r AS (SELECT doc_id, lang, row_number() OVER ({part}ORDER BY md5('42|' || doc_id), doc_id) AS i, count(*) OVER ({over}) AS n FROM documents),
c AS (SELECT *, greatest(1, CAST(floor(0.8 * n) AS BIGINT)) AS cut FROM r)
SELECT doc_id, lang, CASE WHEN i <= CASE WHEN n >= 2 AND cut = n THEN cut - 1 ELSE cut END THEN 'train' ELSE 'val' END AS split FROM c
"""
ORACLE_SQL["stratified_split"] = _SPLIT.format(part="PARTITION BY lang ", over="PARTITION BY lang")


@_query
def plain_split(spark, sf_dir):
    """D5."""
    return ops.plain_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


ORACLE_SQL["plain_split"] = _SPLIT.format(part="", over="")


@_query
def union_counts(spark, sf_dir):
    """U1, U2, J19, A22, A23."""
    real = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 27 + 1).cast("int").alias("digit"), F.lit("high").alias("tier"))
    made = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30 + 1).cast("int").alias("digit"))
    both = ops.union_items(real, made)
    return ops.label_counts({"real": both.where("tier = 'high'"), "synthetic": both.where("tier = 'synthetic'")}, "digit")


ORACLE_SQL["union_counts"] = """
SELECT label, count(*) FILTER (part = 'r') AS real, count(*) FILTER (part = 's') AS synthetic
FROM (SELECT CAST(o_custkey % 27 + 1 AS INT) AS label, 'r' AS part FROM orders UNION ALL SELECT CAST(p_partkey % 30 + 1 AS INT), 's' FROM part) GROUP BY label
"""


@_query
def existing_files(spark, sf_dir):
    """Labels whose document exists and has the label's number of digits, left-semi and left-anti."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("n_chars >= 400")
    there = labels.join(docs, "doc_id", "left_semi").select("doc_id", F.lit("present").alias("state"))
    return there.unionByName(labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("state")))


ORACLE_SQL["existing_files"] = "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'present' END AS state FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 400) d ON d.doc_id = l.doc_id"


@_query
def output_names(spark, sf_dir):
    """K7, on the benchmark's items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", (F.length("text") % 27 + 1).cast("int").alias("digit"))
    return ops.output_names(items, "cell_", "item_id").select("item_id", "name")


ORACLE_SQL["output_names"] = "SELECT item_id, printf('cell_%05d_d%d.png', row_number() OVER (ORDER BY item_id) - 1, length(text) % 27 + 1) AS name FROM benchmark"


@_query
def running_mean(spark, sf_dir):
    """The mean of a user's values so far."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    sums = running_sums(e, "user_id", ["ts", "event_id"], {"total": F.col("value"), "n": F.col("value").isNotNull().cast("long")})
    return sums.select("event_id", F.round(F.round("total", 4) / F.col("n"), 6).alias("mean"))


ORACLE_SQL["running_mean"] = "SELECT event_id, round(round(sum(value) OVER w, 4) / count(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@_query
def exact_accuracy(spark, sf_dir):
    """Share of orders whose status is the one that their lines' dates suggest, with the 85 % gate."""
    o = table(spark, sf_dir, "orders").withColumn("guess", F.when(F.year("o_orderdate") < 1995, "F").otherwise("O"))
    return o.groupBy("o_orderpriority").agg(F.round(F.avg((F.col("guess") == F.col("o_orderstatus")).cast("int")), 9).alias("accuracy"), (F.avg((F.col("guess") == F.col("o_orderstatus")).cast("int")) >= 0.85).alias("passes"))


ORACLE_SQL["exact_accuracy"] = """
SELECT o_orderpriority, round(avg(CAST(g = o_orderstatus AS INT)), 9) AS accuracy, avg(CAST(g = o_orderstatus AS INT)) >= 0.85 AS passes
FROM (SELECT *, CASE WHEN year(o_orderdate) < 1995 THEN 'F' ELSE 'O' END AS g FROM orders) GROUP BY o_orderpriority
"""
