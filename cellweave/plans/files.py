"""Sources and sinks as queries: each writes files made of the driver's tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as cell_ops
from ..operators import compare, curation
from ..operators import mapping as maps
from ..sources import readers, writers
from ..sources.folders import fresh_folder
from .tables import CELLS_SQL, cells, raw_cells, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _truth(spark, sf_dir):
    path = fresh_folder(spark, "truth")
    writers.truth_json(cells(spark, sf_dir)).select("json").write.text(path)
    return readers.read_truth(spark, path, lines=True)


@_query
def truth_files(spark, sf_dir):
    """Grids as JSON, read again, a row per cell."""
    return readers.truth_cells(_truth(spark, sf_dir)).select(F.col("puzzle_id").cast("long").alias("puzzle_id"), "row", "col", "expected")


ORACLE_SQL["truth_files"] = f"""
WITH {CELLS_SQL} SELECT puzzle AS puzzle_id, CAST(dense_rank() OVER (PARTITION BY puzzle ORDER BY row) - 1 AS INT) AS row,
  CAST(row_number() OVER (PARTITION BY puzzle, row ORDER BY col) - 1 AS INT) AS col, number AS expected FROM cells
"""


@_query
def truth_violations(spark, sf_dir):
    """These grids have no image, type, size, range or author, which are the rules they break."""
    return curation.violations(_truth(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["truth_violations"] = f"""
WITH {CELLS_SQL}, p AS (SELECT count(DISTINCT puzzle) AS n FROM cells)
SELECT unnest(['sourceImage', 'type', 'dimensions', 'rows', 'cols', 'valueRange', 'metadata']) AS rule, n FROM p
"""


@_query
def run_files(spark, sf_dir):
    """A run per priority and month, a folder per puzzle; read in order of time."""
    o = table(spark, sf_dir, "orders")
    runs = o.groupBy(F.col("o_orderpriority").alias("puzzle_id"), F.date_format("o_orderdate", "yyyy-MM").alias("timestamp")).agg(F.round(F.avg((F.col("o_totalprice") < 200000).cast("double")), 9).alias("accuracy"))
    path = fresh_folder(spark, "runs")
    writers.write_runs(runs.select("puzzle_id", F.col("puzzle_id").alias("puzzleId"), "timestamp", F.struct("accuracy").alias("metrics")), path)
    return readers.read_history(spark, path, lines=True).select("puzzleId", "timestamp", "metrics.accuracy")


ORACLE_SQL["run_files"] = "SELECT o_orderpriority AS \"puzzleId\", strftime(o_orderdate, '%Y-%m') AS timestamp, round(avg(CAST(o_totalprice < 200000 AS DOUBLE)), 9) AS accuracy FROM orders GROUP BY ALL"


@_query
def label_files(spark, sf_dir):
    """Lines of a name and a size, every seventh with a third field, every fifth with no number."""
    p = table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))
    path = fresh_folder(spark, "labels")
    p.select(F.concat_ws(",", F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".png")), label, F.when(F.col("p_partkey") % 7 == 0, "extra"))).write.text(path)
    strict = readers.read_labels(spark, path).select("file", F.col("label").cast("string").alias("label"), F.lit("two fields").alias("reader"))
    loose = readers.read_dataset(spark, path).select("file", "label", F.lit("first comma").alias("reader"))
    return strict.unionByName(loose)


ORACLE_SQL["label_files"] = """
SELECT 'p' || p_partkey || '.png' AS file, CAST(p_size AS VARCHAR) AS label, unnest(['two fields', 'first comma']) AS reader FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0
"""


@_query
def diagnostic_files(spark, sf_dir):
    """Diagnostics as JSON, read again; cells of number 5 are not recognised."""
    path = fresh_folder(spark, "diagnostics")
    c = cells(spark, sf_dir).withColumn("number", F.when(F.col("number") != 5, F.col("number")))
    writers.diagnostic_json(c).select("json").write.text(path)
    read = readers.read_json(spark, path, readers.DIAGNOSTIC, lines=True)
    return read.groupBy("meta.recognized", "meta.total", F.size("unrecognized").alias("unread"), F.size("lowConf").alias("unsure")).agg(F.count(F.lit(1)).alias("puzzles"))


ORACLE_SQL["diagnostic_files"] = f"""
WITH {CELLS_SQL}, g AS (
  SELECT puzzle, CAST(count(*) FILTER (number <> 5) AS INT) AS recognized, CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (number = 5) AS INT) AS unread, CAST(count(*) FILTER (number <> 5 AND confidence < 0.6) AS INT) AS unsure
  FROM cells GROUP BY puzzle)
SELECT recognized, total, unread, unsure, count(*) AS puzzles FROM g GROUP BY ALL
"""


@_query
def report_files(spark, sf_dir):
    """Pseudo labels as JSON lines, read again by their schema."""
    c = raw_cells(spark, sf_dir)
    report = c.select(F.concat_ws("_", F.lit("cell"), "puzzle", "row", "col").alias("cell"), F.lit("ok").alias("status"), "number", "confidence", F.col("part").cast("string").alias("rawDigits"), curation.tier(F.col("confidence")).alias("tier"), curation.augmentations(F.col("confidence")).alias("augmentations"))
    path = fresh_folder(spark, "pseudo-labels")
    writers.write_json_report(report, path)
    return readers.read_json(spark, path, readers.PSEUDO_LABELS, lines=True).groupBy("number", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("augmentations").alias("augmentations"))


ORACLE_SQL["report_files"] = """
WITH c AS (SELECT CAST(1 + l_partkey % 27 AS INT) AS number, l_discount * 10 AS f FROM lineitem)
SELECT number, CASE WHEN f >= 0.95 THEN 'high' WHEN f >= 0.8 THEN 'med' END AS tier, count(*) AS n, CAST(sum(CASE WHEN f >= 0.95 THEN 10 WHEN f >= 0.8 THEN 5 ELSE 0 END) AS BIGINT) AS augmentations FROM c GROUP BY ALL
"""


@_query
def csv_files(spark, sf_dir):
    """K9: the eight named columns of a report with one more."""
    c = raw_cells(spark, sf_dir)
    report = c.select(F.concat_ws("_", "puzzle", "row", "col").alias("file"), F.lit("high").alias("tier"), "number", "confidence", F.lit('a "quoted", text').alias("raw_text"), F.col("part").cast("string").alias("raw_digits"), F.lit("keep").alias("action"), F.lit("").alias("reason"), F.lit("n").alias("note"))
    path = fresh_folder(spark, "csv")
    writers.write_csv_report(report, path)
    return spark.read.option("header", True).csv(path).groupBy("number", "tier", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw_digits").cast("long")).alias("digits"))


ORACLE_SQL["csv_files"] = "SELECT CAST(1 + l_partkey % 27 AS VARCHAR) AS number, 'high' AS tier, 'keep' AS action, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS digits FROM lineitem GROUP BY 1"


@_query
def mapping_files(spark, sf_dir):
    """A customer's parts map to letters; as JSON and back."""
    symbols = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.format_string("num_%03d", (F.col("o_orderkey") % 40).cast("int")).alias("symbol_id")).distinct()
    m = symbols.withColumn("letter", F.char(65 + F.substring("symbol_id", 5, 3).cast("int") % 26))
    path = fresh_folder(spark, "mappings")
    writers.mapping_json(m, "g").write.json(path)
    read = spark.read.schema("g long, json string").json(path)
    return read.select("g", F.explode(maps.import_mapping(F.col("json"))).alias("symbol_id", "letter"))


ORACLE_SQL["mapping_files"] = "SELECT DISTINCT o_custkey AS g, printf('num_%03d', CAST(o_orderkey % 40 AS INT)) AS symbol_id, chr(CAST(65 + o_orderkey % 40 % 26 AS INT)) AS letter FROM orders"


@_query
def cell_files(spark, sf_dir):
    """S12, S13, K7's tree: paths of cells by tier and digit, as a listing would give them."""
    c = raw_cells(spark, sf_dir).withColumn("tier", curation.tier(F.col("confidence")))
    paths = c.select(F.concat(F.lit("/data/"), F.coalesce("tier", F.lit("low")), F.lit("/"), F.col("number"), F.lit("/cell_r"), F.col("row"), F.lit("_c"), F.col("col"), F.lit(".png")).alias("path"))
    tiers = readers.tiered_cells(paths).join(readers.cell_images(paths).distinct(), "path")
    return tiers.groupBy("tier", "digit", "row", "col").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["cell_files"] = """
SELECT CASE WHEN l_discount * 10 >= 0.95 THEN 'high' ELSE 'med' END AS tier, CAST(1 + l_partkey % 27 AS INT) AS digit, CAST(l_orderkey % 12 AS INT) AS row, CAST(l_linenumber AS INT) AS col, count(*) AS n
FROM lineitem WHERE l_discount * 10 >= 0.8 GROUP BY ALL
"""


def _scored(spark, sf_dir):
    """Cells against themselves, where the unsure are taken for the next number and the least sure are not read."""
    c = cells(spark, sf_dir)
    read = c.select("puzzle", "row", "col", F.when(F.col("confidence") >= 0.1, F.when(F.col("confidence") < 0.3, F.col("number") % 27 + 1).otherwise(F.col("number")).cast("int")).alias("actual"), "confidence")
    return compare.compare_cells(c.select("puzzle", "row", "col", F.col("number").alias("expected")), read, cell_ops.KEY)


_SCORED = """
x AS (
  SELECT puzzle, row, col, number AS expected, CASE WHEN confidence >= 0.1 THEN CASE WHEN confidence < 0.3 THEN number % 27 + 1 ELSE number END END AS actual FROM cells),
y AS (SELECT *, CASE WHEN actual IS NULL THEN 'missed' WHEN actual = expected THEN 'correct' ELSE 'incorrect' END AS match FROM x),
m AS (
  SELECT puzzle, correct / (correct + incorrect + missed) AS accuracy, CASE WHEN correct > 0 THEN 1.0 ELSE 0.0 END AS precision, coalesce(correct / nullif(correct + missed, 0), 0.0) AS recall,
    (correct + incorrect) / (correct + incorrect + missed) AS coverage
  FROM (SELECT puzzle, count(*) FILTER (match = 'correct') AS correct, count(*) FILTER (match = 'incorrect') AS incorrect, count(*) FILTER (match = 'missed') AS missed FROM y GROUP BY puzzle))
"""


@_query
def run_report(spark, sf_dir):
    """K3: each puzzle's report: both grids and the cells that are not correct.  (The metrics' rows are compared by report_metrics.)"""
    scored = _scored(spark, sf_dir)
    return writers.run_report(scored, compare.metrics(scored, ["puzzle"]), "puzzle").where("section <> 'metrics'")


ORACLE_SQL["run_report"] = f"""
WITH {CELLS_SQL}, {_SCORED}
SELECT puzzle, 'expected' AS section, row AS place, '<tr>' || string_agg('<td>' || coalesce(CAST(expected AS VARCHAR), '') || '</td>', '' ORDER BY col) || '</tr>' AS html FROM y GROUP BY puzzle, row
UNION ALL SELECT puzzle, 'actual', row, '<tr>' || string_agg('<td>' || coalesce(CAST(actual AS VARCHAR), '') || '</td>', '' ORDER BY col) || '</tr>' FROM y GROUP BY puzzle, row
UNION ALL SELECT puzzle, 'mismatches', CAST(row_number() OVER (PARTITION BY puzzle ORDER BY row, col) - 1 AS INT),
  '<tr><td>' || row || '</td><td>' || col || '</td><td>' || expected || '</td><td>' || coalesce(CAST(actual AS VARCHAR), '') || '</td><td>' || match || '</td></tr>' FROM y WHERE match <> 'correct'
"""


@_query
def report_metrics(spark, sf_dir):
    """K3, X11: the rows of a puzzle's metrics, shares in percent."""
    scored = _scored(spark, sf_dir)
    found = writers.run_report(scored, compare.metrics(scored, ["puzzle"]), "puzzle").where("section = 'metrics'")
    cell = lambda i: F.regexp_extract("html", "^<tr><td>([^<]*)</td><td>([^<]*)%</td></tr>$", i)
    return found.select("puzzle", cell(1).alias("name"), cell(2).cast("double").alias("percent"))


ORACLE_SQL["report_metrics"] = f"""
WITH {CELLS_SQL}, {_SCORED}
SELECT puzzle, unnest(['accuracy', 'precision', 'recall', 'f1', 'coverage']) AS name, unnest([floor(accuracy * 1000 + 0.5) / 10, floor(precision * 1000 + 0.5) / 10, floor(recall * 1000 + 0.5) / 10, floor(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) * 1000 + 0.5) / 10, floor(coverage * 1000 + 0.5) / 10]) AS percent FROM m
"""


@_query
def batch_files(spark, sf_dir):
    """K2: a batch's results as JSON and its report as HTML, both read again."""
    path = fresh_folder(spark, "batch")
    # the report reads the comparison five times; it is made once
    _scored(spark, sf_dir).write.parquet(f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored")
    metrics = compare.metrics(scored, ["puzzle"])
    writers.write_batch(metrics, writers.run_report(scored, metrics, "puzzle"), path)
    results = spark.read.schema("puzzle long, correct long, accuracy double").json(f"{path}/results")
    lines = spark.read.text(f"{path}/report").agg(F.count_if(F.col("value").startswith("<tr>")).alias("lines"))
    return results.groupBy().agg(F.count(F.lit(1)).alias("puzzles"), F.sum("correct").alias("correct")).join(F.broadcast(lines), F.lit(True))  # one row each


ORACLE_SQL["batch_files"] = f"""
WITH {CELLS_SQL}, {_SCORED}
SELECT (SELECT count(*) FROM m) AS puzzles, (SELECT count(*) FROM y WHERE match = 'correct') AS correct,
  (SELECT 5 * count(*) FROM m) + 2 * (SELECT count(DISTINCT (puzzle, row)) FROM y) + (SELECT count(*) FROM y WHERE match <> 'correct') AS lines
"""
