"""Scoring predictions against a truth table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare
from .tables import CELLS_SQL, cells, raw_cells, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: a document's quality label.  Prediction: long enough; texts below 400 characters are not recognised."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("n_chars") >= 400, (F.col("n_chars") >= 1000).cast("int")).alias("actual"), (F.least(F.col("n_chars"), F.lit(2000)) / 2000).alias("confidence"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("expected"))
    return compare.compare_cells(truth, docs, ["doc_id"]).join(docs.select("doc_id", "source"), "doc_id", "left")


_SCORES = """
scored AS (
  SELECT d.doc_id, d.source, l.quality AS expected, d.actual,
         CASE WHEN l.quality IS NULL THEN 'extra' WHEN d.actual IS NULL THEN 'missed' WHEN l.quality = d.actual THEN 'correct' ELSE 'incorrect' END AS match
  FROM (SELECT doc_id, source, CASE WHEN n_chars >= 400 THEN CAST(n_chars >= 1000 AS INT) END AS actual FROM documents) d
  FULL JOIN labels l ON l.doc_id = d.doc_id
  WHERE l.quality IS NOT NULL OR d.actual IS NOT NULL),
"""
_COUNTS = "count(*) FILTER (match = 'correct') AS correct, count(*) FILTER (match = 'incorrect') AS incorrect, count(*) FILTER (match = 'missed') AS missed, count(*) FILTER (match = 'extra') AS extra, count(*) FILTER (match = 'aborted') AS aborted"
_METRICS = """
  coalesce(correct / nullif(correct + incorrect + missed, 0), 0.0) AS accuracy,
  coalesce(correct / nullif(correct + extra, 0), 0.0) AS precision,
  coalesce(correct / nullif(correct + missed, 0), 0.0) AS recall,
  coalesce(2.0 * (correct / nullif(correct + extra, 0)) * (correct / nullif(correct + missed, 0)) / nullif(correct / nullif(correct + extra, 0) + correct / nullif(correct + missed, 0), 0), 0.0) AS f1,
  coalesce((correct + incorrect) / nullif(correct + incorrect + missed, 0), 0.0) AS coverage
"""


@_query
def score_labels(spark, sf_dir):
    """The flagship."""
    return compare.metrics(_document_scores(spark, sf_dir))


ORACLE_SQL["score_labels"] = f"WITH {_SCORES} c AS (SELECT {_COUNTS} FROM scored) SELECT *, {_METRICS} FROM c"


@_query
def score_cells(spark, sf_dir):
    """The comparison itself."""
    return _document_scores(spark, sf_dir).select("doc_id", "expected", "actual", "match")


ORACLE_SQL["score_cells"] = f"WITH {_SCORES} x AS (SELECT 1) SELECT doc_id, expected, actual, match FROM scored"


@_query
def score_by_source(spark, sf_dir):
    """J1, A1 by source."""
    return compare.metrics(_document_scores(spark, sf_dir), ["source"])


ORACLE_SQL["score_by_source"] = f"WITH {_SCORES} c AS (SELECT source, {_COUNTS} FROM scored GROUP BY source) SELECT *, {_METRICS} FROM c"


@_query
def score_batch(spark, sf_dir):
    """Sources whose name ends in 9 count as aborted runs; distances are the cells that are not correct."""
    per = compare.metrics(_document_scores(spark, sf_dir), ["source"]).withColumn("edit_distance", F.col("incorrect") + F.col("missed") + F.col("extra"))
    return compare.batch_metrics(per.withColumn("aborted", F.col("source").endswith("9").cast("long")))


ORACLE_SQL["score_batch"] = f"""
WITH {_SCORES} c AS (SELECT source, {_COUNTS} FROM scored GROUP BY source),
p AS (SELECT * REPLACE (CAST(source LIKE '%9' AS BIGINT) AS aborted), incorrect + missed + extra AS d FROM c),
s AS (SELECT CAST(coalesce(sum(correct) FILTER (aborted = 0), 0) AS BIGINT) AS correct, CAST(coalesce(sum(incorrect) FILTER (aborted = 0), 0) AS BIGINT) AS incorrect,
  CAST(coalesce(sum(missed) FILTER (aborted = 0), 0) AS BIGINT) AS missed, CAST(coalesce(sum(extra) FILTER (aborted = 0), 0) AS BIGINT) AS extra,
  CAST(sum(aborted) FILTER (aborted <> 0) AS BIGINT) AS aborted, count(*) AS total_puzzles, count(*) FILTER (aborted = 0) AS scored_puzzles,
  coalesce(avg(d) FILTER (aborted = 0), 'nan'::DOUBLE) AS average_edit_distance FROM p)
SELECT *, {_METRICS} FROM s
"""


@_query
def score_macro(spark, sf_dir):
    """A3b."""
    return compare.macro_accuracy(compare.metrics(_document_scores(spark, sf_dir), ["source"])).select(F.round("macro_accuracy", 9).alias("macro_accuracy"))


ORACLE_SQL["score_macro"] = f"WITH {_SCORES} c AS (SELECT source, {_COUNTS} FROM scored GROUP BY source) SELECT round(avg(coalesce(correct / nullif(correct + incorrect + missed, 0), 0.0)), 9) AS macro_accuracy FROM c"


@_query
def batch_report(spark, sf_dir):
    """Sources by accuracy, aborted ones left out."""
    per = compare.metrics(_document_scores(spark, sf_dir), ["source"]).withColumn("aborted", F.col("source").endswith("9").cast("long"))
    return compare.batch_summary(per, "source").select("source", "accuracy", "coverage", text.percent(F.col("accuracy")).alias("shown"))


ORACLE_SQL["batch_report"] = f"WITH {_SCORES} c AS (SELECT source, {_COUNTS} FROM scored GROUP BY source) SELECT source, accuracy, coverage, printf('%.1f%%', floor(accuracy * 1000 + 0.5) / 10) AS shown FROM (SELECT *, {_METRICS} FROM c) WHERE source NOT LIKE '%9' ORDER BY accuracy DESC, source"


def _priorities(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    truth = o.select(F.col("o_orderkey").alias("key"), F.substring("o_orderpriority", 1, 1).cast("int").alias("expected"))
    guess = F.when(F.col("o_totalprice") >= 1000, (1 + (F.col("o_custkey") + F.col("o_orderkey")) % 6).cast("int"))
    return compare.compare_cells(truth, o.select(F.col("o_orderkey").alias("key"), guess.alias("actual"), F.lit(1.0).alias("confidence")), ["key"])


@_query
def score_per_label(spark, sf_dir):
    """A2: the priority's digit against a guess, over the dense domain 1..27."""
    return compare.per_label_metrics(_priorities(spark, sf_dir))


ORACLE_SQL["score_per_label"] = """
WITH c AS (
  SELECT CAST(o_orderpriority[1] AS INT) AS expected, CASE WHEN o_totalprice >= 1000 THEN CAST(1 + (o_custkey + o_orderkey) % 6 AS INT) END AS actual FROM orders),
n AS (
  SELECT d.digit, count(*) FILTER (expected = digit AND actual = digit) AS tp, count(*) FILTER (actual = digit AND expected IS DISTINCT FROM digit) AS fp,
         count(*) FILTER (expected = digit AND actual IS DISTINCT FROM digit) AS fn
  FROM (SELECT CAST(unnest(range(1, 28)) AS INT) AS digit) d LEFT JOIN c ON d.digit = c.expected OR d.digit = c.actual GROUP BY d.digit),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM n)
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pr
"""


@_query
def edit_distance_by_key(spark, sf_dir):
    """A4: the event types of a user's day in order of time against the same without the first."""
    events = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.ascii("event_type").alias("t")))).alias("e"))
    seq = events.select(F.concat_ws("#", "user_id", "day").alias("user_day"), text.sequence_string(F.transform("e", lambda x: x["t"] - 64)).alias("a"))
    return compare.edit_distances(seq.withColumn("b", F.expr("substring(a, 2)")), "user_day", "a", "b")


ORACLE_SQL["edit_distance_by_key"] = """
WITH s AS (SELECT user_id || '#' || CAST(ts AS DATE) AS user_day, string_agg(event_type[1], '' ORDER BY ts, event_id) AS a FROM events GROUP BY ALL)
SELECT user_day, CAST(levenshtein(a, a[2:]) AS INT) AS edit_distance, levenshtein(a, a[2:]) / CAST(len(a) AS DOUBLE) AS normalized FROM s
"""


@_query
def cells_dedupe_last(spark, sf_dir):
    """J1a."""
    return cells(spark, sf_dir)


ORACLE_SQL["cells_dedupe_last"] = f"WITH {CELLS_SQL} SELECT * FROM cells"


@_query
def history_trend(spark, sf_dir):
    """A clerk's share of cheap orders by day is a run's accuracy; days without a finished order are aborted."""
    o = table(spark, sf_dir, "orders")
    runs = o.groupBy(F.col("o_orderpriority").alias("key"), F.date_format("o_orderdate", "yyyy-MM").alias("timestamp")).agg(F.avg((F.col("o_totalprice") < 200000).cast("double")).alias("accuracy"), (F.count_if(F.col("o_orderstatus") == "F") == 0).alias("aborted"))
    return compare.trend(runs, "key").select("key", "timestamp", F.round("accuracy", 9).alias("accuracy"))


ORACLE_SQL["history_trend"] = """
SELECT o_orderpriority AS key, strftime(o_orderdate, '%Y-%m') AS timestamp, round(avg(CAST(o_totalprice < 200000 AS DOUBLE)), 9) AS accuracy
FROM orders GROUP BY ALL HAVING count(*) FILTER (o_orderstatus = 'F') > 0
"""


@_query
def positional_join(spark, sf_dir):
    """Order lines against the parts' list by their place in the grid."""
    c = cells(spark, sf_dir)
    expected = c.select("puzzle", "row", "col", (F.col("row") * 7 + F.col("col") - 1).alias("place"), "number")
    results = raw_cells(spark, sf_dir).groupBy("puzzle", "row", "col").agg(F.max("part").alias("part")).select("puzzle", (F.col("row") * 7 + F.col("col") - 1).alias("place"), (1 + F.col("part") % 27).cast("int").alias("read"))
    return expected.join(results, ["puzzle", "place"]).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("number") == F.col("read")).alias("same"))


ORACLE_SQL["positional_join"] = f"""
WITH {CELLS_SQL}, m AS (SELECT CAST(floor(l_orderkey / 12) AS BIGINT) AS puzzle, CAST(l_orderkey % 12 AS INT) AS row, l_linenumber AS col, max(l_partkey) AS part FROM lineitem GROUP BY ALL)
SELECT c.row, count(*) AS n, count(*) FILTER (c.number = 1 + m.part % 27) AS same FROM cells c JOIN m ON c.puzzle = m.puzzle AND c.row = m.row AND c.col = m.col GROUP BY c.row
"""
