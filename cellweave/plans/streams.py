"""Queries that run Structured Streaming, and the events of stages and micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import progress as ops
from ..operators.cells import choose_path
from ..operators.compare import last_by_key
from ..operators.running import numbered
from ..streaming.early_abort import replayed
from .tables import CELLS_SQL, raw_cells, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def early_abort_stream(spark, sf_dir):
    """R2, E3 as a stream: a user's events are cells in order of time that arrive out of order; purchases and signups are recognised."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("puzzle"), "ts", "event_id", F.col("event_type").isin("purchase", "signup").alias("recognised"))
    return replayed(numbered(e, "puzzle", ["ts", "event_id"]).select("puzzle", "nth", "recognised"))


ORACLE_SQL["early_abort_stream"] = """
WITH r AS (
  SELECT user_id AS puzzle, row_number() OVER w AS read, count(*) OVER (PARTITION BY user_id) AS total, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS k,
         sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER w AS known
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT puzzle, min(read) FILTER ((read % 16 = 0 OR read = total) AND read >= 10 AND known / read < 0.25) AS stopped_at, CAST(sum(k) AS BIGINT) AS n FROM r GROUP BY puzzle)
SELECT puzzle, stopped_at, CASE WHEN stopped_at IS NULL THEN n ELSE 0 END AS recognized, stopped_at IS NOT NULL AS aborted FROM s
"""


@_query
def stage_progress(spark, sf_dir):
    """The stages' events, with the cells that each stage passed on and recognised, as observed while it was written."""
    stages = {
        "preprocessing": lambda c: c.where("number <= 26"),
        "gridDetection": lambda c: last_by_key(c, ["puzzle", "row", "col"], ["price", "part", "confidence"]),
        "cellExtraction": lambda c: c.withColumn("number", F.when(F.col("confidence") >= 0.25, F.col("number"))),
        "classification": lambda c: c.join(choose_path(c, 0.70).where("path = 'numbers'").select("puzzle"), "puzzle", "left_semi"),
        "clueOCR": lambda c: c.where("col > 1"),
    }
    events = []
    counts = {"processed": F.count(F.lit(1)), "recognized": F.count("number")}
    ops.run_stages(raw_cells(spark, sf_dir), stages, counts, lambda *event: events.append(event))
    return spark.createDataFrame(events, ops.EVENT).select("stage", "progress", *[F.col("rows")[n].alias(n) for n in counts])


ORACLE_SQL["stage_progress"] = f"""
WITH {CELLS_SQL.replace("FROM lineitem", "FROM lineitem WHERE 1 + l_partkey % 27 <= 26", 1)},
a AS (SELECT count(*) AS processed, count(*) AS recognized FROM raw_cells),
b AS (SELECT count(*) AS processed, count(*) AS recognized FROM cells),
x AS (SELECT *, CASE WHEN confidence >= 0.25 THEN 1 END AS known FROM cells),
c AS (SELECT count(*) AS processed, count(known) AS recognized FROM x),
y AS (SELECT * FROM x WHERE puzzle IN (SELECT puzzle FROM x GROUP BY puzzle HAVING count(known) / count(*) >= 0.70)),
d AS (SELECT count(*) AS processed, count(known) AS recognized FROM y),
e AS (SELECT count(*) AS processed, count(known) AS recognized FROM y WHERE col > 1)
SELECT 'preprocessing' AS stage, 10 AS progress, NULL AS processed, NULL AS recognized UNION ALL SELECT 'preprocessing', 25, * FROM a
UNION ALL SELECT 'gridDetection', 25, NULL, NULL UNION ALL SELECT 'gridDetection', 45, * FROM b
UNION ALL SELECT 'cellExtraction', 45, NULL, NULL UNION ALL SELECT 'cellExtraction', 70, * FROM c
UNION ALL SELECT 'classification', 70, NULL, NULL UNION ALL SELECT 'classification', 85, * FROM d
UNION ALL SELECT 'clueOCR', 85, NULL, NULL UNION ALL SELECT 'clueOCR', 100, * FROM e
"""


@_query
def stream_progress(spark, sf_dir):
    """What the micro-batches of a stream of events reported to a listener, summed, beside what reached the table."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kinds = ("click", "error", "purchase", "signup", "view")
    counts = {k: F.count_if(F.col("event_type") == k) for k in kinds} | {"all": F.count(F.lit(1))}
    written, events = ops.stream_events(e, counts, f"progress-{uuid.uuid4().hex}")
    reported = {k: sum(found[k] for _, _, found in events) for k in counts}
    heard = spark.createDataFrame([*reported.items()], "event_type string, reported long")
    there = written.groupBy("event_type").agg(F.count(F.lit(1)).alias("written")).unionByName(written.agg(F.lit("all").alias("event_type"), F.count(F.lit(1)).alias("written")))
    return heard.join(there, "event_type", "left").select("event_type", "reported", F.coalesce("written", F.lit(0)).alias("written"))


ORACLE_SQL["stream_progress"] = """
WITH k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, coalesce(n, 0) AS reported, coalesce(n, 0) AS written FROM k LEFT JOIN n USING (event_type)
UNION ALL SELECT 'all', count(*), count(*) FROM events
"""
