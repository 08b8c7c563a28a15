"""Rules over cells, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digits
from ..operators import cells as ops
from .tables import CELLS_SQL, cells, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def neighbor_outliers(spark, sf_dir):
    """J7, W6."""
    return ops.drop_outliers(cells(spark, sf_dir)).where("outlier").select("puzzle", "row", "col")


ORACLE_SQL["neighbor_outliers"] = f"""
WITH {CELLS_SQL}
SELECT a.puzzle, a.row, a.col FROM cells a JOIN cells b ON a.puzzle = b.puzzle AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)
WHERE a.confidence < 0.30 GROUP BY a.puzzle, a.row, a.col, a.number HAVING count(*) >= 3 AND abs(a.number - median(b.number)) > 12
"""


@_query
def frequency_cap(spark, sf_dir):
    """W7, with a cap of 4 % so that it acts on these grids."""
    return ops.cap_frequencies(cells(spark, sf_dir), share=0.04).where("capped").select("puzzle", "row", "col", "number", "confidence")


ORACLE_SQL["frequency_cap"] = f"""
WITH {CELLS_SQL}, r AS (
  SELECT *, count(*) OVER (PARTITION BY puzzle, number) - floor(0.04 * count(*) OVER (PARTITION BY puzzle)) AS surplus,
         row_number() OVER (PARTITION BY puzzle, number ORDER BY confidence, row, col) AS place FROM cells)
SELECT puzzle, row, col, CAST(NULL AS INT) AS number, 0.0::DOUBLE AS confidence FROM r WHERE place <= surplus AND confidence < 0.6
"""


@_query
def symbol_index(spark, sf_dir):
    """A6, C10, A5."""
    return ops.symbols_from_numbers(cells(spark, sf_dir)).select("puzzle", "symbol_id", "occurrences", F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["row"], p["col"])), " ").alias("places"))


ORACLE_SQL["symbol_index"] = f"""
WITH {CELLS_SQL} SELECT puzzle, printf('num_%03d', number) AS symbol_id, CAST(count(*) AS INT) AS occurrences, string_agg(row || ':' || col, ' ' ORDER BY row, col) AS places FROM cells GROUP BY puzzle, number
"""


@_query
def puzzle_diagnostics(spark, sf_dir):
    """F2, F6, J16, A27."""
    c = cells(spark, sf_dir).withColumn("number", F.when(F.col("number") != 5, F.col("number")))
    return ops.diagnostics(c).withColumns({"true_accuracy": F.round("true_accuracy", 6), "coverage": F.round("coverage", 6)})


ORACLE_SQL["puzzle_diagnostics"] = f"""
WITH {CELLS_SQL}, c AS (SELECT * REPLACE (CASE WHEN number <> 5 THEN number END AS number) FROM cells),
g AS (SELECT puzzle, count(*) AS total, count(number) AS recognised, count(*) FILTER (number BETWEEN 1 AND 26) AS valid, count(*) FILTER (number > 26) AS invalid,
  count(*) FILTER (number BETWEEN 1 AND 26) - count(*) FILTER (number BETWEEN 1 AND 26 AND confidence < 0.6) AS truly_valid FROM c GROUP BY puzzle)
SELECT *, round(truly_valid * 100 / total, 6) AS true_accuracy, round(recognised * 100 / total, 6) AS coverage FROM g
"""


@_query
def effective_cells(spark, sf_dir):
    """overrides are the returned lines, whose value is null for a status of F."""
    c = cells(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.floor(F.col("l_orderkey") / 12).cast("long").alias("puzzle"), (F.col("l_orderkey") % 12).cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"))
    overrides = li.agg(F.max(F.when(F.col("l_linestatus") != "F", (1 + F.col("l_suppkey") % 27).cast("int"))).alias("number"))
    e = ops.with_overrides(c, overrides)
    return e.groupBy("puzzle").agg(F.count_if("overridden").alias("overridden"), F.count_if(F.col("effective").isNull()).alias("unrecognised"), F.count_if(F.col("effective").isNotNull() & ~F.col("overridden") & (F.col("confidence") < 0.6)).alias("low_confidence"), F.sum("effective").alias("sum_effective"))


ORACLE_SQL["effective_cells"] = f"""
WITH {CELLS_SQL}, o AS (
  SELECT CAST(floor(l_orderkey / 12) AS BIGINT) AS puzzle, CAST(l_orderkey % 12 AS INT) AS row, CAST(l_linenumber AS INT) AS col, max(CASE WHEN l_linestatus <> 'F' THEN 1 + l_suppkey % 27 END) AS v
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
e AS (SELECT c.puzzle, c.confidence, o.puzzle IS NOT NULL AS overridden, CASE WHEN o.puzzle IS NOT NULL THEN o.v ELSE c.number END AS effective FROM cells c LEFT JOIN o USING (puzzle, row, col))
SELECT puzzle, count(*) FILTER (overridden) AS overridden, count(*) FILTER (effective IS NULL) AS unrecognised,
  count(*) FILTER (effective IS NOT NULL AND NOT overridden AND confidence < 0.6) AS low_confidence, CAST(sum(effective) AS BIGINT) AS sum_effective FROM e GROUP BY puzzle
"""


@_query
def next_cell(spark, sf_dir):
    """Cells with an odd number can be edited."""
    shown = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(":", F.col(c)["row"], F.col(c)["col"])).alias(c)
    found = ops.next_cells(cells(spark, sf_dir).withColumn("editable", F.col("number") % 2 == 1))
    return found.select("puzzle", "row", "col", *map(shown, ("next_across", "previous_across", "next_down", "previous_down")))


ORACLE_SQL["next_cell"] = f"""
WITH {CELLS_SQL}, c AS (SELECT *, CASE WHEN number % 2 = 1 THEN row || ':' || col END AS place FROM cells)
SELECT puzzle, row, col,
  first_value(place IGNORE NULLS) OVER (PARTITION BY puzzle ORDER BY row, col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_across,
  last_value(place IGNORE NULLS) OVER (PARTITION BY puzzle ORDER BY row, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_across,
  first_value(place IGNORE NULLS) OVER (PARTITION BY puzzle, col ORDER BY row ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_down,
  last_value(place IGNORE NULLS) OVER (PARTITION BY puzzle, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_down
FROM c
"""


@_query
def progress(spark, sf_dir):
    """Numbers above 20 are not filled in; the first column holds clues."""
    c = cells(spark, sf_dir).withColumns({"editable": F.col("col") > 1, "number": F.when(F.col("number") <= 20, F.col("number"))})
    return ops.progress(c).withColumn("progress", F.round("progress", 6))


ORACLE_SQL["progress"] = f"WITH {CELLS_SQL} SELECT puzzle, round(count(*) FILTER (number <= 20) * 100 / count(*), 6) AS progress FROM cells WHERE col > 1 GROUP BY puzzle"


@_query
def path_choice(spark, sf_dir):
    """D1."""
    c = cells(spark, sf_dir).withColumn("number", F.when(F.col("confidence") >= 0.2, F.col("number")))
    return ops.choose_path(c).select("puzzle", "recognized", "total", "path")


ORACLE_SQL["path_choice"] = f"WITH {CELLS_SQL} SELECT puzzle, count(*) FILTER (confidence >= 0.2) AS recognized, count(*) AS total, CASE WHEN count(*) FILTER (confidence >= 0.2) / count(*) >= 0.7 THEN 'numbers' ELSE 'visual' END AS path FROM cells GROUP BY puzzle"


@_query
def combined_paths(spark, sf_dir):
    """The symbols of each puzzle, by numbers or, where too few are recognised, by shape (here the confidence's tenth)."""
    c = cells(spark, sf_dir)
    seen = c.withColumn("number", F.when(F.col("confidence") >= 0.3, F.col("number")))
    count = F.count(F.lit(1)).alias("n")
    numbers = seen.where("number is not null").groupBy("puzzle", F.format_string("num_%03d", "number").alias("symbol")).agg(count)
    visual = c.groupBy("puzzle", F.format_string("shape_%d", F.floor("confidence").cast("int")).alias("symbol")).agg(count)
    return ops.combine_paths(ops.choose_path(seen), numbers, visual)


ORACLE_SQL["combined_paths"] = f"""
WITH {CELLS_SQL}, p AS (SELECT puzzle, count(*) FILTER (confidence >= 0.3) / count(*) >= 0.7 AS by_number FROM cells GROUP BY puzzle)
SELECT c.puzzle, CASE WHEN by_number THEN printf('num_%03d', number) ELSE printf('shape_%d', CAST(floor(confidence) AS INT)) END AS symbol, count(*) AS n
FROM cells c JOIN p ON p.puzzle = c.puzzle WHERE NOT by_number OR confidence >= 0.3 GROUP BY ALL
"""


@_query
def image_lookup(spark, sf_dir):
    """The order lines at a cell's place are its images; the first by date counts."""
    seen = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 12).cast("long").alias("puzzle"), (F.col("l_orderkey") % 12).cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"),
        F.struct("l_shipdate", "l_suppkey", "l_partkey").alias("ord"), F.col("l_suppkey").alias("image")).where("image % 3 > 0")
    return ops.images_at(cells(spark, sf_dir), seen).select("puzzle", "row", "col", "image")


ORACLE_SQL["image_lookup"] = f"""
WITH {CELLS_SQL}, s AS (
  SELECT CAST(floor(l_orderkey / 12) AS BIGINT) AS puzzle, CAST(l_orderkey % 12 AS INT) AS row, CAST(l_linenumber AS INT) AS col, l_suppkey AS image,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_suppkey, l_partkey) AS nth
  FROM lineitem WHERE l_suppkey % 3 > 0)
SELECT c.puzzle, c.row, c.col, s.image FROM cells c LEFT JOIN s ON s.nth = 1 AND s.puzzle = c.puzzle AND s.row = c.row AND s.col = c.col
"""


@_query
def batch_status(spark, sf_dir):
    """orders of a customer are images, their status the image's."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return ops.status_counts(o.select(F.col("o_custkey").alias("batch"), status.alias("status")), "batch")


ORACLE_SQL["batch_status"] = """
SELECT o_custkey AS batch, count(*) FILTER (o_orderstatus = 'O') AS pending, CAST(0 AS BIGINT) AS processing, count(*) FILTER (o_orderstatus = 'F') AS done,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS error, count(*) AS total, CAST(floor(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*) + 0.5) AS INT) AS percent
FROM orders GROUP BY o_custkey
"""


@_query
def least_sure_cells(spark, sf_dir):
    """T7."""
    return ops.least_sure(cells(spark, sf_dir), 0.2).select("puzzle", "row", "col", "number", "confidence")


ORACLE_SQL["least_sure_cells"] = f"WITH {CELLS_SQL} SELECT puzzle, row, col, number, confidence FROM cells WHERE confidence < 0.2 ORDER BY confidence, puzzle, row, col"


@_query
def chunked_cells(spark, sf_dir):
    """Batches of 16, odd and even ones read apart and appended."""
    b = ops.micro_batches(cells(spark, sf_dir))
    both = ops.append_chunks([b.where("batch % 2 = 0"), b.where("batch % 2 = 1")])
    return both.groupBy("puzzle", "batch").agg(F.count(F.lit(1)).alias("cells"), F.sum("number").alias("numbers"))


ORACLE_SQL["chunked_cells"] = f"""
WITH {CELLS_SQL}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY puzzle ORDER BY row, col) - 1) // 16 AS INT) AS batch FROM cells)
SELECT puzzle, batch, count(*) AS cells, CAST(sum(number) AS BIGINT) AS numbers FROM b GROUP BY puzzle, batch
"""


@_query
def word_cells(spark, sf_dir):
    """Letters of the benchmark's texts; DuckDB keeps a sharp s, so its SQL spells it out."""
    return ops.words(table(spark, sf_dir, "benchmark"), "item_id", "text").groupBy("item_id", "letter").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))


ORACLE_SQL["word_cells"] = """
WITH l AS (SELECT item_id, string_split(upper(replace(text, 'ß', 'SS')), '') AS l FROM benchmark), u AS (SELECT item_id, unnest(l) AS letter, CAST(generate_subscripts(l, 1) - 1 AS INT) AS place FROM l)
SELECT item_id, letter, count(*) AS n, min(place) AS first FROM u WHERE letter <> '' GROUP BY item_id, letter
"""


@_query
def early_abort(spark, sf_dir):
    """R2 in batch: a user's events in order of time; purchases and signups are recognised."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("puzzle"), F.struct("ts", "event_id").alias("ord"), F.when(F.col("event_type").isin("purchase", "signup"), 1).alias("number"))
    return ops.early_abort(e)


ORACLE_SQL["early_abort"] = """
WITH r AS (
  SELECT user_id AS puzzle, row_number() OVER w AS read, count(*) OVER (PARTITION BY user_id) AS total, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS k,
         sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER w AS known
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT puzzle, max(total) AS total, min(read) FILTER ((read % 16 = 0 OR read = total) AND read >= 10 AND known / read < 0.25) AS stopped_at, CAST(sum(k) AS BIGINT) AS n FROM r GROUP BY puzzle)
SELECT puzzle, total, stopped_at, CASE WHEN stopped_at IS NULL THEN n ELSE 0 END AS recognized, stopped_at IS NOT NULL AS aborted FROM s
"""


@_query
def point_updates(spark, sf_dir):
    """The lines of later orders overwrite cells of the grid; the last of a cell wins."""
    log = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 12).cast("long").alias("puzzle"), (F.col("l_orderkey") % 12).cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"), F.struct("l_shipdate", "l_suppkey", "l_partkey").alias("at"), (1 + F.col("l_suppkey") % 27).cast("int").alias("number")).where(F.year("at.l_shipdate") >= 1997)
    return ops.update_cells(cells(spark, sf_dir), log).select("puzzle", "row", "col", "number")


ORACLE_SQL["point_updates"] = f"""
WITH {CELLS_SQL}, u AS (
  SELECT CAST(floor(l_orderkey / 12) AS BIGINT) AS puzzle, CAST(l_orderkey % 12 AS INT) AS row, l_linenumber AS col, 1 + l_suppkey % 27 AS v,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC) AS nth
  FROM lineitem WHERE year(l_shipdate) >= 1997)
SELECT c.puzzle, c.row, c.col, CAST(coalesce(u.v, c.number) AS INT) AS number FROM cells c LEFT JOIN u ON u.nth = 1 AND u.puzzle = c.puzzle AND u.row = c.row AND u.col = c.col
"""


@_query
def word_scores(spark, sf_dir):
    """A29, A30."""
    c = cells(spark, sf_dir).withColumn("expected", (1 + (F.col("puzzle") + F.col("col")) % 27).cast("int")).withColumn("expected", F.when(F.col("confidence") < 0.5, F.col("expected")).otherwise(F.col("number")))
    return ops.word_scores(c).join(ops.bounding_box(c), "puzzle")


ORACLE_SQL["word_scores"] = f"""
WITH {CELLS_SQL}, w AS (SELECT puzzle, row, count(*) FILTER (confidence >= 0.5 OR number = 1 + (puzzle + col) % 27) AS r, count(*) AS l, max(col) AS c FROM cells GROUP BY puzzle, row)
SELECT puzzle, CAST(sum(r) AS BIGINT) AS "right", CAST(sum(l) AS BIGINT) AS letters, count(*) FILTER (r = l) AS words_done, max(row) AS rows, max(c) AS cols FROM w GROUP BY puzzle
"""


@_query
def fix_spurious(spark, sf_dir):
    """X2, F1, X3 on part keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 130 - 5).cast("int").alias("n"))
    return p.select("p_partkey", digits.fix_spurious(F.col("n")).alias("fixed"), digits.sanitize_number(F.concat(F.lit("#"), F.col("n").cast("string"))).alias("read"), digits.range_reason(F.col("n")).alias("reason"))


ORACLE_SQL["fix_spurious"] = """
WITH p AS (SELECT p_partkey, CAST(p_partkey % 130 - 5 AS INT) AS n, left(replace(CAST(p_partkey % 130 - 5 AS VARCHAR), '-', ''), 2) AS d FROM part),
q AS (SELECT *, TRY_CAST(d AS INT) AS v, TRY_CAST(d[1] AS INT) AS a, TRY_CAST(nullif(d[2], '') AS INT) AS b FROM p)
SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 27 THEN n WHEN n BETWEEN 10 AND 99 THEN n // 10 END AS fixed,
  CASE WHEN v BETWEEN 1 AND 27 THEN v WHEN len(d) = 2 THEN CASE WHEN a BETWEEN 1 AND 27 THEN a WHEN b BETWEEN 1 AND 27 THEN b END END AS read,
  CASE WHEN n < 1 THEN 'Value ' || n || ' < 1 (invalid)' WHEN n > 26 THEN 'Value ' || n || ' > 26 (likely OCR error)' END AS reason FROM q
"""


@_query
def saved_puzzles(spark, sf_dir):
    """a customer's saved order is the last one before 1997; those who order later have it replaced, or get one, by their last order of all."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    last = lambda df: df.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o")).select("o_custkey", "o.*")
    return ops.upsert(last(o.where(F.year("o_orderdate") < 1997)), last(o.where(F.year("o_orderdate") >= 1997)), "o_custkey")


ORACLE_SQL["saved_puzzles"] = """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1
"""
