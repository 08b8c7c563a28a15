"""Boxes, lines and crops as queries: parts, customers and suppliers stand for shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as ops
from .tables import CELLS_SQL, cells, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _boxes(spark, sf_dir):
    """200 parts are the boxes of an image."""
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 200).cast("long").alias("k"), F.col("p_partkey").alias("ord"), (F.col("p_size") * (20 + F.col("p_partkey") % 17) * 0.8).alias("area"), (3 + F.col("p_partkey") % 4).alias("vertices"), (F.col("p_size") * 1.0).alias("width"), (20 + F.col("p_partkey") % 17).cast("double").alias("height"), (F.col("p_partkey") % 300).cast("double").alias("x"))


_BOXES = "b AS (SELECT p_partkey // 200 AS k, p_partkey AS ord, p_size * (20 + p_partkey % 17) * 0.8::DOUBLE AS area, 3 + p_partkey % 4 AS vertices, CAST(p_size AS DOUBLE) AS width, CAST(20 + p_partkey % 17 AS DOUBLE) AS height, CAST(p_partkey % 300 AS DOUBLE) AS x FROM part)"


@_query
def contour_filter(spark, sf_dir):
    """F14, A9."""
    return ops.contour_filter(_boxes(spark, sf_dir), "k", 10_000).select("k", "ord", "box")


ORACLE_SQL["contour_filter"] = f"""
WITH {_BOXES}, f AS (SELECT *, width * height AS box FROM b WHERE area BETWEEN 50 AND 5000 AND vertices BETWEEN 4 AND 6 AND width / greatest(height, 1) BETWEEN 1 / 2.5::DOUBLE AND 2.5 AND area / (width * height) >= 0.7),
s AS (SELECT k, min(box) AS lo, max(box) AS hi FROM f GROUP BY k),
h AS (SELECT f.k, lo, hi, CASE WHEN hi > lo THEN CAST(least(floor((box - lo) / (hi - lo) * 20), 19) AS INT) ELSE 0 END AS b, count(*) AS n FROM f JOIN s ON f.k = s.k GROUP BY ALL),
m AS (SELECT k, CASE WHEN hi > lo THEN lo + (b + 0.5::DOUBLE) * (hi - lo) / 20 ELSE lo END AS modal FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, b) AS i FROM h) WHERE i = 1)
SELECT f.k, ord, box FROM f JOIN m ON f.k = m.k WHERE box BETWEEN modal * 0.35::DOUBLE AND modal * 2.8::DOUBLE
"""


@_query
def column_edges(spark, sf_dir):
    """Boxes within 12 pixels of the middles of every 30."""
    b = _boxes(spark, sf_dir)
    centres = b.select("k").distinct().select("k", F.explode(F.transform(F.sequence(F.lit(15), F.lit(300), F.lit(30)), lambda c: c.cast("double"))).alias("centre"))
    return ops.column_edges(b, centres, "k", 12)


ORACLE_SQL["column_edges"] = f"""
WITH {_BOXES}, c AS (SELECT DISTINCT k, CAST(v AS DOUBLE) AS centre FROM b, (SELECT unnest(range(15, 301, 30)) AS v)),
g AS (SELECT b.k, centre, list_sort(list(x)) AS l, list_sort(list(x + width)) AS r, count(*) AS boxes FROM b JOIN c ON b.k = c.k AND abs(x + width / 2 - centre) <= 12 GROUP BY b.k, centre)
SELECT k, centre, l[CAST(floor(boxes * 0.1::DOUBLE) AS INT) + 1] AS "left", r[CAST(floor(boxes * 0.9::DOUBLE) AS INT) + 1] AS "right", boxes FROM g
"""


@_query
def corner_order(spark, sf_dir):
    """A nation's customers are points."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("ord"), F.floor("c_acctbal").alias("x"), (F.col("c_custkey") % 997).alias("y"))
    o = ops.corner_order(c, "k")
    return o.select("k", *[F.col(f"{n}.{a}").alias(f"{n}_{a}") for n in ("top_left", "top_right", "bottom_right", "bottom_left") for a in "xy"])


ORACLE_SQL["corner_order"] = """
WITH c AS (SELECT c_nationkey AS k, c_custkey AS o, CAST(floor(c_acctbal) AS BIGINT) AS x, c_custkey % 997 AS y FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x + y, o) AS a, row_number() OVER (PARTITION BY k ORDER BY y - x, o) AS b, row_number() OVER (PARTITION BY k ORDER BY x + y DESC, o) AS c, row_number() OVER (PARTITION BY k ORDER BY y - x DESC, o) AS d FROM c)
SELECT k, max(x) FILTER (a = 1) AS top_left_x, max(y) FILTER (a = 1) AS top_left_y, max(x) FILTER (b = 1) AS top_right_x, max(y) FILTER (b = 1) AS top_right_y,
  max(x) FILTER (c = 1) AS bottom_right_x, max(y) FILTER (c = 1) AS bottom_right_y, max(x) FILTER (d = 1) AS bottom_left_x, max(y) FILTER (d = 1) AS bottom_left_y FROM r GROUP BY k
"""


@_query
def crop_boxes(spark, sf_dir):
    """Crops of parts as cells of a 500 by 400 image."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 480 + 0.5).alias("x0"), (F.col("p_partkey") % 480 + F.col("p_size")).alias("x1"), (F.col("p_size") * 7.5).alias("y0"), (F.col("p_size") * 7.5 + 25).alias("y1"))
    crop, even = ops.crop_box(*[F.col(c) for c in ("x0", "x1", "y0", "y1")], 500, 400), ops.even_crop(F.col("p_partkey") % 12, F.col("p_partkey") % 8, 12, 8, 500, 400)
    return p.select("p_partkey", crop.alias("c"), even.alias("e")).select("p_partkey", F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.width").alias("width"), F.col("c.height").alias("height"), F.col("e.x").alias("even_x"), F.col("e.y").alias("even_y"))


ORACLE_SQL["crop_boxes"] = """
WITH p AS (SELECT p_partkey, CAST(floor(p_partkey % 480 + 1) AS BIGINT) AS xs, CAST(p_partkey % 480 + p_size AS BIGINT) AS xe, CAST(floor(p_size * 7.5::DOUBLE + 0.5) AS BIGINT) AS ys, CAST(floor(p_size * 7.5::DOUBLE + 25.5) AS BIGINT) AS ye FROM part),
m AS (SELECT *, greatest(1, CAST(floor((xe - xs) * 0.02::DOUBLE + 0.5) AS BIGINT)) AS mx, greatest(1, CAST(floor((ye - ys) * 0.03::DOUBLE + 0.5) AS BIGINT)) AS my FROM p),
l AS (SELECT *, greatest(0, least(xs + mx, 499)) AS l, greatest(0, least(ys + my, 399)) AS t FROM m),
c AS (SELECT *, greatest(l + 1, least(xe - mx, 500)) - l AS w, greatest(t + 1, least(ye - my, 400)) - t AS h FROM l)
SELECT p_partkey, CASE WHEN w > 4 AND h > 4 THEN l END AS x, CASE WHEN w > 4 AND h > 4 THEN t END AS y, CASE WHEN w > 4 AND h > 4 THEN w END AS width, CASE WHEN w > 4 AND h > 4 THEN h END AS height,
  CAST(floor(40 + (p_partkey % 8 + 0.25::DOUBLE) * (420 / 8)) AS BIGINT) AS even_x, CAST(floor(12 + (p_partkey % 12 + 0.25::DOUBLE) * (376 / 12)) AS BIGINT) AS even_y FROM c
"""


@_query
def highlighted_letters(spark, sf_dir):
    """200 parts, in order, give the letters of a word."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 200).cast("long").alias("k"), F.col("p_partkey").alias("ord"), F.upper("p_type").alias("answer"))
    return ops.highlight_letters(p, "k", F.lit("STEEL"))


ORACLE_SQL["highlighted_letters"] = """
WITH w AS (SELECT p_partkey // 200 AS k, p_partkey AS ord, upper(p_type) AS a, row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) AS i FROM part),
f AS (SELECT k, list_reduce(list({'next': 1, 'hits': [{'ord': ord, 'place': -1}], 'a': a} ORDER BY i) , lambda s, x: CASE WHEN s.next <= 5 AND instr(x.a, 'STEEL'[s.next]) > 0 THEN {'next': s.next + 1, 'hits': s.hits || [{'ord': x.hits[1].ord, 'place': CAST(instr(x.a, 'STEEL'[s.next]) - 1 AS INT)}], 'a': ''} ELSE s END, {'next': 1, 'hits': [{'ord': CAST(0 AS BIGINT), 'place': -1}], 'a': ''}) AS s FROM w GROUP BY k)
SELECT k, h.ord AS ord, h.place AS place FROM (SELECT k, unnest(s.hits[2:]) AS h FROM f)
"""


@_query
def largest_shapes(spark, sf_dir):
    """T10, T9, F7."""
    b = _boxes(spark, sf_dir)
    top = ops.top_per_key(b, "k", [F.desc("area"), F.col("ord")], 5).select("k", "rank", "ord", ops.confidence_band(F.col("area") / 10).alias("band"))
    return top.join(ops.largest(b, "k").select("k", F.col("ord").alias("first")), "k")


ORACLE_SQL["largest_shapes"] = f"""
WITH {_BOXES}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY area DESC, ord) AS INT) AS rank FROM b)
SELECT k, rank, ord, CASE WHEN area / 10 >= 80 THEN 'High' WHEN area / 10 >= 50 THEN 'Medium' ELSE 'Low' END AS band, first_value(ord) OVER (PARTITION BY k ORDER BY rank) AS first FROM r WHERE rank <= 5
"""


@_query
def random_hint(spark, sf_dir):
    """Numbers above 20 are not filled in."""
    return ops.random_hint(cells(spark, sf_dir).withColumn("number", F.when(F.col("number") <= 20, F.col("number"))), "puzzle")


ORACLE_SQL["random_hint"] = f"WITH {CELLS_SQL} SELECT puzzle, row, col FROM (SELECT *, row_number() OVER (PARTITION BY puzzle ORDER BY md5('42|' || puzzle || '|' || row || '|' || col)) AS i FROM cells WHERE number > 20) WHERE i = 1"


@_query
def extended_lines(spark, sf_dir):
    """Long lines, made to cross the whole image at their middles."""
    from ..functions.geometry import line_kind

    point = lambda *xs: F.struct(*[x.cast("double").alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), xs)])
    h = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), point(F.lit(0), F.col("c_custkey") % 500, F.col("c_custkey") % 700, F.col("c_custkey") % 500 + F.col("c_custkey") % 7).alias("line"))
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), point(F.col("s_suppkey") % 900, F.lit(0), F.col("s_suppkey") % 900 + F.col("s_suppkey") % 5, F.lit(1000)).alias("line"))
    both = ops.extend_lines(ops.long_lines(h.unionByName(v), 1000, 1000), 1000, 1000)
    crossings = ops.midpoint_crossings(both.withColumn("kind", line_kind(F.col("line"))), "k")
    return crossings.groupBy("k").agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


ORACLE_SQL["extended_lines"] = """
WITH h AS (SELECT c_nationkey AS k, CAST(floor((c_custkey % 500 + c_custkey % 500 + c_custkey % 7) / 2 + 0.5) AS BIGINT) AS y FROM customer WHERE sqrt(pow(c_custkey % 700, 2) + pow(c_custkey % 7, 2)) >= 300),
v AS (SELECT s_nationkey AS k, CAST(floor((s_suppkey % 900 + s_suppkey % 900 + s_suppkey % 5) / 2 + 0.5) AS BIGINT) AS x FROM supplier)
SELECT h.k, count(*) AS points, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM h JOIN v ON h.k = v.k GROUP BY h.k
"""


@_query
def table_points(spark, sf_dir):
    """The crossing points of each puzzle's row and column positions, 10 and 8 pixels apart."""
    c = cells(spark, sf_dir)
    grid = c.groupBy("puzzle").agg(F.array_sort(F.collect_set(F.col("row") * 10)).alias("row_positions"), F.array_sort(F.collect_set(F.col("col") * 8)).alias("col_positions"))
    points = ops.table_structure(grid).select("puzzle", F.posexplode("points").alias("line", "row")).select("puzzle", "line", F.posexplode("row").alias("place", "p"))
    return points.select("puzzle", "line", "place", "p.x", "p.y")


ORACLE_SQL["table_points"] = f"""
WITH {CELLS_SQL}, r AS (SELECT DISTINCT puzzle, row FROM cells), c AS (SELECT DISTINCT puzzle, col FROM cells)
SELECT r.puzzle, CAST(dense_rank() OVER (PARTITION BY r.puzzle ORDER BY row) - 1 AS INT) AS line, CAST(dense_rank() OVER (PARTITION BY r.puzzle ORDER BY col) - 1 AS INT) AS place, CAST(col * 8 AS INT) AS x, CAST(row * 10 AS INT) AS y
FROM r JOIN c ON c.puzzle = r.puzzle
"""
