"""Images as queries: embeddings are pictures of 8 by 8, 64 of them are a photo that is written and read as a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import pictures as ops
from ..sources.folders import fresh_folder
from ..sources.images import read_images, write_drawn, write_images
from .tables import CELLS_SQL, HOURS_SQL, cells, hours, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SIDE = 8


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _pixels(spark, sf_dir):
    """(vec_id, pixels): bytes of each embedding, half way at 0; null, short and non-finite ones are black."""
    e = F.col("embedding")
    whole = (F.size(e) == SIDE * SIDE) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    grey = F.transform(e, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 2 + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.when(whole, grey).otherwise(F.array_repeat(F.lit(0), SIDE * SIDE)).alias("pixels"))


_PIXELS = f"""
pic AS (
  SELECT vec_id, label, CASE WHEN len(embedding) = {SIDE * SIDE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    THEN list_transform(embedding, lambda x: CAST(floor(least(greatest(CAST(x AS DOUBLE) * 2 + 0.5, 0.0), 1.0) * 255) AS INT)) ELSE list_transform(range({SIDE * SIDE}), lambda i: 0) END AS px
  FROM embeddings),
dot AS (SELECT vec_id, i // {SIDE} AS y, i % {SIDE} AS x, i, v FROM (SELECT vec_id, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM pic))"""


def _photos(spark, sf_dir):
    """Photos of 64 pictures, written by tasks with a broken file beside each, and read back as images."""
    folder = fresh_folder(spark, "photos")
    sheets = ops.sheets(_pixels(spark, sf_dir), SIDE)
    broken = sheets.select(F.concat(F.lit("broken-"), "name").alias("name"), "width", F.lit(None).cast("binary").alias("pixels"))
    write_images(sheets.unionByName(broken), folder).write.format("noop").mode("overwrite").save()
    return read_images(spark, folder)


@_query
def photo_files(spark, sf_dir):
    """Pictures through files and the image source; files that are no image are dropped."""
    found = ops.cut_sheets(_photos(spark, sf_dir), SIDE)
    total = F.aggregate(F.transform("pixels", lambda x: x.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.groupBy("sheet").agg(F.count_if(total > 0).alias("pictures"), F.sum(total).alias("brightness"), F.sum(total * F.col("place")).alias("moment"))


ORACLE_SQL["photo_files"] = f"""
WITH {_PIXELS}, s AS (SELECT vec_id // 64 AS sheet, vec_id % 64 AS place, CAST(list_sum(px) AS BIGINT) AS t FROM pic)
SELECT sheet, count(*) FILTER (t > 0) AS pictures, CAST(sum(t) AS BIGINT) AS brightness, CAST(sum(t * place) AS BIGINT) AS moment FROM s GROUP BY sheet
"""


@_query
def picture_parts(spark, sf_dir):
    """P7b, P7e, P7f: the largest connected part of each picture of a photo: area, box, perimeter and outline."""
    return ops.largest_parts(ops.cut_sheets(_photos(spark, sf_dir), SIDE).select((F.col("sheet") * 64 + F.col("place")).alias("vec_id"), "pixels"), SIDE, above=127)


ORACLE_SQL["picture_parts"] = f"""
WITH RECURSIVE {_PIXELS}, ink AS (SELECT * FROM dot WHERE v > 127),
touch AS (SELECT a.vec_id, a.i AS a, b.i AS b FROM ink a JOIN ink b ON b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach(vec_id, i, o) AS (SELECT vec_id, i, i FROM ink UNION SELECT r.vec_id, r.i, t.b FROM reach r JOIN touch t ON t.vec_id = r.vec_id AND t.a = r.o),
part AS (SELECT vec_id, i, min(o) AS part FROM reach GROUP BY vec_id, i),
side AS (SELECT a.vec_id, a.i, 4 - count(b.i) AS sides FROM ink a LEFT JOIN ink b ON b.vec_id = a.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.vec_id, a.i),
p AS (
  SELECT part.vec_id, part, count(*) AS area, min(i // {SIDE}) AS top, min(i % {SIDE}) AS "left", max(i // {SIDE}) AS bottom, max(i % {SIDE}) AS "right", sum(sides) AS perimeter,
    string_agg(CAST(i AS VARCHAR), ' ' ORDER BY i) FILTER (sides > 0) AS outline, count(*) OVER (PARTITION BY part.vec_id) AS parts
  FROM part JOIN side USING (vec_id, i) GROUP BY part.vec_id, part)
SELECT vec_id, CAST(parts AS INT) AS parts, CAST(area AS INT) AS area, CAST(top AS INT) AS top, CAST("left" AS INT) AS "left", CAST(bottom AS INT) AS bottom, CAST("right" AS INT) AS "right", CAST(perimeter AS INT) AS perimeter, outline
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, part) AS n FROM p) WHERE n = 1
"""


@_query
def picture_edges(spark, sf_dir):
    """P1h: the edges of each picture, as the numbers of their pixels."""
    return ops.edge_pixels(_pixels(spark, sf_dir).select("vec_id", "pixels"), SIDE, low=50, high=150)


ORACLE_SQL["picture_edges"] = f"""
WITH RECURSIVE {_PIXELS},
near AS (SELECT d.vec_id, d.i, d.y, d.x, dy, dx, n.v FROM dot d CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx)
  JOIN dot n ON n.vec_id = d.vec_id AND n.y = greatest(0, least({SIDE - 1}, d.y + dy)) AND n.x = greatest(0, least({SIDE - 1}, d.x + dx))),
grad AS (SELECT vec_id, i, y, x, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy FROM near GROUP BY ALL),
g AS MATERIALIZED (SELECT *, abs(gx) + abs(gy) AS size, abs(gy) < 13573 / 32768 * abs(gx) AS flat, abs(gy) > (13573 / 32768 + 2) * abs(gx) AS steep, (gx < 0) <> (gy < 0) AS falling FROM grad),
dir AS (SELECT *, CASE WHEN flat THEN 0 ELSE 1 END AS dy, CASE WHEN flat THEN 1 WHEN steep THEN 0 WHEN falling THEN -1 ELSE 1 END AS dx FROM g),
weak AS MATERIALIZED (
  SELECT d.vec_id, d.i, d.y, d.x, d.size FROM dir d LEFT JOIN g a ON a.vec_id = d.vec_id AND a.y = d.y - d.dy AND a.x = d.x - d.dx LEFT JOIN g b ON b.vec_id = d.vec_id AND b.y = d.y + d.dy AND b.x = d.x + d.dx
  WHERE d.size > coalesce(a.size, 0) AND d.size >= coalesce(b.size, 0) AND d.size > 50),
kept(vec_id, i, y, x) AS (SELECT vec_id, i, y, x FROM weak WHERE size > 150 UNION SELECT w.vec_id, w.i, w.y, w.x FROM kept k JOIN weak w ON w.vec_id = k.vec_id AND abs(w.y - k.y) <= 1 AND abs(w.x - k.x) <= 1),
found AS (SELECT vec_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY i) AS edge FROM kept GROUP BY vec_id)
SELECT pic.vec_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(edge, '') AS edge FROM pic LEFT JOIN found USING (vec_id)
"""


@_query
def line_votes(spark, sf_dir):
    """Straight lines through a user's busy hours, hours of the day across and days down, by votes for angle and distance."""
    h = hours(spark, sf_dir).where("amplitude > 0").select("user_id", (F.col("pos") % 24).alias("x"), (F.floor(F.col("pos") / 24) % 64).alias("y"))
    return ops.voted_lines(h, "user_id", angles=36, least=4, apart=2)


_ANGLES = ", ".join(f"({t}, {c!r}, {s!r})" for t, c, s in ops.angle_table(36))
ORACLE_SQL["line_votes"] = f"""
WITH {HOURS_SQL}, a(angle, c, s) AS (VALUES {_ANGLES}),
v AS MATERIALIZED (SELECT user_id, angle, CAST(floor(pos % 24 * CAST(c AS DOUBLE) + pos // 24 % 64 * CAST(s AS DOUBLE) + 0.5) AS BIGINT) AS rho, count(*) AS votes FROM hours CROSS JOIN a GROUP BY ALL HAVING count(*) >= 4)
SELECT user_id, angle, rho, votes FROM v WHERE NOT EXISTS (
  SELECT 1 FROM v o WHERE o.user_id = v.user_id AND abs(o.angle - v.angle) <= 2 AND abs(o.rho - v.rho) <= 2 AND (o.votes, -o.angle, -o.rho) > (v.votes, -v.angle, -v.rho))
"""


@_query
def augmented_pictures(spark, sf_dir):
    """Every label is filled up to as many pictures as the most frequent has, by copies moved, dimmed and made noisy by draws of their names."""
    return ops.filled_up(_pixels(spark, sf_dir), SIDE).select("label", "vec_id", "copy", F.sha2(F.array_join(F.transform("pixels", lambda x: x.cast("string")), " "), 256).alias("digest"))


_DRAW = "CAST('0x' || substr(md5('{what}:' || vec_id || ':' || copy), 1, 8) AS BIGINT)"
ORACLE_SQL["augmented_pictures"] = f"""
WITH {_PIXELS}, n AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM pic GROUP BY label),
r AS (SELECT pic.*, row_number() OVER (PARTITION BY label ORDER BY md5('order:' || vec_id), vec_id) - 1 AS nth FROM pic),
c AS (SELECT r.vec_id, r.label, r.px, unnest(range(0, 1 + CASE WHEN nth < (most - n) % n THEN (most - n) // n + 1 ELSE (most - n) // n END)) AS copy FROM r JOIN n ON n.label IS NOT DISTINCT FROM r.label),
d AS (SELECT *, CASE WHEN copy > 0 THEN {_DRAW.format(what='down')} % 3 - 1 ELSE 0 END AS dy, CASE WHEN copy > 0 THEN {_DRAW.format(what='across')} % 3 - 1 ELSE 0 END AS dx,
  CASE WHEN copy > 0 THEN 80 + {_DRAW.format(what='light')} % 41 ELSE 100 END AS light, CASE WHEN copy > 0 THEN {_DRAW.format(what='noise')} ELSE NULL END AS seed FROM c)
SELECT label, vec_id, CAST(copy AS INT) AS copy, sha256(array_to_string(list_transform(range({SIDE * SIDE}), lambda i:
  CASE WHEN i // {SIDE} - dy BETWEEN 0 AND {SIDE - 1} AND i % {SIDE} - dx BETWEEN 0 AND {SIDE - 1}
    THEN greatest(0, least(255, px[i - dy * {SIDE} - dx + 1] * light // 100 + CASE WHEN seed IS NULL THEN 0 ELSE (seed * (2 * i + 1) // 64) % 17 - 8 END)) ELSE 0 END), ' ')) AS digest FROM d
"""


@_query
def perspective_points(spark, sf_dir):
    """P10: twelve orders are corners of a quadrilateral each four; where the points of a 3 by 3 grid on its rectified image lie."""
    return ops.perspective_grid(ops.quadrilaterals(table(spark, sf_dir, "orders")), 3)


ORACLE_SQL["perspective_points"] = """
WITH o AS (SELECT o_orderkey // 4 AS quad, o_orderkey % 4 AS corner, CAST(o_custkey % 50 AS DOUBLE) AS jx, CAST(floor(o_totalprice) % 40 AS DOUBLE) AS jy FROM orders),
c AS (SELECT quad, corner, min(jx) + CASE WHEN corner IN (1, 2) THEN 200 ELSE 0 END AS x, min(jy) + CASE WHEN corner >= 2 THEN 150 ELSE 0 END AS y FROM o GROUP BY quad, corner),
q AS (SELECT quad, max(x) FILTER (corner = 0) AS x0, max(y) FILTER (corner = 0) AS y0, max(x) FILTER (corner = 1) AS x1, max(y) FILTER (corner = 1) AS y1, max(x) FILTER (corner = 2) AS x2, max(y) FILTER (corner = 2) AS y2, max(x) FILTER (corner = 3) AS x3, max(y) FILTER (corner = 3) AS y3 FROM c GROUP BY quad HAVING count(*) = 4),
d AS (SELECT *, x1 - x2 AS ax, x3 - x2 AS bx, x0 - x1 + x2 - x3 AS sx, y1 - y2 AS ay, y3 - y2 AS "by", y0 - y1 + y2 - y3 AS sy FROM q),
h AS (SELECT *, (sx * "by" - bx * sy) / (ax * "by" - bx * ay) AS g, (ax * sy - sx * ay) / (ax * "by" - bx * ay) AS h FROM d WHERE ax * "by" - bx * ay <> 0),
p AS (SELECT quad, i, j, (2 * i + 1) / 6 AS u, (2 * j + 1) / 6 AS v, * FROM h CROSS JOIN (SELECT unnest(range(3)) AS i) CROSS JOIN (SELECT unnest(range(3)) AS j))
SELECT quad, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / (g * u + h * v + 1), 6) AS x, round(((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / (g * u + h * v + 1), 6) AS y FROM p
"""


@_query
def picture_kernels(spark, sf_dir):
    """P1c to P1g, P1i to P1k, P13, F13, W13: thresholds, morphology, blur, halving, projections, shares and skew of each picture."""
    return ops.kernel_report(_pixels(spark, sf_dir).select("vec_id", "pixels"), SIDE)


_LAST = SIDE - 1
_GAUSS = ", ".join(f"({d - 2}, {w!r})" for d, w in enumerate(kernels.gaussian_kernel(5).tolist()))


def _spread_sql(name: str, of: str, f: str) -> str:
    """Each pixel's greatest or least neighbour, itself included; outside there is nothing."""
    return f"{name} AS (SELECT a.vec_id, a.y, a.x, a.i, {f}(b.v) AS v FROM {of} a JOIN {of} b ON b.vec_id = a.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)"


ORACLE_SQL["picture_kernels"] = f"""
WITH {_PIXELS}, d AS MATERIALIZED (SELECT * FROM dot), g(o, w) AS (VALUES {_GAUSS}),
hist AS (SELECT vec_id, v, count(*) AS n FROM d GROUP BY vec_id, v),
cum AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS below, CAST(sum(n * v) OVER w AS DOUBLE) AS mass, CAST(sum(n) OVER (PARTITION BY vec_id) AS DOUBLE) AS every, CAST(sum(n * v) OVER (PARTITION BY vec_id) AS DOUBLE) AS whole FROM hist WINDOW w AS (PARTITION BY vec_id ORDER BY v)),
var AS (SELECT vec_id, v, CASE WHEN every > below THEN below * (every - below) * pow(mass / below - (whole - mass) / (every - below), 2) ELSE 0 END AS between_ FROM cum),
otsu AS (SELECT vec_id, CASE WHEN max(between_) > 0 THEN arg_min(v, v) FILTER (between_ = most) ELSE 0 END AS t FROM (SELECT *, max(between_) OVER (PARTITION BY vec_id) AS most FROM var) GROUP BY vec_id),
ink AS MATERIALIZED (SELECT d.*, CASE WHEN v > t THEN 1 ELSE 0 END AS b FROM d JOIN otsu USING (vec_id)),
{_spread_sql("dil", "d", "max")}, {_spread_sql("ero", "d", "min")}, {_spread_sql("ope", "ero", "max")}, {_spread_sql("clo", "dil", "min")},
box AS (SELECT d.vec_id, d.i, d.v, sum(n.v) AS s FROM d CROSS JOIN (SELECT unnest(range(-2, 3)) AS dy) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dx) JOIN d n ON n.vec_id = d.vec_id AND n.y = greatest(0, least({_LAST}, d.y + dy)) AND n.x = greatest(0, least({_LAST}, d.x + dx)) GROUP BY ALL),
blur AS (SELECT d.vec_id, sum(d.i * n.v * CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE)) AS s FROM d CROSS JOIN g a CROSS JOIN g b JOIN d n ON n.vec_id = d.vec_id AND n.y = {_LAST} - abs({_LAST} - abs(d.y + a.o)) AND n.x = {_LAST} - abs({_LAST} - abs(d.x + b.o)) GROUP BY d.vec_id),
lap AS (SELECT d.vec_id, d.i, sum(n.v) - 4 * d.v AS l FROM d JOIN (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx)) o ON true JOIN d n ON n.vec_id = d.vec_id AND n.y = greatest(0, least({_LAST}, d.y + dy)) AND n.x = greatest(0, least({_LAST}, d.x + dx)) GROUP BY d.vec_id, d.i, d.v),
mean AS (SELECT vec_id, sum(b) AS n, sum(y * b) / sum(b) AS cy, sum(x * b) / sum(b) AS cx FROM ink GROUP BY vec_id),
mom AS (SELECT ink.vec_id, n, sum(255 * b * (x - cx) * (y - cy)) AS m11, sum(255 * b * (x - cx) * (x - cx)) AS m20, sum(255 * b * (y - cy) * (y - cy)) AS m02 FROM ink JOIN mean USING (vec_id) GROUP BY ink.vec_id, n),
skew AS (SELECT vec_id, CASE WHEN n = 0 OR abs(m02) < 1e-2 OR abs(degrees(0.5 * atan2(2 * m11, m20 - m02))) > 15 THEN 0.0 ELSE degrees(0.5 * atan2(2 * m11, m20 - m02)) END AS a FROM mom),
lines AS (SELECT vec_id, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY y) AS s FROM (SELECT vec_id, y, sum(b) AS n FROM ink GROUP BY ALL) GROUP BY vec_id),
columns_ AS (SELECT vec_id, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY x) AS s FROM (SELECT vec_id, x, sum(b) AS n FROM ink GROUP BY ALL) GROUP BY vec_id),
total AS (SELECT vec_id, sum(255 - v) AS inverted, sum(b) AS ink, sum((y // 2 * {SIDE // 2} + x // 2) * v) / 4 AS halved, count(*) FILTER (v > 0) / {SIDE * SIDE} AS nonzero, count(*) FILTER (v IN (0, 255)) / {SIDE * SIDE} AS two FROM ink GROUP BY vec_id)
SELECT t.vec_id, CAST(otsu.t AS INT) AS otsu, CAST(t.ink AS INT) AS ink, CAST(inverted AS BIGINT) AS inverted,
  (SELECT CAST(sum(v) AS BIGINT) FROM dil WHERE dil.vec_id = t.vec_id) AS dilated, (SELECT CAST(sum(v) AS BIGINT) FROM ero WHERE ero.vec_id = t.vec_id) AS eroded,
  (SELECT CAST(sum(v) AS BIGINT) FROM ope WHERE ope.vec_id = t.vec_id) AS opened, (SELECT CAST(sum(v) AS BIGINT) FROM clo WHERE clo.vec_id = t.vec_id) AS closed,
  (SELECT CAST(count(*) AS INT) FROM box WHERE box.vec_id = t.vec_id AND v > s / 25 - 2) AS adaptive, round(blur.s, 4) AS blurred, round(halved, 6) AS halved, lines.s AS rows, columns_.s AS cols, nonzero, two AS two_valued,
  (SELECT round(var_pop(l), 6) FROM lap WHERE lap.vec_id = t.vec_id) AS laplacian, round(skew.a, 6) AS skew
FROM total t JOIN otsu USING (vec_id) JOIN blur USING (vec_id) JOIN skew USING (vec_id) JOIN lines USING (vec_id) JOIN columns_ USING (vec_id)
"""


@_query
def photo_grids(spark, sf_dir):
    """Photos of the grids of eight puzzles each are drawn, written, read, and their grids found from their lines' votes."""
    c = cells(spark, sf_dir).select(F.floor(F.col("puzzle") / 8).cast("long").alias("photo"), (F.col("puzzle") % 8 * 12 + F.col("row")).cast("int").alias("line"), (F.col("col") - 1).alias("j"), "number")
    # a photo has 96 lines at most: they close up where orders are missing
    lines = c.groupBy("photo", "line").agg(F.max("j").alias("last"), F.collect_list(F.when(F.col("number") % 2 == 0, F.col("j"))).alias("even"))
    held = lines.groupBy("photo").agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("line", "even"))).alias("l"))
    marks = F.flatten(F.transform("l", lambda r, i: F.transform(r["even"], lambda j: F.struct(i.alias("i"), j.alias("j")))))
    grids = held.select(F.format_string("photo-%d.png", "photo").alias("name"), F.size("l").alias("rows"), (F.col("last") + 1).alias("cols"), marks.alias("marks"))
    folder = fresh_folder(spark, "grids")
    photos = write_drawn(grids, folder, ops.grid_drawer(pitch=6, margin=5)).agg(F.count("bytes")).first()[0]
    found = ops.detected_grids(ops.axis_lines(read_images(spark, folder, photos)))
    return found.select(F.regexp_extract("origin", r"photo-(\d+)\.png$", 1).cast("long").alias("photo"), "rows", "cols", "left", "top", "right", "bottom")


ORACLE_SQL["photo_grids"] = f"""
WITH {CELLS_SQL}, p AS (SELECT puzzle // 8 AS photo, count(DISTINCT (puzzle, row)) AS rows, max(col) AS cols FROM cells GROUP BY ALL)
SELECT photo, rows, CAST(cols AS BIGINT) AS cols, CAST(5 AS DOUBLE) AS "left", CAST(5 AS DOUBLE) AS top, CAST(5 + 6 * cols AS DOUBLE) AS "right", CAST(5 + 6 * rows AS DOUBLE) AS bottom FROM p
"""
