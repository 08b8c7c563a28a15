"""One-dimensional signals and geometry, as queries: events by hour and user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as ops
from .tables import HOURS_SQL, hours, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def gap_islands(spark, sf_dir):
    """W1, W2, A13."""
    return ops.border_centres(hours(spark, sf_dir), "user_id")


_CHAIN = "c AS (SELECT *, CAST(sum(CASE WHEN pos - before > {n} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS grp FROM (SELECT *, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM hours))"
ORACLE_SQL["gap_islands"] = f"WITH {HOURS_SQL}, {_CHAIN.format(n=10)} SELECT user_id, grp AS \"group\", CAST(floor(sum(pos * amplitude) / sum(amplitude) + 0.5) AS BIGINT) AS centre, max(amplitude) AS amplitude FROM c GROUP BY user_id, grp"


@_query
def cluster_peaks(spark, sf_dir):
    """W3."""
    return ops.cluster_peaks(hours(spark, sf_dir), "user_id", 6)


ORACLE_SQL["cluster_peaks"] = f"WITH {HOURS_SQL}, {_CHAIN.format(n=6)} SELECT user_id, grp AS \"group\", CAST(floor(avg(pos) + 0.5) AS BIGINT) AS centre, count(*) AS members FROM c GROUP BY user_id, grp"


@_query
def peak_runs(spark, sf_dir):
    """W4."""
    return ops.peak_runs(hours(spark, sf_dir), "user_id")


ORACLE_SQL["peak_runs"] = f"""
WITH {HOURS_SQL}, h AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM (SELECT *, max(amplitude) OVER (PARTITION BY user_id) AS top FROM hours) WHERE amplitude > 0.4 * top)
SELECT user_id, min(pos) AS first, max(pos) AS last, CAST(floor(sum(pos * amplitude) / sum(amplitude) + 0.5) AS BIGINT) AS centre FROM h GROUP BY user_id, run
"""


@_query
def local_maxima(spark, sf_dir):
    """W5."""
    return ops.local_maxima(hours(spark, sf_dir), "user_id")


ORACLE_SQL["local_maxima"] = f"WITH {HOURS_SQL} SELECT user_id, pos, amplitude FROM (SELECT *, lag(amplitude) OVER w AS a, lead(amplitude) OVER w AS b FROM hours WINDOW w AS (PARTITION BY user_id ORDER BY pos)) WHERE amplitude > 0 AND amplitude >= a AND amplitude >= b"

_GAPS = "g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) - pos AS ahead, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 2 AS ord FROM hours), m AS (SELECT user_id, list_sort(list(gap))[count(*) // 2 + 1] AS mg FROM g WHERE gap IS NOT NULL GROUP BY user_id)"


@_query
def regularize_gaps(spark, sf_dir):
    """W8, W9, A11."""
    h = hours(spark, sf_dir)
    return ops.regularize(h.join(ops.gap_medians(h, "user_id"), "user_id"), "user_id", F.col("median_gap"))


ORACLE_SQL["regularize_gaps"] = f"""
WITH {HOURS_SQL}, {_GAPS}, n AS (SELECT g.user_id, pos, mg, CAST(floor(ahead / mg + 0.5) - 1 AS BIGINT) AS n, ahead / mg AS r FROM g JOIN m ON m.user_id = g.user_id)
SELECT user_id, pos, false AS inserted FROM n
UNION ALL SELECT user_id, pos + mg * k AS pos, true FROM (SELECT user_id, pos, mg, unnest(range(1, n + 1)) AS k FROM n WHERE n BETWEEN 1 AND 4 AND r > 2.0)
"""


@_query
def uniformity(spark, sf_dir):
    """W11."""
    return ops.uniformity(hours(spark, sf_dir), "user_id")


ORACLE_SQL["uniformity"] = f"WITH {HOURS_SQL}, {_GAPS} SELECT g.user_id, max(abs(gap - mg) / mg) <= 0.8 AS uniform, round(max(abs(gap - mg) / mg), 9) AS worst FROM g JOIN m ON m.user_id = g.user_id WHERE gap IS NOT NULL GROUP BY g.user_id"


@_query
def clue_column(spark, sf_dir):
    """W12."""
    return ops.clue_column(hours(spark, sf_dir), "user_id")


ORACLE_SQL["clue_column"] = f"WITH {HOURS_SQL}, {_GAPS}, t AS (SELECT user_id, arg_max(ord, gap * 1000000 - ord) AS o, max(gap) AS top FROM g WHERE gap IS NOT NULL GROUP BY user_id) SELECT t.user_id, CASE WHEN top > 2 * mg THEN o END AS split_at FROM t JOIN m ON m.user_id = t.user_id"

_ROWS = "s AS (SELECT user_id, list({{'pos': pos, 'amplitude': amplitude}} ORDER BY {order}) AS r FROM hours GROUP BY user_id)"


@_query
def dedupe_fold(spark, sf_dir):
    """C1."""
    return ops.dedupe_fold(hours(spark, sf_dir), "user_id", 12)


ORACLE_SQL["dedupe_fold"] = f"""
WITH {HOURS_SQL}, {_ROWS.format(order='pos, amplitude')},
f AS (SELECT user_id, list_reduce(list_transform(r, lambda x: [x]), lambda k, x: CASE WHEN x[1].pos - k[-1].pos >= 12 THEN k || x WHEN x[1].amplitude > k[-1].amplitude THEN k[:len(k) - 1] || x ELSE k END) AS k FROM s)
SELECT user_id, x.pos AS pos, x.amplitude AS amplitude FROM (SELECT user_id, unnest(k) AS x FROM f)
"""


@_query
def anchor_groups(spark, sf_dir):
    """C2."""
    return ops.anchor_groups(hours(spark, sf_dir), "user_id", 24)


ORACLE_SQL["anchor_groups"] = f"""
WITH {HOURS_SQL}, s AS (SELECT user_id, list({{'anchor': pos, 'members': 1}} ORDER BY pos) AS r FROM hours GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_transform(r, lambda x: [x]), lambda k, x: CASE WHEN x[1].anchor - k[-1].anchor <= 24 THEN k[:len(k) - 1] || [{{'anchor': k[-1].anchor, 'members': k[-1].members + 1}}] ELSE k || x END) AS k FROM s)
SELECT user_id, x.anchor AS anchor, x.members AS members FROM (SELECT user_id, unnest(k) AS x FROM f)
"""


@_query
def merge_lines(spark, sf_dir):
    """C3."""
    return ops.merge_close(hours(spark, sf_dir), "user_id", 24)


ORACLE_SQL["merge_lines"] = f"""
WITH {HOURS_SQL}, s AS (SELECT user_id, list(CAST(pos AS DOUBLE) ORDER BY pos) AS r FROM hours GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_transform(r, lambda x: [x]), lambda k, x: CASE WHEN abs(x[1] - k[-1]) <= 24 THEN k[:len(k) - 1] || [(k[-1] + x[1]) / 2] ELSE k || x END) AS k FROM s)
SELECT user_id, unnest(k) AS line FROM f
"""


@_query
def nms_peaks(spark, sf_dir):
    """C4."""
    return ops.nms_peaks(hours(spark, sf_dir), "user_id", 24)


ORACLE_SQL["nms_peaks"] = f"""
WITH {HOURS_SQL}, s AS (SELECT user_id, list(pos ORDER BY amplitude DESC, pos) AS r FROM hours GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_transform(r, lambda x: [x]), lambda k, x: CASE WHEN len(list_filter(k, lambda p: abs(p - x[1]) < 24)) > 0 THEN k ELSE k || x END) AS k FROM s)
SELECT user_id, unnest(k) AS pos FROM f
"""


@_query
def modal_value(spark, sf_dir):
    """A9."""
    return ops.modal_value(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").withColumn("modal", F.round("modal", 6))


ORACLE_SQL["modal_value"] = """
WITH s AS (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL),
b AS (SELECT o.o_orderpriority, lo, hi, CAST(least(floor((o_totalprice - lo) / (hi - lo) * 10), 9) AS INT) AS b, count(*) AS n FROM orders o JOIN s USING (o_orderpriority) GROUP BY ALL)
SELECT o_orderpriority, round(lo + (b + 0.5) * (hi - lo) / 10, 6) AS modal FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, b) AS i FROM b) WHERE i = 1
"""


@_query
def medians(spark, sf_dir):
    """A10, A11, A12, per user."""
    places = {"low": lambda n: F.floor((n - 1) / 2), "upper": lambda n: F.floor(n / 2), "tenth": lambda n: F.floor(n * 0.1), "ninetieth": lambda n: F.floor(n * 0.9)}
    s = ops.order_statistics(table(spark, sf_dir, "events"), "user_id", "value", places)
    return s.select("user_id", ((F.col("low") + F.col("upper")) / 2).alias("middle"), "upper", "tenth", "ninetieth")


ORACLE_SQL["medians"] = """
WITH s AS (SELECT user_id, median(value) AS middle, list_sort(list(value)) AS v FROM events GROUP BY user_id)
SELECT user_id, middle, v[len(v) // 2 + 1] AS upper, v[CAST(floor(len(v) * 0.1) AS INT) + 1] AS tenth, v[CAST(floor(len(v) * 0.9) AS INT) + 1] AS ninetieth FROM s
"""


@_query
def kmeans_1d(spark, sf_dir):
    """D2 on line quantities, by return flag."""
    return ops.kmeans_1d(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", 3).select("l_returnflag", F.transform("centroids", lambda c: F.round(c, 6)).alias("centroids"))


ORACLE_SQL["kmeans_1d"] = """
WITH RECURSIVE q AS (SELECT l_returnflag AS k, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_quantity),
v AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY v) AS upto FROM q),
t AS (SELECT k, max(upto) AS total FROM v GROUP BY k),
r(step, k, c) AS (
  SELECT 0, t.k, [(SELECT min(v.v) FROM v WHERE v.k = t.k AND v.upto > 0), (SELECT min(v.v) FROM v WHERE v.k = t.k AND v.upto > floor(t.total / 3)), (SELECT min(v.v) FROM v WHERE v.k = t.k AND v.upto > floor(2 * t.total / 3))] FROM t
  UNION ALL
  SELECT step + 1, k, [coalesce(sum(vn) FILTER (i = 1) / sum(n) FILTER (i = 1), any_value(c)[1]), coalesce(sum(vn) FILTER (i = 2) / sum(n) FILTER (i = 2), any_value(c)[2]), coalesce(sum(vn) FILTER (i = 3) / sum(n) FILTER (i = 3), any_value(c)[3])]
  FROM (
    SELECT r.step, r.k, r.c, v.v * v.n AS vn, v.n, list_position(list_transform(r.c, lambda y: abs(y - v.v)), list_min(list_transform(r.c, lambda y: abs(y - v.v)))) AS i
    FROM r JOIN v ON v.k = r.k WHERE r.step < 10)
  GROUP BY step, k)
SELECT k AS l_returnflag, list_transform(c, lambda x: round(x, 6)) AS centroids FROM r WHERE step = 10
"""


@_query
def regular_positions(spark, sf_dir):
    """W10, a chain of W3, W1, D2 and W8."""
    return ops.regularize_positions(hours(spark, sf_dir), "user_id")


ORACLE_SQL["regular_positions"] = f"""
WITH RECURSIVE {HOURS_SQL}, {_CHAIN.format(n=6)},
p AS (SELECT user_id, CAST(floor(avg(pos) + 0.5) AS BIGINT) AS pos FROM c GROUP BY user_id, grp),
g AS (SELECT * FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM p) WHERE gap IS NOT NULL),
q AS (SELECT user_id AS k, CAST(gap AS DOUBLE) AS v, count(*) AS n FROM g GROUP BY user_id, gap),
v AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY v) AS upto FROM q),
t AS (SELECT k, max(upto) AS total, sum(v * n) / sum(n) AS mean FROM v GROUP BY k),
r(step, k, c) AS (
  SELECT 0, t.k, CASE WHEN total < 2 THEN [mean] ELSE [(SELECT min(v.v) FROM v WHERE v.k = t.k), (SELECT min(v.v) FROM v WHERE v.k = t.k AND v.upto > floor(t.total / 2))] END FROM t
  UNION ALL
  SELECT step + 1, k, CASE WHEN len(any_value(c)) = 1 THEN any_value(c) ELSE [coalesce(sum(vn) FILTER (i = 1) / sum(n) FILTER (i = 1), any_value(c)[1]), coalesce(sum(vn) FILTER (i = 2) / sum(n) FILTER (i = 2), any_value(c)[2])] END
  FROM (
    SELECT r.step, r.k, r.c, v.v * v.n AS vn, v.n, list_position(list_transform(r.c, lambda y: abs(y - v.v)), list_min(list_transform(r.c, lambda y: abs(y - v.v)))) AS i
    FROM r JOIN v ON v.k = r.k WHERE r.step < 10)
  GROUP BY step, k),
s AS (
  SELECT g.user_id, pos - gap AS before, gap, b.c[list_position(list_transform(a.c, lambda y: abs(y - gap)), list_min(list_transform(a.c, lambda y: abs(y - gap))))] AS step
  FROM g JOIN r a ON a.k = g.user_id AND a.step = 9 JOIN r b ON b.k = g.user_id AND b.step = 10),
m AS (SELECT *, CAST(floor(gap / step + 0.5) - 1 AS BIGINT) AS n FROM s WHERE abs(gap - step) / step > 0.45)
SELECT user_id, pos, false AS inserted FROM p
UNION ALL SELECT user_id, CAST(floor(before + step * k + 0.5) AS BIGINT), true FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM m WHERE n BETWEEN 1 AND 3)
"""


@_query
def distinct_positions(spark, sf_dir):
    """U4: the hours of day of a user's events."""
    h = hours(spark, sf_dir).select("user_id", (F.col("pos") % 24).alias("pos"))
    return ops.distinct_positions(h, "user_id").select("user_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


ORACLE_SQL["distinct_positions"] = f"WITH {HOURS_SQL} SELECT user_id, array_to_string(list_sort(list_distinct(list(pos % 24))), ' ') AS positions FROM hours GROUP BY user_id"


@_query
def detector_cascade(spark, sf_dir):
    """D3: three detectors over a user's hours: peaks, chains, the span; each fails where it finds too little."""
    h = hours(spark, sf_dir)
    as_result = lambda df, least: df.select("user_id", F.col("n").alias("grid"), F.when(F.col("n") < least, "too few").alias("error"))
    count = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    found = [as_result(count(ops.peak_runs(h.where("amplitude > 1"), "user_id")), 2), as_result(count(ops.cluster_peaks(h, "user_id", 6)), 20), as_result(count(h), 1)]
    return ops.first_detection(found, "user_id")


ORACLE_SQL["detector_cascade"] = f"""
WITH {HOURS_SQL}, {_CHAIN.format(n=6)},
h AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM (SELECT *, max(amplitude) OVER (PARTITION BY user_id) AS top FROM hours WHERE amplitude > 1) WHERE amplitude > 0.4 * top),
a AS (SELECT user_id, count(DISTINCT run) AS n FROM h GROUP BY user_id), b AS (SELECT user_id, count(DISTINCT grp) AS n FROM c GROUP BY user_id), d AS (SELECT user_id, count(*) AS n FROM hours GROUP BY user_id)
SELECT d.user_id, CASE WHEN a.n >= 2 THEN 0 WHEN b.n >= 20 THEN 1 ELSE 2 END AS detector, CASE WHEN a.n >= 2 THEN a.n WHEN b.n >= 20 THEN b.n ELSE d.n END AS grid FROM d LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)
"""


@_query
def vote_accumulator(spark, sf_dir):
    """A31."""
    c = table(spark, sf_dir, "customer")
    return ops.vote_accumulator(c, "c_nationkey", F.col("c_acctbal") / 100, F.col("c_custkey") % 64)


ORACLE_SQL["vote_accumulator"] = """
SELECT c_nationkey, (floor(c_acctbal / 100 / 8) + 0.5) * 8 AS x, (floor(c_custkey % 64 / 8) + 0.5) * 8 AS y, count(*) AS votes
FROM customer GROUP BY c_nationkey, floor(c_acctbal / 100 / 8), floor(c_custkey % 64 / 8) HAVING count(*) >= 3
"""


@_query
def segment_cross(spark, sf_dir):
    """Customers are near-horizontal lines, suppliers near-vertical ones, by nation."""
    from ..functions.geometry import line_kind

    point = lambda *xs: F.struct(*[x.cast("double").alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), xs)])
    h = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), point(F.lit(0), F.col("c_custkey") % 500, F.lit(1000), F.col("c_custkey") % 500 + F.col("c_custkey") % 7).alias("line"))
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), point(F.col("s_suppkey") % 900, F.lit(0), F.col("s_suppkey") % 900 + F.col("s_suppkey") % 5, F.lit(1000)).alias("line"))
    lines = h.unionByName(v).withColumn("kind", line_kind(F.col("line")))
    return ops.intersections(lines, "k", 1000, 1000, decimals=6)


ORACLE_SQL["segment_cross"] = """
WITH h AS (SELECT c_nationkey AS k, CAST(c_custkey % 500 AS DOUBLE) AS y1, CAST(c_custkey % 500 + c_custkey % 7 AS DOUBLE) AS y2 FROM customer),
v AS (SELECT s_nationkey AS k, CAST(s_suppkey % 900 AS DOUBLE) AS x1, CAST(s_suppkey % 900 + s_suppkey % 5 AS DOUBLE) AS x2 FROM supplier),
d AS (SELECT h.k, y1, y2, -1000.0 * -1000.0 - (y1 - y2) * (x1 - x2) AS den, x1, x2 FROM h JOIN v ON h.k = v.k),
t AS (SELECT *, ((0 - x1) * -1000.0 - (y1 - 0) * (x1 - x2)) / den AS t FROM d WHERE abs(den) >= 1e-10)
SELECT k, round(t * 1000, 6) + 0.0 AS x, round(y1 + t * (y2 - y1), 6) + 0.0 AS y FROM t WHERE t * 1000 BETWEEN 0 AND 1000 AND y1 + t * (y2 - y1) BETWEEN 0 AND 1000
"""


@_query
def nearest_row(spark, sf_dir):
    """Suppliers are words, the distinct balances of 150 customers, by hundred, the rows of 10 of them."""
    words = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).cast("long").alias("k"), F.col("s_suppkey").alias("word"), F.col("s_acctbal").alias("y"))
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 150).cast("long").alias("k"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("row")).distinct().withColumn("row_y", F.col("row") * 100.0)
    return ops.nearest_rows(words, rows, "k")


ORACLE_SQL["nearest_row"] = """
WITH r AS (SELECT DISTINCT c_custkey // 150 AS k, CAST(floor(c_acctbal / 100) AS BIGINT) AS row FROM customer)
SELECT k, word, row FROM (SELECT s_suppkey // 10 AS k, s_suppkey AS word, row, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - row * 100.0), row) AS i FROM supplier JOIN r ON r.k = s_suppkey // 10) WHERE i = 1
"""


@_query
def phase_fit(spark, sf_dir):
    """D10, specified but unused by the reference."""
    return ops.phase(hours(spark, sf_dir), "user_id", 24).withColumn("phase", F.round("phase", 5))


ORACLE_SQL["phase_fit"] = f"""
WITH {HOURS_SQL}, a AS (SELECT user_id, atan2(avg(sin(pos * (2 * pi() / 24))), avg(cos(pos * (2 * pi() / 24)))) AS a FROM hours GROUP BY user_id)
SELECT user_id, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END * 24 / (2 * pi()), 5) AS phase FROM a
"""
