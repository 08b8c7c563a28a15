"""Periods, spectra and peaks of users' hourly counts, and hashes of 8 by 8 images, as queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import hashes
from ..operators import signal as signal_ops
from ..operators import spectrum as ops
from .tables import HOURS_SQL, hours, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Shortest and longest period asked for, in hours.
LOW, HIGH = 6, 48


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _signals(spark, sf_dir):
    return ops.signals(hours(spark, sf_dir), "user_id")


_SIGNALS = f"""{HOURS_SQL},
span AS (SELECT min(pos) AS lo, max(pos) - min(pos) + 1 AS n FROM hours),
sig AS (SELECT user_id, pos - lo AS i, CAST(amplitude AS DOUBLE) AS x, n FROM hours, span)"""

# Dense, as the definition has it: every hour of every user.
_AUTO = f"""{_SIGNALS},
dense AS (SELECT u.user_id, t.i, coalesce(s.x, 0) AS x FROM (SELECT DISTINCT user_id FROM sig) u CROSS JOIN (SELECT unnest(range(n)) AS i FROM span) t LEFT JOIN sig s ON s.user_id = u.user_id AND s.i = t.i),
tot AS (SELECT user_id, count(*) AS n, sum(x) AS t, sum(x * x) AS sq FROM dense GROUP BY user_id),
lags AS (SELECT unnest(range({LOW}, least({HIGH}, (SELECT n FROM span) - 1) + 1)) AS lag),
prod AS (SELECT a.user_id, lag, sum((tot.n * a.x - t) * (tot.n * b.x - t)) AS score FROM dense a JOIN tot ON tot.user_id = a.user_id CROSS JOIN lags JOIN dense b ON b.user_id = a.user_id AND b.i = a.i + lag GROUP BY a.user_id, lag),
ac AS (SELECT p.user_id, lag, score, score / (n * (n * sq - t * t)) AS r, n * (n * sq - t * t) AS scale FROM prod p JOIN tot ON tot.user_id = p.user_id),
best AS (SELECT user_id, arg_min(lag, lag) FILTER (score = top) AS lag, max(r) AS r, sqrt(avg(r * r)) AS rms FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS top FROM ac WHERE scale >= 1e-10) GROUP BY user_id),
auto AS (
  SELECT tot.user_id, coalesce(CASE WHEN abs(a.r - 2 * b.r + c.r) > 1e-10 THEN b.lag - (c.r - a.r) / (2 * (a.r - 2 * b.r + c.r)) ELSE b.lag END, {LOW}) AS period,
         coalesce(CASE WHEN rms > 0 THEN b.r / rms END, 0) AS snr
  FROM tot LEFT JOIN best b ON b.user_id = tot.user_id LEFT JOIN ac a ON a.user_id = b.user_id AND a.lag = b.lag - 1 LEFT JOIN ac c ON c.user_id = b.user_id AND c.lag = b.lag + 1)"""


@_query
def autocorrelation(spark, sf_dir):
    """D7."""
    found = ops.autocorrelation_period(_signals(spark, sf_dir), "user_id", LOW, HIGH)
    return found.select("user_id", F.round("period", 6).alias("period"), F.round("snr", 6).alias("snr"))


ORACLE_SQL["autocorrelation"] = f"WITH {_AUTO} SELECT user_id, round(period, 6) AS period, round(snr, 6) AS snr FROM auto"

_SPECTRUM = f"""
sz AS (SELECT n, CAST(pow(2, ceil(log2(n)) + 1) AS BIGINT) AS size FROM span),
band AS (SELECT unnest(range(greatest(1, CAST(ceil(size / {HIGH}) AS BIGINT)), least(CAST(floor(size / {LOW}) AS BIGINT), size // 2 - 1) + 1)) AS k, size, n FROM sz),
mags AS (
  SELECT user_id, k, size, round(sqrt(sum(w * cos(i * k % size * (2 * pi()) / size)) ** 2 + sum(w * sin(i * k % size * (2 * pi()) / size)) ** 2), {ops.DECIMALS}) AS m
  FROM (SELECT user_id, i, x * 0.5 * (1 - cos(i * (2 * pi()) / (n - 1))) AS w FROM sig) CROSS JOIN band
  GROUP BY user_id, k, size)"""


@_query
def magnitudes(spark, sf_dir):
    """D6."""
    return ops.magnitudes(_signals(spark, sf_dir), "user_id", LOW, HIGH)


ORACLE_SQL["magnitudes"] = f"WITH {_SIGNALS}, {_SPECTRUM} SELECT user_id, k, m AS magnitude FROM mags"


@_query
def dominant_period(spark, sf_dir):
    """The autocorrelation where it is clear, else the spectrum, led down the harmonics."""
    found = ops.dominant_period(_signals(spark, sf_dir), "user_id", LOW, HIGH)
    return found.select("user_id", "method", F.round("period", 5).alias("period"), F.round("snr", 5).alias("snr"))


ORACLE_SQL["dominant_period"] = f"""
WITH RECURSIVE {_AUTO}, {_SPECTRUM},
few AS (SELECT * FROM mags WHERE user_id IN (SELECT user_id FROM auto WHERE snr < 3)),
edge AS (SELECT min(k) AS first, max(k) AS last FROM band HAVING min(k) < max(k)),
top AS (SELECT user_id, min(k) AS k FROM (SELECT *, max(m) OVER (PARTITION BY user_id) AS most FROM few) WHERE m = most GROUP BY user_id),
down(step, user_id, k) AS (
  SELECT 0, user_id, k FROM top
  UNION ALL
  SELECT d.step + 1, d.user_id, n.f
  FROM down d, LATERAL (
    SELECT c.k AS f FROM few c JOIN few b ON b.user_id = c.user_id AND b.k = d.k, (SELECT unnest([2, 3, 4, 5]) AS part) p, (SELECT unnest([-1, 0, 1]) AS off) o
    WHERE c.user_id = d.user_id AND d.k / part >= (SELECT first FROM edge) AND c.k = floor(d.k / part + 0.5) + off AND c.k < d.k AND c.m >= 0.30 * b.m
    ORDER BY part, off LIMIT 1) n
  WHERE d.step < 62),
low AS (SELECT user_id, arg_max(k, step) AS k FROM down GROUP BY user_id),
mean AS (SELECT l.user_id, avg(m) AS mean FROM low l JOIN few ON few.user_id = l.user_id, edge WHERE few.k BETWEEN greatest(first, floor(l.k * 0.70::DOUBLE + 0.5)) AND least(last, floor(l.k * 1.30::DOUBLE + 0.5)) GROUP BY l.user_id)
SELECT user_id, 'autocorrelation' AS method, round(period, 5) AS period, round(snr, 5) AS snr FROM auto WHERE snr >= 3
UNION ALL
SELECT l.user_id, 'spectrum', round(b.size / CASE WHEN abs(a.m - 2 * b.m + c.m) > 1e-10 THEN l.k - (c.m - a.m) / (2 * (a.m - 2 * b.m + c.m)) ELSE l.k END, 5), round(CASE WHEN mean > 0 THEN b.m / mean ELSE 0 END, 5)
FROM low l JOIN edge ON true JOIN mean ON mean.user_id = l.user_id JOIN few b ON b.user_id = l.user_id AND b.k = l.k
LEFT JOIN few a ON a.user_id = l.user_id AND a.k = l.k - 1 LEFT JOIN few c ON c.user_id = l.user_id AND c.k = l.k + 1
"""


def _smooth_sql(sigma: float, name: str = "sm") -> str:
    """Dense: each place is the weighted mean of the places around it, the ends repeated."""
    weights = ops.kernel(sigma)
    radius = len(weights) // 2
    kernel = ", ".join(f"({d}, {w!r})" for d, w in zip(range(-radius, radius + 1), weights))
    return f"""
{name}_kernel(d, w) AS (VALUES {kernel}),
{name} AS (
  SELECT o.user_id, o.i, o.n, round(coalesce(sum(s.x * w), 0), {ops.DECIMALS}) AS x
  FROM (SELECT u.user_id, t.i, n FROM (SELECT DISTINCT user_id FROM sig) u CROSS JOIN (SELECT unnest(range(n)) AS i, n FROM span) t) o
  CROSS JOIN {name}_kernel LEFT JOIN sig s ON s.user_id = o.user_id AND s.i = greatest(0, least(o.n - 1, o.i + d))
  GROUP BY o.user_id, o.i, o.n)"""


def _peaks_sql(apart: float, name: str = "sm") -> str:
    return f"""
{name}_inner AS (SELECT * FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM {name} WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE x > 0 AND x >= a AND x >= b AND i > 0 AND i < n - 1),
{name}_list AS (SELECT user_id, list(i ORDER BY x DESC, i) AS r FROM {name}_inner GROUP BY user_id),
{name}_kept AS (SELECT user_id, list_reduce(list_transform(r, lambda y: [y]), lambda k, y: CASE WHEN len(list_filter(k, lambda p: abs(p - y[1]) < {max(1, int(apart + 0.5))})) > 0 THEN k ELSE k || y END) AS k FROM {name}_list),
{name}_top AS (SELECT user_id, max(x) AS top FROM {name} GROUP BY user_id),
{name}_peaks AS (SELECT p.user_id, p.i, x, n, top FROM (SELECT user_id, unnest(k) AS i FROM {name}_kept) p JOIN {name} s ON s.user_id = p.user_id AND s.i = p.i JOIN {name}_top t ON t.user_id = p.user_id)"""


@_query
def smoothed(spark, sf_dir):
    """D9; places that stay 0 have no row."""
    return ops.smooth(_signals(spark, sf_dir), "user_id", 2.5).where("x > 0").select("user_id", "i", "x")


ORACLE_SQL["smoothed"] = f"WITH {_SIGNALS}, {_smooth_sql(2.5)} SELECT user_id, i, x FROM sm WHERE x > 0"


@_query
def smoothed_peaks(spark, sf_dir):
    """W5, C4 on a smoothed signal."""
    return ops.local_peaks(_signals(spark, sf_dir), "user_id", 6, sigma=4.8).select("user_id", "i", "x")


ORACLE_SQL["smoothed_peaks"] = f"WITH {_SIGNALS}, {_smooth_sql(4.8)}, {_peaks_sql(6)} SELECT user_id, i, x FROM sm_peaks"


@_query
def borders_by_period(spark, sf_dir):
    """Borders a day apart."""
    return ops.borders_by_period(_signals(spark, sf_dir), "user_id", 24)


ORACLE_SQL["borders_by_period"] = f"""
WITH {_SIGNALS}, {_smooth_sql(max(1.0, 24 * 0.05))}, {_peaks_sql(24 * 0.6)},
kept AS (SELECT user_id, i AS pos FROM (SELECT *, count(*) FILTER (x >= 0.5 * top) OVER w AS high, count(*) FILTER (x >= 0.3 * top) OVER w AS low FROM sm_peaks WINDOW w AS (PARTITION BY user_id)) WHERE CASE WHEN high >= 2 THEN x >= 0.5 * top ELSE x >= 0.3 * top AND low >= 2 END),
g AS (SELECT *, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) - pos AS ahead FROM kept),
m AS (SELECT user_id, list_sort(list(ahead))[count(ahead) // 2 + 1] AS mg FROM g WHERE ahead IS NOT NULL GROUP BY user_id),
f AS (SELECT g.user_id, pos, mg, CAST(floor(ahead / mg + 0.5) - 1 AS BIGINT) AS n, ahead / mg AS r FROM g JOIN m ON m.user_id = g.user_id)
SELECT user_id, pos, false AS inserted FROM f
UNION ALL SELECT user_id, pos + mg * k, true FROM (SELECT user_id, pos, mg, unnest(range(1, n + 1)) AS k FROM f WHERE n BETWEEN 1 AND 4 AND r > 2.0)
"""


@_query
def positions_by_peaks(spark, sf_dir):
    """D11 without a period: peaks and the axis's ends."""
    return ops.positions_by_peaks(_signals(spark, sf_dir), "user_id", 12)


ORACLE_SQL["positions_by_peaks"] = f"""
WITH {_SIGNALS}, {_smooth_sql(12 * 0.4)}, {_peaks_sql(12 * 0.5)},
p AS (SELECT user_id, n, i, count(*) OVER w AS c, min(i) OVER w AS a, max(i) OVER w AS z FROM sm_peaks WHERE x >= 0.2 * top WINDOW w AS (PARTITION BY user_id))
SELECT user_id, i AS pos FROM p WHERE c > 1
UNION ALL SELECT DISTINCT user_id, 0 FROM p WHERE c > 1 AND a > 6
UNION ALL SELECT DISTINCT user_id, n FROM p WHERE c > 1 AND n - z > 6
"""


@_query
def grid_lines(spark, sf_dir):
    """Lines a day apart from each user's phase on."""
    s = _signals(spark, sf_dir)
    fitted = signal_ops.phase(s.withColumn("pos", F.col("i")), "user_id", 24).withColumn("phase", F.round("phase", 5))
    lengths = s.groupBy("user_id").agg(F.max("n").alias("n"))
    return ops.grid_lines(fitted.join(lengths, "user_id"), "user_id", 24.0, F.col("n"))


ORACLE_SQL["grid_lines"] = f"""
WITH {_SIGNALS}, a AS (SELECT user_id, n, atan2(avg(sin(i * (2 * pi() / 24))), avg(cos(i * (2 * pi() / 24)))) AS a FROM sig GROUP BY user_id, n),
f AS (SELECT user_id, n, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END * 24 / (2 * pi()), 5) AS phase FROM a),
l AS (SELECT user_id, n, phase + 24.0 * unnest(range(-1, CAST(ceil(n / 24.0) AS BIGINT) + 2)) AS line FROM f)
SELECT DISTINCT user_id, CAST(greatest(0, least(n, floor(line + 0.5))) AS BIGINT) AS pos FROM l WHERE line >= -2.4 AND line <= n + 2.4
"""


@_query
def perceptual_hashes(spark, sf_dir):
    """Embeddings are images of 8 by 8; null, short and non-finite ones have no hash."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", hashes.perceptual_hash(F.col("embedding"), 8).alias("hash"))


def _hash_sql() -> str:
    rows = ["[" + ", ".join(repr(c) for c in row) + "]" for row in hashes.cosine_basis(8, 8)]
    basis = "[" + ", ".join(rows) + "]"
    dot = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])), lambda s, x: s + x)"
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM embeddings),
b AS (SELECT {basis} AS b),
r AS (SELECT vec_id, e, list_transform(b, lambda u: list_transform(range(0, 8), lambda c: {dot.format(a='u', b='list_transform(range(0, 8), lambda y: e[y * 8 + c + 1])')})) AS t FROM v, b),
c AS (SELECT vec_id, e, list_slice(flatten(list_transform(t, lambda row: list_transform(b, lambda w: {dot.format(a='row', b='w')}))), 2, 64) AS c FROM r, b),
m AS (SELECT vec_id, e, c, list_sort(c)[32] AS m FROM c)
SELECT vec_id, CASE WHEN e IS NOT NULL THEN CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN c[i + 1] > m THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) END AS hash FROM m
"""


ORACLE_SQL["perceptual_hashes"] = _hash_sql()
