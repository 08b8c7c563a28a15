"""Symbols, letters and clusters as queries: letters of documents, embeddings as features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import clusters, mapping
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _letters(spark, sf_dir):
    """Per language the number of each letter."""
    return mapping.letter_counts(table(spark, sf_dir, "documents"), "lang", "text")


_LETTERS = """
letters AS (
  SELECT lang, c AS symbol_id, CAST(sum(length(lower(text)) - length(replace(lower(text), c, ''))) AS BIGINT) AS n
  FROM documents, (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c) GROUP BY lang, c HAVING n > 0),
known AS (SELECT unnest(%s) AS letter, unnest(%s) AS pct),
ranked AS (SELECT *, CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY lang) AS share, row_number() OVER (PARTITION BY lang ORDER BY n DESC, symbol_id) AS rank FROM letters),
given AS (SELECT letter, CAST(pct AS DOUBLE) AS pct, row_number() OVER (ORDER BY pct DESC, letter) AS rank FROM known),
suggested AS (SELECT lang, symbol_id, letter, rank, 1 - least(abs(share - pct) / greatest(share, pct), 1.0) AS confidence FROM ranked JOIN given USING (rank))
""" % (list(mapping.LETTER_FREQUENCY), list(mapping.LETTER_FREQUENCY.values()))


def _suggested(spark, sf_dir):
    return mapping.suggest(_letters(spark, sf_dir), mapping.letter_table(spark), "lang")


@_query
def letter_rank_mapping(spark, sf_dir):
    """J6, W15, T3, X10."""
    return _suggested(spark, sf_dir).select("lang", "symbol_id", "suggested_letter", "rank", F.round("confidence", 9).alias("confidence"))


ORACLE_SQL["letter_rank_mapping"] = f"WITH {_LETTERS} SELECT lang, symbol_id, letter AS suggested_letter, rank, round(confidence, 9) AS confidence FROM suggested"


@_query
def auto_mapping(spark, sf_dir):
    """F19, K4."""
    return mapping.auto_mapping(_suggested(spark, sf_dir)).select("lang", "symbol_id", F.col("suggested_letter").alias("letter"))


ORACLE_SQL["auto_mapping"] = f"WITH {_LETTERS} SELECT lang, symbol_id, letter FROM suggested WHERE confidence >= 0.7"


@_query
def mapping_validate(spark, sf_dir):
    """The last letters of the ranking are doubled or no letters, unsure ones are left out."""
    s = _suggested(spark, sf_dir)
    m = s.where("confidence >= 0.5").select("lang", "symbol_id", F.when(F.col("rank") == 2, "A").when(F.col("rank") == 3, "?").otherwise(F.col("suggested_letter")).alias("letter"))
    return mapping.validate(_letters(spark, sf_dir), m, "lang")


ORACLE_SQL["mapping_validate"] = f"""
WITH {_LETTERS}, m AS (SELECT lang, symbol_id, CASE rank WHEN 2 THEN 'A' WHEN 3 THEN '?' ELSE letter END AS letter FROM suggested WHERE confidence >= 0.5),
d AS (SELECT lang, count(*) AS n FROM (SELECT lang, letter FROM m GROUP BY lang, letter HAVING count(*) > 1) GROUP BY lang),
b AS (SELECT lang, count(*) AS n FROM m WHERE letter = '?' GROUP BY lang),
u AS (SELECT l.lang, count(*) AS n FROM letters l LEFT JOIN m USING (lang, symbol_id) WHERE m.letter IS NULL GROUP BY l.lang),
g AS (SELECT DISTINCT lang FROM letters)
SELECT g.lang, coalesce(d.n, 0) AS duplicates, coalesce(b.n, 0) AS invalid, coalesce(u.n, 0) AS unmapped, coalesce(d.n, 0) + coalesce(b.n, 0) = 0 AS valid, coalesce(u.n, 0) = 0 AS complete
FROM g LEFT JOIN d USING (lang) LEFT JOIN b USING (lang) LEFT JOIN u USING (lang)
"""


@_query
def applied_mapping(spark, sf_dir):
    """The events of a user's day are a row of symbols; each type's first letter is mapped, but clicks have none.

    A mapping has at most an entry for each event type, so it is far below any broadcast threshold.
    """
    events = table(spark, sf_dir, "events").select(F.lit(1).alias("k"), F.concat_ws("#", "user_id", F.to_date("ts")).alias("row"), F.struct("ts", "event_id").alias("col"), F.col("event_type").alias("symbol_id"), (F.col("value") > 90).alias("is_clue"), F.lit("?").alias("user_value"))
    m = table(spark, sf_dir, "events").select(F.lit(1).alias("k"), F.col("event_type").alias("symbol_id"), F.upper(F.substring("event_type", 1, 1)).alias("letter")).distinct().where("symbol_id <> 'click'")
    done = mapping.apply_mapping(events, m, "k").withColumn("letter", F.col("user_value"))
    return mapping.row_text(done, "k").select("row", "text")


ORACLE_SQL["applied_mapping"] = "SELECT user_id || '#' || CAST(ts AS DATE) AS row, string_agg(CASE WHEN event_type = 'click' THEN '_' ELSE upper(event_type[1]) END, '' ORDER BY ts, event_id) AS text FROM events WHERE NOT value > 90 GROUP BY ALL"


def _symbols(spark, sf_dir):
    """Embeddings as symbol features: a symbol has nine, so the first two components are area and ratio, scaled, and the next seven the moments; the others are not read."""
    e = F.col("embedding")
    part = lambda i: F.get(e, F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").where(e.isNotNull()).select(F.col("label").cast("long").alias("puzzle"), F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("hash"), (F.abs(part(0)) * 1000).alias("area"), (1 + part(1)).alias("aspect_ratio"), F.transform(F.slice(e, 3, 7), lambda x: x.cast("double")).alias("moments"))


@_query
def cluster_means(spark, sf_dir):
    """A8, on the embeddings' labels."""
    m = clusters.cluster_means(_symbols(spark, sf_dir), ["puzzle"])
    return m.select("puzzle", "members", F.round("area", 6).alias("area"), F.round("aspect_ratio", 6).alias("aspect_ratio"), F.transform("moments", lambda x: F.round(x, 6)).alias("moments"))


_SYMBOLS = "s AS (SELECT CAST(label AS BIGINT) AS puzzle, vec_id AS ord, abs(CAST(embedding[1] AS DOUBLE)) * 1000 AS area, 1 + CAST(embedding[2] AS DOUBLE) AS ar, list_transform(embedding[3:9], lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings WHERE embedding IS NOT NULL)"
ORACLE_SQL["cluster_means"] = f"WITH {_SYMBOLS} SELECT puzzle, count(*) AS members, round(avg(area), 6) AS area, round(avg(ar), 6) AS aspect_ratio, [round(avg(m[1]), 6), round(avg(m[2]), 6), round(avg(m[3]), 6), round(avg(m[4]), 6), round(avg(m[5]), 6), round(avg(m[6]), 6), round(avg(m[7]), 6)] AS moments FROM s GROUP BY puzzle"


@_query
def nearest_centroid(spark, sf_dir):
    """Every symbol against the labels' means; symbols are dealt to parts, and each part meets all means."""
    s, parts = _symbols(spark, sf_dir), 64
    means = clusters.cluster_means(s, ["puzzle"]).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k"), F.col("puzzle").cast("int").alias("cluster"), "area", "aspect_ratio", "moments")
    return clusters.nearest_centroid(s.withColumn("k", F.pmod(F.hash("ord"), F.lit(parts))), means, "k").select("ord", "cluster")


ORACLE_SQL["nearest_centroid"] = f"""
WITH {_SYMBOLS}, c AS (SELECT puzzle AS cluster, avg(area) AS area, avg(ar) AS ar, [avg(m[1]), avg(m[2]), avg(m[3]), avg(m[4]), avg(m[5]), avg(m[6]), avg(m[7])] AS m FROM s GROUP BY puzzle),
d AS (SELECT ord, cluster, 0.2 * abs(s.area - c.area) / greatest(s.area, c.area) + 0.3 * abs(s.ar - c.ar) + 0.5 * list_sum(list_transform(list_zip(s.m, c.m), lambda p: abs(p[1] - p[2]))) / 7 AS d FROM s CROSS JOIN c)
SELECT ord, CAST(cluster AS INT) AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY d, cluster) AS i FROM d) WHERE i = 1
"""


@_query
def leader_cluster(spark, sf_dir):
    """64 vectors are a puzzle."""
    puzzles = _symbols(spark, sf_dir).withColumn("puzzle", F.floor(F.col("ord") / 64).cast("long"))
    return clusters.cluster_symbols(puzzles).select("puzzle", "cluster", "members", "representative")


_D = "0.2 * coalesce(abs({a}.area - {b}.area) / nullif(greatest({a}.area, {b}.area), 0), 0) + 0.3 * abs({a}.ar - {b}.ar) + 0.5 * list_sum(list_transform(list_zip({a}.m, {b}.m), lambda p: abs(p[1] - p[2]))) / 7"
ORACLE_SQL["leader_cluster"] = f"""
WITH {_SYMBOLS}, x AS (SELECT * REPLACE (ord // 64 AS puzzle) FROM s),
l AS (SELECT puzzle, list({{'ord': ord, 'area': area, 'ar': ar, 'm': m}} ORDER BY ord) AS r FROM x GROUP BY puzzle),
f AS (SELECT puzzle, list_reduce(list_transform(r, lambda x: [x]), lambda k, x: CASE WHEN len(list_filter(k, lambda t: 1 / (1 + {_D.format(a='t', b='x[1]')}) >= 0.85)) > 0 THEN k ELSE k || x END) AS seeds FROM l),
seed AS (SELECT puzzle, cluster - 1 AS cluster, t.ord AS ord, t.area AS area, t.ar AS ar, t.m AS m FROM (SELECT puzzle, unnest(seeds) AS t, generate_subscripts(seeds, 1) AS cluster FROM f)),
led AS (SELECT x.puzzle, x.ord, min(t.cluster) AS cluster FROM x JOIN seed t ON t.puzzle = x.puzzle AND t.ord <= x.ord AND 1 / (1 + {_D.format(a='t', b='x')}) >= 0.85 GROUP BY x.puzzle, x.ord),
old AS (
  SELECT led.puzzle, cluster, avg(area) AS area, avg(ar) AS ar, [avg(m[1]), avg(m[2]), avg(m[3]), avg(m[4]), avg(m[5]), avg(m[6]), avg(m[7])] AS m
  FROM led JOIN x ON x.puzzle = led.puzzle AND x.ord = led.ord GROUP BY led.puzzle, cluster),
d AS (SELECT x.puzzle, x.ord, old.cluster, {_D.format(a='x', b='old')} AS d FROM x JOIN old ON old.puzzle = x.puzzle),
placed AS (SELECT puzzle, ord, arg_min(cluster, {{'d': d, 'c': cluster}}) AS cluster, min(d) AS d FROM d GROUP BY puzzle, ord),
g AS (SELECT puzzle, cluster, count(*) AS members, arg_min(ord, {{'d': d, 'o': ord}}) AS representative FROM placed GROUP BY puzzle, cluster)
SELECT puzzle, CAST(row_number() OVER (PARTITION BY puzzle ORDER BY cluster) - 1 AS INT) AS cluster, members, representative FROM g
"""


@_query
def merged_clusters(spark, sf_dir):
    """Labels are clusters of 64-vector puzzles, odd ones merge into the one before; the first letter that is set stays."""
    s = _symbols(spark, sf_dir).select(F.floor(F.col("ord") / 64).cast("long").alias("puzzle"), F.col("puzzle").cast("int").alias("cluster"))
    c = s.groupBy("puzzle", "cluster").agg(F.count(F.lit(1)).alias("members")).withColumn("cluster_letter", F.when(F.col("cluster") % 4 > 0, F.char(65 + F.col("cluster"))))
    into = c.where("cluster % 2 = 1").select("puzzle", "cluster", (F.col("cluster") - 1).alias("into"))
    return clusters.merge_clusters(c, into.unionByName(into.select("puzzle", F.col("into").alias("cluster"), "into")))


ORACLE_SQL["merged_clusters"] = """
WITH c AS (SELECT vec_id // 64 AS puzzle, CAST(label AS INT) AS cluster, count(*) AS members FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL),
odd AS (SELECT DISTINCT puzzle, cluster - 1 AS cluster FROM c WHERE cluster % 2 = 1)
SELECT c.puzzle, CAST(c.cluster - c.cluster % 2 AS INT) AS cluster, CAST(sum(members) AS BIGINT) AS members,
  arg_min(CASE WHEN c.cluster % 4 > 0 THEN chr(65 + c.cluster) END, c.cluster) FILTER (c.cluster % 4 > 0) AS letter, bool_or(odd.cluster IS NOT NULL) AS merged
FROM c LEFT JOIN odd ON odd.puzzle = c.puzzle AND odd.cluster = c.cluster - c.cluster % 2 GROUP BY c.puzzle, c.cluster - c.cluster % 2
"""


@_query
def sign_hash_hamming(spark, sf_dir):
    """Each vector's sign hash against that of the first vector of its label."""
    h = table(spark, sf_dir, "embeddings").where("embedding is not null").select("label", "vec_id", geometry.sign_hash(F.col("embedding")).alias("hash"))
    seed = h.groupBy("label").agg(F.min_by("hash", "vec_id").alias("seed"))
    return h.join(seed, "label").select("vec_id", "hash", geometry.hamming(F.col("hash"), F.col("seed")).alias("distance"))


ORACLE_SQL["sign_hash_hamming"] = """
WITH h AS (SELECT label, vec_id, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS hash FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, hash, CAST(bit_count(xor(hash, first_value(hash) OVER (PARTITION BY label ORDER BY vec_id))) AS INT) AS distance FROM h
"""


@_query
def sorted_symbols(spark, sf_dir):
    """Symbols whose id contains e, by frequency; the place is the order's."""
    from pyspark.sql import Window

    s = mapping.filter_symbols(_letters(spark, sf_dir).withColumn("letter", F.upper("symbol_id")), "E")
    return s.select("lang", "letter", "n", F.row_number().over(Window.partitionBy("letter").orderBy(F.desc("n"), "lang")).alias("place"))


ORACLE_SQL["sorted_symbols"] = f"WITH {_LETTERS} SELECT lang, upper(symbol_id) AS letter, n, CAST(row_number() OVER (PARTITION BY symbol_id ORDER BY n DESC, lang) AS INT) AS place FROM letters WHERE symbol_id = 'e'"


@_query
def split_clusters(spark, sf_dir):
    """Labels are clusters of 64-vector puzzles; the largest of each puzzle (the first of equals) is led again."""
    s = _symbols(spark, sf_dir)
    members = s.select(F.floor(F.col("ord") / 64).cast("long").alias("puzzle"), "ord", F.col("puzzle").cast("int").alias("cluster"), "area", "aspect_ratio", "moments")
    sizes = members.groupBy("puzzle", "cluster").agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.groupBy("puzzle").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"))
    return clusters.split_clusters(members, chosen).select("puzzle", "ord", "cluster")


ORACLE_SQL["split_clusters"] = f"""
WITH {_SYMBOLS}, x AS (SELECT ord // 64 AS puzzle, CAST(puzzle AS INT) AS cluster, ord, area, ar, m FROM s),
n AS (SELECT puzzle, cluster, row_number() OVER (PARTITION BY puzzle ORDER BY count(*) DESC, cluster) AS i FROM x GROUP BY puzzle, cluster),
mine AS (SELECT x.* FROM x JOIN n ON n.i = 1 AND n.puzzle = x.puzzle AND n.cluster = x.cluster),
l AS (SELECT puzzle, list({{'ord': ord, 'area': area, 'ar': ar, 'm': m}} ORDER BY ord) AS r FROM mine GROUP BY puzzle),
f AS (SELECT puzzle, list_reduce(list_transform(r, lambda x: [x]), lambda k, x: CASE WHEN len(list_filter(k, lambda t: 1 / (1 + {_D.format(a='t', b='x[1]')}) >= 0.85)) > 0 THEN k ELSE k || x END) AS seeds FROM l),
seed AS (SELECT puzzle, part, t.ord AS ord, t.area AS area, t.ar AS ar, t.m AS m FROM (SELECT puzzle, unnest(seeds) AS t, generate_subscripts(seeds, 1) AS part FROM f)),
led AS (SELECT x.puzzle, x.ord, min(t.part) AS part FROM mine x JOIN seed t ON t.puzzle = x.puzzle AND t.ord <= x.ord AND 1 / (1 + {_D.format(a='t', b='x')}) >= 0.85 GROUP BY x.puzzle, x.ord)
SELECT x.puzzle, x.ord, CAST(coalesce((SELECT max(cluster) FROM x y WHERE y.puzzle = x.puzzle) + led.part, x.cluster) AS INT) AS cluster
FROM x LEFT JOIN led ON led.puzzle = x.puzzle AND led.ord = x.ord
"""
