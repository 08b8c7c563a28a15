"""Templates of symbols as queries: embeddings are images of numbers, 32 of them a puzzle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import templates as ops
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _images(spark, sf_dir):
    """puzzle, ord, number, confidence, pixels (0..1) of every vector."""
    pixels = F.transform("embedding", lambda x: F.least(F.greatest(x.cast("double") * 2 + 0.5, F.lit(0.0)), F.lit(1.0)))
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.floor(F.col("vec_id") / 32).cast("long").alias("puzzle"), F.col("vec_id").alias("ord"), F.when(F.col("vec_id") % 11 > 0, (1 + F.col("label") % 27).cast("int")).alias("number"), (F.col("vec_id") * 37 % 100 / 100).alias("confidence"), pixels.alias("pixels"))


_IMAGES = """
i AS (
  SELECT vec_id // 32 AS puzzle, vec_id AS ord, CASE WHEN vec_id % 11 > 0 THEN CAST(1 + label % 27 AS INT) END AS number, vec_id * 37 % 100 / 100 AS confidence,
    list_transform(embedding, lambda x: least(greatest(CAST(x AS DOUBLE) * 2 + 0.5, 0.0), 1.0)) AS px
  FROM embeddings WHERE embedding IS NOT NULL)
"""
_ALIKE = "1 - list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2]))) / len({a})"


@_query
def template_diversity(spark, sf_dir):
    """up to three templates of a number, each unlike those before."""
    return ops.diverse_templates(_images(spark, sf_dir), below=0.80)


ORACLE_SQL["template_diversity"] = f"""
WITH {_IMAGES}, l AS (SELECT puzzle, number, list({{'ord': ord, 'px': px}} ORDER BY ord) AS r FROM i WHERE number IS NOT NULL AND confidence >= 0.5 GROUP BY puzzle, number),
f AS (SELECT puzzle, number, list_reduce(list_transform(r, lambda x: [x]), lambda k, x: CASE WHEN len(k) < 3 AND len(list_filter(k, lambda t: {_ALIKE.format(a='t.px', b='x[1].px')} >= 0.80)) = 0 THEN k || x ELSE k END) AS k FROM l)
SELECT puzzle, number, t.ord AS ord FROM (SELECT puzzle, number, unnest(k) AS t FROM f)
"""


@_query
def template_match(spark, sf_dir):
    """Each cell without a number against its puzzle's sure ones."""
    i = _images(spark, sf_dir)
    found = ops.best_matches(i.where("number is null"), i.where("number is not null and confidence >= 0.5"))
    return found.select("puzzle", "ord", "matched", F.round("score", 9).alias("score"))


ORACLE_SQL["template_match"] = f"""
WITH {_IMAGES}, s AS (SELECT a.puzzle, a.ord, t.number AS matched, {_ALIKE.format(a='a.px', b='t.px')} AS score, t.ord AS o FROM i a JOIN i t ON t.puzzle = a.puzzle AND t.number IS NOT NULL AND t.confidence >= 0.5 WHERE a.number IS NULL)
SELECT puzzle, ord, matched, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY puzzle, ord ORDER BY score DESC, o) AS n FROM s) WHERE n = 1
"""


@_query
def confusion_match(spark, sf_dir):
    """Unsure cells against the templates of the numbers that theirs is taken for."""
    i = _images(spark, sf_dir)
    pairs = spark.createDataFrame([(n, a) for n, alts in ops.CONFUSION_PAIRS.items() for a in alts], "number int, alt int")
    found = ops.best_matches(i.where("confidence < 0.6 and number is not null"), i.where("number is not null and confidence >= 0.5"), pairs)
    return found.select("puzzle", "ord", "matched", F.round("score", 9).alias("score"))


_PAIRS = ", ".join(f"({n}, {a})" for n, alts in ops.CONFUSION_PAIRS.items() for a in alts)
ORACLE_SQL["confusion_match"] = f"""
WITH {_IMAGES}, p(n, alt) AS (VALUES {_PAIRS}),
s AS (
  SELECT a.puzzle, a.ord, t.number AS matched, {_ALIKE.format(a='a.px', b='t.px')} AS score, t.ord AS o
  FROM i a JOIN p ON p.n = a.number JOIN i t ON t.puzzle = a.puzzle AND t.number = p.alt AND t.confidence >= 0.5 WHERE a.confidence < 0.6)
SELECT puzzle, ord, matched, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY puzzle, ord ORDER BY score DESC, o) AS n FROM s) WHERE n = 1
"""


@_query
def template_bank(spark, sf_dir):
    """The bank grows in the cells' order, a puzzle at a time."""
    return ops.build_bank(_images(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


def _bank_sql() -> str:
    """A fold over a puzzle's cells: each is judged by the templates among those before it."""
    own = lambda n: f"list_filter(k, lambda t: t.keep AND t.n = {n})"
    best = f"list_max(list_transform({own(26)}, lambda t: {_ALIKE.format(a='x[1].px', b='t.px')}))"
    fixed = f"(x[1].n IN (2, 12) AND x[1].conf < 0.40 AND len({own(26)}) >= 2 AND coalesce({best}, 0) > 0.80)"
    kept = lambda n, conf: f"(coalesce({conf} >= 0.50 AND {n} IS NOT NULL, false) AND len({own(n)}) < 3 AND len(list_filter({own(n)}, lambda t: {_ALIKE.format(a='x[1].px', b='t.px')} >= 0.85)) = 0)"
    row = lambda n, conf: f"{{'ord': x[1].ord, 'n': {n}, 'conf': {conf}, 'px': x[1].px, 'keep': {kept(n, conf)}}}"
    first = "[{'ord': CAST(-1 AS BIGINT), 'n': CAST(NULL AS INT), 'conf': CAST(0 AS DOUBLE), 'px': CAST([] AS DOUBLE[]), 'keep': false}]"
    return f"""
b AS (SELECT puzzle, list({{'ord': ord, 'n': CASE WHEN number BETWEEN 1 AND 27 THEN number WHEN number BETWEEN 10 AND 99 THEN number // 10 END, 'conf': CAST(confidence AS DOUBLE), 'px': px, 'keep': false}} ORDER BY ord) AS r FROM i GROUP BY puzzle),
f AS (SELECT puzzle, list_reduce(list_prepend({first}, list_transform(r, lambda x: [x])), lambda k, x: k || [CASE WHEN {fixed} THEN {row('CAST(26 AS INT)', best)} ELSE {row('x[1].n', 'x[1].conf')} END]) AS k FROM b),
bank AS (SELECT puzzle, t.ord AS ord, t.n AS number, t.conf AS confidence, t.keep AS template, t.px AS px FROM (SELECT puzzle, unnest(k) AS t FROM f) WHERE t.ord >= 0)"""


ORACLE_SQL["template_bank"] = f"WITH {_IMAGES}, {_bank_sql()} SELECT puzzle, ord, number, round(confidence, 9) AS confidence, template FROM bank"


@_query
def template_correct(spark, sf_dir):
    """A chain of C5, J14 and J15."""
    return ops.correct(_images(spark, sf_dir)).select("puzzle", "ord", "number", F.round("confidence", 9).alias("confidence"), "corrected")


def _pass_sql(n: int, cells: str, templates: str, accept: str, among: str = "") -> str:
    """Pass n: the cells' best matches, and the table with those that are accepted."""
    return f"""
m{n} AS (
  SELECT puzzle, ord, matched, score FROM (
    SELECT a.puzzle, a.ord, t.number AS matched, {_ALIKE.format(a='a.px', b='t.px')} AS score, row_number() OVER (PARTITION BY a.puzzle, a.ord ORDER BY score DESC, t.ord) AS nth
    FROM now{n - 1} a JOIN {templates} t ON t.puzzle = a.puzzle {among} WHERE {cells}) WHERE nth = 1),
now{n} AS MATERIALIZED (
  SELECT a.puzzle, a.ord, CASE WHEN coalesce({accept}, false) THEN m.matched ELSE a.number END AS number, CASE WHEN coalesce({accept}, false) THEN m.score ELSE a.confidence END AS confidence, a.corrected OR coalesce({accept}, false) AS corrected, a.px
  FROM now{n - 1} a LEFT JOIN m{n} m ON m.puzzle = a.puzzle AND m.ord = a.ord)"""


ORACLE_SQL["template_correct"] = f"""
WITH {_IMAGES}, {_bank_sql()}, p(n, alt) AS (VALUES {_PAIRS}),
temp AS MATERIALIZED (SELECT * FROM bank WHERE template), now0 AS MATERIALIZED (SELECT puzzle, ord, number, confidence, false AS corrected, px FROM bank),
{_pass_sql(1, "a.confidence < 0.60", "temp", "a.confidence < 0.60 AND m.score > a.confidence + 0.15", "JOIN p ON p.n = a.number AND p.alt = t.number")},
{_pass_sql(2, "a.number IS NULL", "temp", "a.number IS NULL AND m.score > 0.70")},
{_pass_sql(3, "a.confidence < 0.50 AND a.number IS NOT NULL", "temp", "a.confidence < 0.50 AND m.matched <> a.number AND m.score > 0.75")},
sure AS MATERIALIZED (SELECT * FROM temp WHERE (puzzle, number) IN (SELECT (puzzle, number) FROM now3 WHERE confidence >= 0.70 AND number IS NOT NULL)),
{_pass_sql(4, "a.confidence < 0.60", "sure", "a.confidence < 0.60 AND m.score > a.confidence + 0.20")}
SELECT puzzle, ord, number, round(confidence, 9) AS confidence, corrected FROM now4
"""


@_query
def frequency_correct(spark, sf_dir):
    """C6's unused step: rare unsure numbers become similar frequent ones."""
    i = _images(spark, sf_dir)
    return ops.correct_by_frequency(i, i.where("number is not null and confidence >= 0.5")).where("corrected").select("puzzle", "ord", "number", F.round("confidence", 9).alias("confidence"))


ORACLE_SQL["frequency_correct"] = f"""
WITH {_IMAGES}, n AS (SELECT puzzle, number, count(*) AS n FROM i WHERE number IS NOT NULL GROUP BY puzzle, number),
s AS (
  SELECT a.puzzle, a.ord, t.number AS matched, {_ALIKE.format(a='a.px', b='t.px')} AS score
  FROM i a JOIN n r ON r.puzzle = a.puzzle AND r.number = a.number AND r.n <= 2 JOIN i t ON t.puzzle = a.puzzle AND t.confidence >= 0.5 JOIN n m ON m.puzzle = t.puzzle AND m.number = t.number AND m.n >= 4
  WHERE a.confidence < 0.6)
SELECT puzzle, ord, matched AS number, round(score, 9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY puzzle, ord ORDER BY matched DESC, score DESC) AS k FROM s WHERE score > 0.70) WHERE k = 1
"""
