"""Scoring predicted cells against a truth grid.

A comparison is a full outer join on the cell's key, so it shuffles both sides
once by that key; the metrics are one aggregate with partial sums.  Divisions
by zero give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("correct", "incorrect", "missed", "extra", "aborted")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def last_by_key(cells: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, that with the greatest ``order``: later rows replace earlier ones.  An aggregate, not a window."""
    rest = [c for c in cells.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return cells.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cells.columns if c not in keys])


def compare_cells(truth: DataFrame, predicted: DataFrame, keys: list[str], aborted: DataFrame | None = None) -> DataFrame:
    """keys, expected, actual, confidence, match for all cells that either side has a value for.

    truth: keys, expected; predicted: keys, actual, confidence, a row per key.
    ``aborted`` (a puzzle key column of ``keys`` and nothing else) lists puzzles
    of which every truth cell counts as aborted.
    """
    both = truth.join(predicted, keys, "full_outer")
    match = (
        F.when(F.col("expected").isNull(), "extra").when(F.col("actual").isNull(), "missed")
        .when(F.col("expected") == F.col("actual"), "correct").otherwise("incorrect")
    )
    scored = both.where("expected is not null or actual is not null").select(*keys, "expected", "actual", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), match.alias("match"))
    if aborted is None:
        return scored
    mine = aborted.columns
    lost = truth.join(aborted, mine, "left_semi").select(*keys, "expected", F.lit(None).cast(scored.schema["actual"].dataType).alias("actual"), F.lit(0.0).alias("confidence"), F.lit("aborted").alias("match"))
    return scored.join(aborted, mine, "left_anti").select(*scored.columns).unionByName(lost)


def match_counts(comparisons: DataFrame, by: list[str] = ()) -> DataFrame:
    return comparisons.groupBy(*by).agg(*[F.count_if(F.col("match") == m).alias(m) for m in MATCHES])


def with_metrics(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 and coverage.  Precision and recall leave out incorrect cells, by the measure's definition."""
    c, i, m, e = (F.col(x) for x in MATCHES[:4])
    p, r = ratio(c, c + e), ratio(c, c + m)
    return counts.withColumns({"accuracy": ratio(c, c + i + m), "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "coverage": ratio(c + i, c + i + m)})


def metrics(comparisons: DataFrame, by: list[str] = ()) -> DataFrame:
    return with_metrics(match_counts(comparisons, by))


def per_label_metrics(comparisons: DataFrame, low: int = 1, high: int = 27) -> DataFrame:
    """digit, tp, fp, fn, precision, recall, f1 for every label of the domain, zeros included."""
    votes = comparisons.where("match <> 'aborted'").select(F.explode(F.array(
        F.struct(F.col("expected").alias("digit"), F.when(F.col("match") == "correct", "tp").otherwise("fn").alias("kind")),
        F.struct(F.when(F.col("match").isin("extra", "incorrect"), F.col("actual")).alias("digit"), F.lit("fp").alias("kind")),
    )).alias("v")).select("v.*").where(F.col("digit").between(low, high))
    counts = votes.groupBy("digit").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    domain = comparisons.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("digit"))
    tp, fp, fn = (F.coalesce(F.col(k), F.lit(0)) for k in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return domain.join(counts, "digit", "left").select("digit", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def batch_metrics(per_puzzle: DataFrame) -> DataFrame:
    """Micro metrics over puzzles that are not aborted; total_puzzles counts all; the mean edit distance is NaN if all are aborted."""
    live = F.col("aborted") == 0
    sums = per_puzzle.agg(*[F.coalesce(F.sum(F.when(live, F.col(m))), F.lit(0)).alias(m) for m in MATCHES[:4]], F.sum(F.when(~live, F.col("aborted"))).alias("aborted"), F.count(F.lit(1)).alias("total_puzzles"), F.count_if(live).alias("scored_puzzles"), F.sum(F.when(live, F.col("edit_distance"))).alias("_d"))
    mean = F.when(F.col("scored_puzzles") == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("_d"), F.col("scored_puzzles")))
    return with_metrics(sums).withColumn("average_edit_distance", mean).drop("_d")


def macro_accuracy(per_puzzle: DataFrame) -> DataFrame:
    return per_puzzle.agg(F.avg("accuracy").alias("macro_accuracy"))


def edit_distances(sequences: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, edit_distance and its share of the longer sequence, of two string columns with one character per label."""
    longer = F.greatest(F.length(a), F.length(b))
    d = F.levenshtein(a, b)
    return sequences.select(key, d.alias("edit_distance"), ratio(d, longer).alias("normalized"))


def batch_summary(per_puzzle: DataFrame, key: str) -> DataFrame:
    """Puzzles that are not aborted, best accuracy first."""
    return per_puzzle.where("aborted = 0").orderBy(F.desc("accuracy"), key)


def trend(runs: DataFrame, key: str) -> DataFrame:
    """(timestamp, accuracy) of runs that are not aborted, in order of time."""
    return runs.where("not aborted").select(key, "timestamp", "accuracy").orderBy(key, "timestamp")
