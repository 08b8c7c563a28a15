"""Training-set curation: quality gates, tiers, consistency, roll-ups, splits, strategy choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reason_prefix

# Tier limits and augmentations, gate limits.
HIGH, MEDIUM = (0.95, 10), (0.80, 5)


def quality_verdict(mean: Column, std: Column, sharpness: Column, empty: Column | None = None) -> Column:
    """The first gate that a cell image fails, or 'ok'."""
    gate = F.when(F.lit(False) if empty is None else empty, "empty_image")
    return gate.when(mean < 30, "too_dark").when(mean > 230, "too_bright").when(std < 5, "empty").when(sharpness < 50, "blurry").otherwise("ok")


def tier(confidence: Column) -> Column:
    return F.when(confidence >= HIGH[0], "high").when(confidence >= MEDIUM[0], "med")


def augmentations(confidence: Column) -> Column:
    return F.when(confidence >= HIGH[0], HIGH[1]).when(confidence >= MEDIUM[0], MEDIUM[1]).otherwise(0)


def digit_consistency(number: Column, raw_digits: Column, aspect_ratio: Column, skip_empty: bool = False) -> Column:
    """Why a label does not fit the reading or the cell's shape; null if it does."""
    wrong = F.length(raw_digits) != F.length(number.cast("string"))
    wrong = wrong & (F.length(raw_digits) > 0) if skip_empty else wrong
    return (
        F.when(wrong, F.format_string("digit_mismatch(%s!=%d)", raw_digits, number))
        .when((number < 10) & (aspect_ratio > 1.3), F.format_string("single_digit_too_wide(%.2f)", aspect_ratio))
        .when((number >= 10) & (aspect_ratio < 0.85), F.format_string("double_digit_too_narrow(%.2f)", aspect_ratio))
    )


def pseudo_label_report(labels: DataFrame) -> DataFrame:
    """Per number: rows by tier; the total has rejected rows too."""
    return labels.groupBy("number").agg(F.count_if(F.col("tier") == "high").alias("high"), F.count_if(F.col("tier") == "med").alias("med"), F.count(F.lit(1)).alias("total"))


def reason_counts(labels: DataFrame, reason: str = "error") -> DataFrame:
    """Rows by the part of the reason before its details, most first."""
    return labels.where(F.col(reason).isNotNull()).groupBy(reason_prefix(F.col(reason)).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def merge_reason_maps(reports: DataFrame, column: str = "rejection_reasons") -> DataFrame:
    """The sum of maps of counts, by reason."""
    return reports.select(F.explode(column).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def length_mismatches(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("status") == "ok") & (F.length("raw_digits") != F.length(F.col("number").cast("string"))))


def short_readings(labels: DataFrame) -> DataFrame:
    """Single-digit labels whose text had more characters than digits."""
    return labels.where((F.col("number") < 10) & (F.length(F.trim("raw_text")) >= 2) & (F.length("raw_digits") == 1))


def choose_strategy(readings: DataFrame, keys: list[str], sure: float = 0.95) -> DataFrame:
    """Of readings in order of ``strategy``: the first above ``sure``, else the best (the first of equals); invalid numbers do not count."""
    confident = F.col("confidence") > sure
    best = F.min_by(F.struct("strategy", "number", "confidence"), F.struct((~confident).alias("a"), F.when(confident, 0.0).otherwise(-F.col("confidence")).alias("b"), F.col("strategy").alias("c")))
    return readings.where("number is not null").groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def seeded_order(seed: int, *columns: str) -> Column:
    """A repeatable shuffle: order by this."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def stratified_split(items: DataFrame, stratum: str, id_col: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``split``: 'train' for the first max(1, floor(share n)) of each stratum, one less if that is all of two or more; else 'val'.

    A stratum may hold a third of all rows, so places are counted in two steps:
    within ranges of the shuffle's first three hex digits, and ranges by prefix sum.
    """
    marked = items.withColumn("_order", seeded_order(seed, id_col)).withColumn("_range", F.substring("_order", 1, 3))
    ranges = marked.groupBy(stratum, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(stratum).orderBy("_range")
    ranges = ranges.withColumns({"_before": F.sum("_n").over(w) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy(stratum))}).withColumnRenamed(stratum, "_stratum").withColumnRenamed("_range", "_r")
    placed = marked.join(ranges, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_range") == F.col("_r")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_order", id_col))
    cut = F.greatest(F.lit(1), F.floor(share * F.col("_all")))
    cut = F.when((F.col("_all") >= 2) & (cut == F.col("_all")), cut - 1).otherwise(cut)
    return placed.withColumn("split", F.when(place <= cut, "train").otherwise("val")).select(*items.columns, "split")


def plain_split(items: DataFrame, id_col: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """The same without strata."""
    return stratified_split(items.withColumn("_one", F.lit(1)), "_one", id_col, share, seed).drop("_one")


def union_items(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both, all rows; synthetic ones have the tier 'synthetic'."""
    return real.unionByName(synthetic.withColumn("tier", F.lit("synthetic")))


def label_counts(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Per label of any part its rows in each part, 0 where it has none."""
    rows = None
    for name, df in parts.items():
        part = df.select(F.col(label).alias("label"), F.lit(name).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("label").agg(*[F.count_if(F.col("part") == n).alias(n) for n in parts])


def output_names(items: DataFrame, prefix: str, order: str) -> DataFrame:
    """``name``: prefix, running number in order of the number ``order`` (null first), digit.

    Places are counted within about sqrt(n) ranges of one width, and ranges by
    prefix sum, so that no task sorts all rows.
    """
    value = F.col(order).cast("double")
    span = items.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_ranges"))
    at = F.when(value.isNull(), -1).when(F.col("_hi") > F.col("_lo"), F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_ranges"))).otherwise(0)
    marked = items.join(F.broadcast(span), F.lit(True)).withColumn("_range", at).drop("_lo", "_hi", "_ranges")  # one row
    counts = marked.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row per range
    n = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    placed = marked.join(before, F.col("_range") == F.col("_r"))
    return placed.withColumn("name", F.format_string("%s%05d_d%d.png", F.lit(prefix), n, F.col("digit"))).select(*items.columns, "name")


def violations(truth: DataFrame) -> DataFrame:
    """One row per rule that a truth grid breaks: (puzzle_id, rule)."""
    rows, cols = F.col("dimensions.rows"), F.col("dimensions.cols")
    values = F.filter(F.flatten("grid"), lambda v: v.isNotNull())
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "puzzleId": blank(F.col("puzzleId")), "sourceImage": blank(F.col("sourceImage")), "type": ~F.coalesce(F.col("type").isin("numeric", "pictogram"), F.lit(False)),
        "dimensions": F.coalesce((rows < 1) | (cols < 1), F.lit(True)), "rows": F.coalesce(F.size("grid") != rows, F.lit(True)), "cols": F.coalesce(F.exists("grid", lambda r: F.size(r) != cols), F.lit(True)),
        "valueRange": F.coalesce(F.exists(values, lambda v: (v < F.col("valueRange.min")) | (v > F.col("valueRange.max"))), F.lit(True)),
        "metadata": blank(F.col("metadata.validatedBy")) | blank(F.col("metadata.validatedAt")),
    }
    broken = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda r: r.isNotNull())
    return truth.select(F.col("puzzleId").alias("puzzle_id"), F.explode(broken).alias("rule"))


def frequency_mismatches(truth: DataFrame) -> DataFrame:
    """Numbers whose listed frequency is not that of the grid."""
    counted = truth.select("puzzleId", F.explode(F.flatten("grid")).alias("n")).where("n is not null").groupBy("puzzleId", "n").agg(F.count(F.lit(1)).alias("counted"))
    listed = truth.select("puzzleId", F.explode("frequency").alias("n", "listed")).withColumn("n", F.col("n").cast("int"))
    return counted.join(listed, ["puzzleId", "n"], "full_outer").where("not (counted <=> listed)")
