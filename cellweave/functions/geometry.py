"""Distances between symbol features, hashes, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_distance(a: Column, b: Column) -> Column:
    """0.2 relative area + 0.3 aspect ratio + 0.5 mean moment difference, of structs with area, aspect_ratio, moments."""
    area = F.coalesce(F.try_divide(F.abs(a["area"] - b["area"]), F.greatest(a["area"], b["area"])), F.lit(0.0))
    moments = F.zip_with(a["moments"], b["moments"], lambda x, y: F.abs(x - y))
    mean = F.coalesce(F.try_divide(F.aggregate(moments, F.lit(0.0), lambda s, x: s + x), F.size(moments)), F.lit(0.0))
    return 0.2 * area + 0.3 * F.abs(a["aspect_ratio"] - b["aspect_ratio"]) + 0.5 * mean


def feature_similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(values: Column) -> Column:
    """Bit i is set if component i is positive; up to 63 components."""
    bits = F.transform(F.slice(values, 1, 63), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)


def hu_log(h: Column) -> Column:
    return -F.signum(h) * F.log10(F.abs(h) + 1)


def frequency_confidence(a: Column, b: Column) -> Column:
    """1 - relative difference of two frequencies."""
    return 1 - F.least(F.coalesce(F.try_divide(F.abs(a - b), F.greatest(a, b)), F.lit(0.0)), F.lit(1.0))


def crossing(h, v) -> tuple[Column, Column, Column]:
    """(whether two lines are not parallel, x, y of where they cross); lines: structs, or dicts of columns, x1, y1, x2, y2."""
    den = (h["x1"] - h["x2"]) * (v["y1"] - v["y2"]) - (h["y1"] - h["y2"]) * (v["x1"] - v["x2"])
    t = F.try_divide((h["x1"] - v["x1"]) * (v["y1"] - v["y2"]) - (h["y1"] - v["y1"]) * (v["x1"] - v["x2"]), den)
    return F.abs(den) >= 1e-10, h["x1"] + t * (h["x2"] - h["x1"]), h["y1"] + t * (h["y2"] - h["y1"])


def line_intersection(h: Column, v: Column) -> Column:
    """Where two lines (structs x1, y1, x2, y2) cross; null if parallel."""
    meet, x, y = crossing(h, v)
    return F.when(meet, F.struct(x.alias("x"), y.alias("y")))


def line_kind(line: Column, tolerance: float = 10.0) -> Column:
    """'horizontal', 'vertical' or null by the line's angle in degrees."""
    angle = F.abs(F.degrees(F.atan2(line["y2"] - line["y1"], line["x2"] - line["x1"])))
    return F.when((angle <= tolerance) | (angle >= 180 - tolerance), F.lit("horizontal")).when(F.abs(angle - 90) <= tolerance, F.lit("vertical"))


def mean_difference_similarity(a: Column, b: Column) -> Column:
    """1 - mean absolute difference of two arrays of equal length with values in 0..1."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return 1 - F.try_divide(F.aggregate(d, F.lit(0.0), lambda s, x: s + x), F.size(d))
