"""Repair of recognised digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels lie in 1..27; letters that recognisers take for digits.
MIN_LABEL, MAX_LABEL = 1, 27
LOOK_ALIKES = ("oOiIlL|zZsSbBgGqQ", "00111112255669999")


def in_range(n: Column, low: int = MIN_LABEL, high: int = MAX_LABEL) -> Column:
    return n.between(low, high)


def range_reason(n: Column, high: int = 26) -> Column:
    """Why a value is out of range; null if it is not."""
    return F.when(n < 1, F.format_string("Value %s < 1 (invalid)", n.cast("string"))).when(n > high, F.format_string(f"Value %s > {high} (likely OCR error)", n.cast("string")))


def sanitize_digits(raw: Column) -> Column:
    """Look-alike letters become digits, all else goes."""
    return F.regexp_replace(F.translate(raw, *LOOK_ALIKES), "[^0-9]", "")


def fix_spurious(n: Column) -> Column:
    """Labels stay; other two-digit numbers lose the second digit; the rest is null."""
    return F.when(in_range(n), n).when(n.between(10, 99), F.floor(n / 10).cast("int"))


def sanitize_number(raw: Column) -> Column:
    """Digits of a reading, two at most, as a label: repaired to the first or else the second digit where out of range."""
    digits = F.substring(F.regexp_replace(raw, "[^0-9]", ""), 1, 2)
    n = digits.try_cast("int")
    first, second = F.substring(digits, 1, 1).try_cast("int"), F.substring(digits, 2, 1).try_cast("int")
    return F.when(in_range(n), n).when(F.length(digits) == 2, F.when(in_range(first), first).when(in_range(second), second))


def strict_number(raw: Column) -> Column:
    """As :func:`sanitize_number` without repair: struct of the number and the digits it was read from."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    n = F.substring(digits, 1, 2).try_cast("int")
    return F.struct(F.when(in_range(n), n).alias("number"), digits.alias("digits"))


def js_round(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x + 0.5)


def rounded(name: str, decimals: int) -> Column:
    """``F.round`` of a column of doubles, up to 6 places.  Only numbers near a tie, large ones and those that are none take its way, through decimal text."""
    x, unit = F.col(name), F.lit(10.0**decimals)
    scaled = x * unit
    plain = (F.abs(x) < 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5).cast("double") / unit).otherwise(F.round(x, decimals))
