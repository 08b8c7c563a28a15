"""Mapping symbols to letters by rank of frequency, applying and checking a mapping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import frequency_confidence

# Letters of Portuguese by frequency in percent.
LETTER_FREQUENCY = {
    "A": 14.63, "E": 12.57, "O": 10.73, "S": 7.81, "R": 6.53, "I": 6.18, "N": 5.05, "D": 4.99, "M": 4.74, "U": 4.63, "T": 4.34, "C": 3.88, "L": 2.78,
    "P": 2.52, "V": 1.67, "G": 1.30, "H": 1.28, "Q": 1.20, "B": 1.04, "F": 1.02, "Z": 0.47, "J": 0.40, "X": 0.21, "K": 0.02, "W": 0.01, "Y": 0.01,
}


def letter_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LETTER_FREQUENCY.items()), "letter string, pct double")


def letter_counts(texts: DataFrame, group: str, text: str) -> DataFrame:
    """(group, symbol_id, n): how often each of the letters a to z is in a group's lower-cased texts; one pass, at most 26 rows of a batch's groups."""
    kind = dict(texts.dtypes)[group]

    def count(batches):
        for b in batches:
            codes, totals = b.column(0).dictionary_encode(), {}
            for k, t in zip(codes.indices.to_pylist(), b.column(1)):
                if t.is_valid:
                    n = np.bincount(np.frombuffer(t.as_buffer(), dtype=np.uint8), minlength=256)[97:123]
                    totals[k] = totals[k] + n if k in totals else n
            rows = [(k, chr(97 + i), int(n)) for k, counts in totals.items() for i, n in enumerate(counts) if n]
            at = pa.array([r[0] for r in rows], type=codes.indices.type)
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(at), pa.array([r[1] for r in rows], type=pa.string()), pa.array([r[2] for r in rows], type=pa.int64())], names=["group", "symbol_id", "n"])

    parts = texts.select(F.col(group), F.lower(text)).mapInArrow(count, f"group {kind}, symbol_id string, n long")
    return parts.groupBy(F.col("group").alias(group), "symbol_id").agg(F.sum("n").alias("n"))


def suggest(symbols: DataFrame, letters: DataFrame, group: str) -> DataFrame:
    """The nth most frequent symbol of a group gets the nth letter.

    symbols: group, symbol_id, n; ties by symbol_id, of letters by letter.  The
    letters are a table of 26 rows, broadcast.
    """
    all_ = Window.partitionBy(group)
    share = F.col("n") * 100 / F.sum("n").over(all_)
    ranked = symbols.withColumn("share", share).withColumn("rank", F.row_number().over(all_.orderBy(F.desc("n"), "symbol_id")))
    by_rank = letters.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pct"), "letter")))
    confidence = frequency_confidence(F.col("share"), F.col("pct"))
    return ranked.join(F.broadcast(by_rank), "rank").select(group, "symbol_id", F.col("letter").alias("suggested_letter"), confidence.alias("confidence"), "rank", F.format_string("%.2f%% vs %.2f%%", "share", "pct").alias("reason"))


def auto_mapping(suggestions: DataFrame, least: float = 0.7) -> DataFrame:
    return suggestions.where(F.col("confidence") >= least)


def apply_mapping(cells: DataFrame, mapping: DataFrame, group: str) -> DataFrame:
    """``user_value``: the mapped letter, '' without one; clue cells and cells without a symbol stay."""
    joined = cells.join(mapping.select(group, "symbol_id", F.col("letter").alias("_letter")), [group, "symbol_id"], "left")
    takes = ~F.col("is_clue") & F.col("symbol_id").isNotNull() & (F.col("symbol_id") != "")
    return joined.withColumn("user_value", F.when(takes, F.coalesce("_letter", F.lit(""))).otherwise(F.col("user_value"))).drop("_letter")


def row_text(cells: DataFrame, group: str) -> DataFrame:
    """The letters of each row, '_' where there is none; clues left out."""
    shown = F.when(F.coalesce("letter", F.lit("")) == "", "_").otherwise(F.col("letter"))
    return cells.where("not is_clue and symbol_id is not null").groupBy(group, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", shown.alias("s")))), lambda x: x["s"]), "").alias("text"))


def duplicates(mapping: DataFrame, group: str) -> DataFrame:
    """Letters that more than one symbol of a group has."""
    return mapping.where("letter <> ''").groupBy(group, "letter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unmapped(symbols: DataFrame, mapping: DataFrame, group: str) -> DataFrame:
    return symbols.join(mapping.where("letter <> ''"), [group, "symbol_id"], "left_anti")


def validate(symbols: DataFrame, mapping: DataFrame, group: str) -> DataFrame:
    """Per group: duplicate letters, values that are no letters, symbols without one, and whether the mapping is valid and complete.

    An empty letter leaves a symbol unmapped, but its mapping is there: it does not make the whole incomplete.
    """
    bad = mapping.where(~F.col("letter").rlike("(?iu)^[A-ZÀ-Ü]$") & (F.col("letter") != "")).groupBy(group).agg(F.count(F.lit(1)).alias("_bad"))
    twice = duplicates(mapping, group).groupBy(group).agg(F.count(F.lit(1)).alias("_twice"))
    missing = unmapped(symbols, mapping, group).groupBy(group).agg(F.count(F.lit(1)).alias("_missing"))
    absent = symbols.join(mapping.where("letter is not null"), [group, "symbol_id"], "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("_absent"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        symbols.select(group).distinct().join(bad, group, "left").join(twice, group, "left").join(missing, group, "left").join(absent, group, "left")
        .select(group, zero("_twice").alias("duplicates"), zero("_bad").alias("invalid"), zero("_missing").alias("unmapped"), ((zero("_twice") + zero("_bad")) == 0).alias("valid"), (zero("_absent") == 0).alias("complete"))
    )


def filter_symbols(symbols: DataFrame, wanted: str, numeric: bool = False) -> DataFrame:
    """Symbols whose letter (or id, in numeric mode) contains ``wanted``, in any case."""
    return symbols.where(F.lower("symbol_id" if numeric else "letter").contains(wanted.lower()))


def sort_symbols(symbols: DataFrame, by: str, absent: str = "Z") -> DataFrame:
    """By 'frequency' (falling), 'id' (as a number) or 'letter' (those without one count as ``absent``); ties by id."""
    order = {"frequency": F.desc("n"), "id": F.col("symbol_id").try_cast("long"), "letter": F.coalesce(F.nullif("letter", F.lit("")), F.lit(absent))}[by]
    return symbols.orderBy(order, "symbol_id")


def import_mapping(json_column):
    """An object as a map; null for arrays, scalars and broken text."""
    return F.when(F.trim(json_column).startswith("{"), F.from_json(json_column, "map<string,string>"))
