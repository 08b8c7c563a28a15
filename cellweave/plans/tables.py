"""The driver's tables, and grids made of them.

``cells`` reads lineitem as recognised cells: twelve orders are a puzzle, an
order is a row of it, a line number a column; of rows for one cell the one with
the greatest price counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import last_by_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 12).cast("long").alias("puzzle"), (F.col("l_orderkey") % 12).cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"),
        F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"), (1 + F.col("l_partkey") % 27).cast("int").alias("number"), (F.col("l_discount") * 10).alias("confidence"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """puzzle, row, col, number, confidence."""
    return last_by_key(raw_cells(spark, sf_dir), ["puzzle", "row", "col"], ["price", "part", "confidence"]).select("puzzle", "row", "col", "number", "confidence")


CELLS_SQL = """
raw_cells AS (
  SELECT CAST(floor(l_orderkey / 12) AS BIGINT) AS puzzle, CAST(l_orderkey % 12 AS INT) AS row, CAST(l_linenumber AS INT) AS col,
         CAST(1 + l_partkey % 27 AS INT) AS number, l_discount * 10 AS confidence,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey DESC, l_discount DESC) AS nth
  FROM lineitem),
cells AS (SELECT puzzle, row, col, number, confidence FROM raw_cells WHERE nth = 1)
"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal per user: events by hour since 1970 (user_id, pos, amplitude)."""
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id", at.alias("pos")).agg(F.count(F.lit(1)).alias("amplitude"))


HOURS_SQL = """
hours AS (
  SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pos, count(*) AS amplitude
  FROM events GROUP BY ALL)
"""
