"""Running numbers and sums along a key's order when one key may hold a third of all rows.

A window over such a key sorts all its rows in one task.  Here rows are dealt to
ranges of (key, order), so a large key spans several; numbers and sums run
within a range, and what came before a range is a prefix sum over its key's
ranges, of which there are at most as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import fresh_folder


def running_sums(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: its sum over the key's rows up to the row's own (nulls count as 0).

    ``order`` has to tell a key's rows apart.  The ranges are written as a table: their bounds are sampled, so they must not be drawn twice.
    """
    spark, path = rows.sparkSession, fresh_folder(rows.sparkSession, "ranges")
    valued = rows.withColumns({f"_of_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    valued.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    own = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_range", key).agg(*[F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums])
    ahead = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", F.col(key).alias("_key"), *[F.coalesce(F.sum(f"_all_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in sums])
    within = ranged.withColumns({f"_upto_{n}": F.sum(f"_of_{n}").over(own) for n in sums}).withColumnRenamed("_range", "_r")
    joined = within.join(before, (F.col("_r") == F.col("_range")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(*rows.columns, *[(F.col(f"_before_{n}") + F.col(f"_upto_{n}")).alias(n) for n in sums])


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "nth") -> DataFrame:
    """``name``: the row's number along its key's order, from 1."""
    return running_sums(rows, key, order, {name: F.lit(1).cast("long")})
