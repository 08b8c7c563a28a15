"""Clustering of symbols by feature distance.

The leader pass depends on the order of symbols, so it runs per puzzle in
``applyInPandas``; a puzzle is a few hundred symbols.  Everything after it is
joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import feature_distance


def leader_pass(symbols: DataFrame, similarity: float = 0.85) -> DataFrame:
    """(puzzle, ord, cluster): in order, a symbol seeds a cluster and takes all later free ones similar enough to the seed.

    Equal hashes count once: the first of them; the others have no cluster yet.
    """

    def lead(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("ord").drop_duplicates("hash").reset_index(drop=True)
        area, ratio, moments = x["area"].to_numpy(), x["aspect_ratio"].to_numpy(), np.stack(x["moments"].to_numpy())
        cluster, n = np.full(len(x), -1), 0
        for seed in range(len(x)):
            if cluster[seed] >= 0:
                continue
            top = np.maximum(area, area[seed])
            d = 0.2 * np.divide(np.abs(area - area[seed]), top, out=np.zeros(len(x)), where=top > 0) + 0.3 * np.abs(ratio - ratio[seed]) + 0.5 * np.abs(moments - moments[seed]).mean(axis=1)
            take = (cluster < 0) & (1 / (1 + d) >= similarity)
            take[:seed] = False
            take[seed] = True
            cluster[take] = n
            n += 1
        return pd.DataFrame({"puzzle": x["puzzle"], "ord": x["ord"], "cluster": cluster})

    return symbols.groupBy("puzzle").applyInPandas(lead, "puzzle long, ord long, cluster int")


def cluster_means(members: DataFrame, by: list[str]) -> DataFrame:
    """Element-wise means of the features of each cluster."""
    width = 7
    return members.groupBy(*by).agg(F.avg("area").alias("area"), F.avg("aspect_ratio").alias("aspect_ratio"), F.array(*[F.avg(F.get("moments", F.lit(i))) for i in range(width)]).alias("moments"), F.count(F.lit(1)).alias("members"))


def nearest_centroid(symbols: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """(key, ord, cluster): the nearest centroid of the symbol's key, the lowest number of equals."""
    c = centroids.select(F.col(key).alias("_k"), F.col("cluster"), F.struct("area", "aspect_ratio", "moments").alias("_c"))
    s = symbols.select(key, "ord", F.struct("area", "aspect_ratio", "moments").alias("_s"))
    return s.join(c, s[key] == c["_k"]).groupBy(key, "ord").agg(F.min_by("cluster", F.struct(feature_distance(F.col("_s"), F.col("_c")), "cluster")).alias("cluster"))


def cluster_symbols(symbols: DataFrame, similarity: float = 0.85) -> DataFrame:
    """Leader pass, one reassignment to the means before it, then means again; empty clusters drop and the others close up: (puzzle, cluster, members, representative, area, aspect_ratio, moments)."""
    led = leader_pass(symbols, similarity).join(symbols, ["puzzle", "ord"])
    old = cluster_means(led, ["puzzle", "cluster"])
    placed = nearest_centroid(symbols, old, "puzzle").join(symbols, ["puzzle", "ord"])
    numbers = placed.select("puzzle", F.col("cluster").alias("_old")).distinct().withColumn("_new", F.row_number().over(Window.partitionBy("puzzle").orderBy("_old")) - 1)
    means = cluster_means(placed, ["puzzle", "cluster"])
    near = placed.join(old.select("puzzle", "cluster", F.struct("area", "aspect_ratio", "moments").alias("_c")), ["puzzle", "cluster"])
    representative = near.groupBy("puzzle", "cluster").agg(F.min_by("ord", F.struct(feature_distance(F.struct("area", "aspect_ratio", "moments"), F.col("_c")), "ord")).alias("representative"))
    found = means.join(representative, ["puzzle", "cluster"]).withColumnRenamed("cluster", "_old").join(numbers, ["puzzle", "_old"])
    return found.withColumn("cluster", F.col("_new").cast("int")).drop("_old", "_new")


def merge_clusters(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Clusters whose id is in ``mapping`` (cluster -> into) become one: sizes add, the first letter that is set, by cluster, stays."""
    m = mapping.select("puzzle", F.col("cluster").alias("_from"), F.col("into"))
    pairs = clusters.alias("c").join(m.alias("m"), (F.col("c.puzzle") == F.col("m.puzzle")) & (F.col("c.cluster") == F.col("m._from")), "left")
    moved = pairs.select(F.col("c.puzzle"), F.coalesce("into", "cluster").alias("cluster"), F.col("cluster").alias("_was"), "cluster_letter", "members", F.col("_from").isNotNull().alias("merged"))
    return moved.groupBy("puzzle", "cluster").agg(F.sum("members").alias("members"), F.min_by("cluster_letter", F.when(F.col("cluster_letter").isNotNull(), F.col("_was"))).alias("letter"), F.bool_or("merged").alias("merged"))


def split_clusters(members: DataFrame, chosen: DataFrame, similarity: float = 0.85) -> DataFrame:
    """``members`` (puzzle, ord, cluster, features) with one cluster of each puzzle of ``chosen`` (puzzle, cluster) led again: its parts take new numbers after the puzzle's last, the others stay."""
    marked = members.join(chosen.select("puzzle", "cluster", F.lit(True).alias("_split")), ["puzzle", "cluster"], "left")
    mine = marked.where("_split").drop("_split")
    parts = leader_pass(mine.withColumn("hash", F.col("ord").cast("string")), similarity).select("puzzle", "ord", F.col("cluster").alias("_part"))
    last = members.groupBy("puzzle").agg(F.max("cluster").alias("_last"))
    moved = mine.join(parts, ["puzzle", "ord"]).join(last, "puzzle").withColumn("cluster", (F.col("_last") + 1 + F.col("_part")).cast("int")).drop("_part", "_last")
    return marked.where("_split is null").drop("_split").unionByName(moved)


def merge_by_features(clusters: DataFrame, similarity: float = 0.85) -> DataFrame:
    """Re-clusters clusters by their means: symbols of one cluster share features and stay together."""
    again = clusters.select("puzzle", F.col("cluster").cast("long").alias("ord"), F.col("cluster").cast("string").alias("hash"), "area", "aspect_ratio", "moments")
    return leader_pass(again, similarity)
