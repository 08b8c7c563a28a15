"""Connected components over an edge table, by alternating large-star and small-star steps.

Each step is an aggregate (one minimum per node, partly computed before the
shuffle) and a join, and ends in a table in the shared folder, so that lineage
and plans stay short.  Rounds end when the edges are stars, each around its
smallest node; edges never reach the driver, only the number of nodes that are
in no such star.  The centre of a large star is one key of the join, with one row on
the other side: adaptive execution splits such a key (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop_table, fresh_path, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v.  Large: both directions, larger neighbours move; small: smaller neighbours move."""
    links = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    lowest = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = links.join(lowest, "u")
    moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _in_no_star(edges: DataFrame) -> int:
    """How many nodes of ``edges`` (u, v), u > v, have two smaller neighbours, or a smaller and a larger one; none: the edges are stars."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.max("e.down").alias("down"))
    return nodes.where("ups + down > 1 and ups > 0").count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v of longs); a component is named by its smallest node.

    Self-loops, repeated and reversed edges and nulls are allowed (rows with a
    null are ignored); an empty table gives an empty table.
    """
    spark, path = edges.sparkSession, fresh_path(edges.sparkSession, "edges")
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "edges", path)
    for _ in range(max_rounds):
        if not _in_no_star(now):
            break
        for large in (True, False):
            next_path = fresh_path(spark, "edges")
            after = saved(_star(now, large), "edges", next_path)
            drop_table(spark, path)
            now, path = after, next_path
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links within one task, as (node, smallest node) for every node but the smallest."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]
