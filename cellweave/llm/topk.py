"""Exact top-k by inner product: a KD-tree per shard, searched best box first.

Rows are numbered once, in a table.  Vectors are dealt to shards of about
``shard_rows`` rows by a hash of that number, queries to blocks of ``query_block``.  A task holds one shard and
one block.  A shard's tree splits at medians of its widest dimension and keeps
a tight bounding box per node; a query walks boxes from the highest possible
inner product down and stops when no box can reach its kth score.  First every
query searches the shard it lives in; that kth score then goes along to all
other shards and prunes them from the start.

The queries are a stated set and meet all rows in blocks: the work is
queries x shards, and no row is broadcast or collected.

Defined cases: vectors that are null or hold null or non-finite components take
no part; an empty vector scores nothing; vectors meet only vectors of their own
length; rows that repeat a vec_id are rows of their own: each is a candidate for
all others, and each query row gets ranks of its own; rows with a null vec_id
take no part; ties go to the smaller vec_id; with fewer than k candidates all
are returned; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

LEAF = 256


class KdTree:
    """Median splits of the widest dimension; nodes in arrays, leaves are row ranges of the reordered points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.low, self.high, self.child, self.range = [], [], [], []
        work = [(0, len(points), -1)]
        while work:
            a, b, parent = work.pop()
            here = points[order[a:b]]
            low, high = here.min(axis=0), here.max(axis=0)
            me = len(self.child)
            self.low.append(low)
            self.high.append(high)
            self.range.append((a, b))
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(me)
            if b - a > leaf and (high > low).any():
                dim, mid = int(np.argmax(high - low)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(here[:, dim], mid)]
                work += [(a, a + mid, me), (a + mid, b, me)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]

    def search(self, queries: np.ndarray, query_rows: np.ndarray, k: int, floor: np.ndarray):
        """Yields (query position, ids, scores) of at most k hits not below ``floor`` each, without the query's own row."""
        # the highest inner product that any point of a node's box can have, for all queries and nodes at once
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for q, vector in enumerate(queries):
            bound, kth = bounds[q], floor[q]
            best_s, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < kth:  # an equal bound may hold a smaller vec_id
                    break
                if self.child[node]:
                    for c in self.child[node]:
                        if bound[c] >= kth:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                a, b = self.range[node]
                scores, ids = self.points[a:b] @ vector, self.ids[a:b]
                good = (scores >= kth) & (self.rows[a:b] != query_rows[q])
                if not good.any():
                    continue
                best_s, best_i = np.concatenate([best_s, scores[good]]), np.concatenate([best_i, ids[good]])
                if len(best_s) > k:
                    keep = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[keep], best_i[keep]
                if len(best_s) == k:
                    kth = max(kth, best_s.min())
            yield q, best_i, best_s


def _search(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    empty = pd.DataFrame({"query_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    if not len(vectors) or not len(queries) or not len(vectors["v"].iloc[0]):
        return empty
    points, wanted = np.stack(vectors["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    largest = float(max(np.abs(points).max(), 1)) * float(max(np.abs(wanted).max(), 1)) * points.shape[1]
    kind = np.float64 if largest < 2**53 else np.int64  # doubles hold these sums exactly
    tree = KdTree(points.astype(kind), vectors["vec_id"].to_numpy(), vectors["row"].to_numpy())
    floor = queries["floor"].fillna(-np.inf).to_numpy(dtype=np.float64)
    ids, rows = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
    found = [(q, i, s) for q, i, s in tree.search(wanted.astype(kind), rows, k, floor) if len(i)]
    if not found:
        return empty
    at = np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found])
    hits, scores = np.concatenate([i for _, i, _ in found]), np.concatenate([s for _, _, s in found]).astype(np.int64)
    return pd.DataFrame({"query_row": rows[at], "query_id": ids[at], "vec_id": hits, "score": scores})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 16384, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score.  Both inputs: (row long, vec_id long, v array<long>) as :func:`whole_vectors` numbers and keeps them."""
    vectors, queries = vectors.where("vec_id is not null"), queries.where("vec_id is not null")
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    blocks = max(1, -(-queries.count() // query_block))
    keyed = vectors.select("row", "vec_id", "v", F.size("v").alias("dim"), shard.alias("shard"))
    block = F.pmod(F.xxhash64(F.lit(1), F.col("row")), F.lit(blocks)).cast("int")
    asked = saved(queries.select("row", "vec_id", "v", F.size("v").alias("dim"), shard.alias("home"), block.alias("block")), "topk-queries")
    schema = "query_row long, query_id long, vec_id long, score long"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left, right, k)

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    at_home = keyed.groupBy("dim", "shard").cogroup(asked.withColumn("floor", F.lit(None).cast("double")).withColumnRenamed("home", "shard").groupBy("dim", "shard")).applyInPandas(search, schema)
    at_home = saved(at_home, "topk-home")
    floors = at_home.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select("query_row", F.when(F.col("n") >= k, F.col("s")).cast("double").alias("floor"))
    away = (
        asked.join(floors, asked["row"] == floors["query_row"], "left").drop("query_row")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    )
    spread = keyed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rest = spread.groupBy("dim", "shard", "block").cogroup(away.groupBy("dim", "shard", "block")).applyInPandas(search, schema)
    return at_home.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(row, vec_id, v), a table of numbered rows: each component x as floor(scale * x), for vectors whose components are all finite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    kept = embeddings.where(ok)
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return saved(kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")), "vectors")
