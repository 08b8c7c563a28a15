"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Equal vectors form a class first, so a group of exact copies, however large,
costs one vector.  Class vectors are dealt to blocks by a hash, a row per block;
a task holds two blocks, normalises them and multiplies them as int8 matrices (each vector has a
scale of its own).  If e is the length of a vector's quantisation error, then
the product of two quantised vectors is off by at most e1 + (1 + e1) e2, so a
pair is surely linked, surely not, or recomputed in double precision.

A task never emits pairs: it returns, per vector, the number of its links (by
class sizes) and the links' components as stars.  A group of near copies thus
costs rows in proportion to its vectors.  The blocks' pairs cover all pairs of
distinct vectors, which exactness asks for: unit vectors of many dimensions
have no order by which a threshold on the cosine could skip them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors meet only vectors of their own length; rows that
repeat a vector, with or without its vec_id, are vectors of their own; rows with
a null vec_id link with nothing and have a null component; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved
from .components import connected_components, local_stars


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scales, lengths of the errors) of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error * (1 + 1e-12) + 1e-12


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, rows: int = 512):
    """Yields (positions in a, positions in b) of unit vectors with a cosine of at least ``threshold``; each pair of one block once per direction."""
    qa, sa, ea = quantise(a)
    qb, sb, eb = quantise(b)
    kind = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64  # sums of int8 products are exact in it
    right, most_b = qb.astype(kind).T.copy(), eb.max()
    for low in range(0, len(a), rows):
        some = slice(low, low + rows)
        product = qa[some].astype(kind) @ right
        loosest = (threshold - (ea[some] + (1 + ea[some]) * most_b)) / sa[some] * (1 - 1e-6) - 1e-6
        i, j = np.nonzero(product * sb.astype(kind)[None, :] >= loosest[:, None])
        if same:
            off = i + low != j
            i, j = i[off], j[off]
        if not len(i):
            continue
        about = product[i, j].astype(np.float64) * sa[i + low] * sb[j]
        bound = ea[i + low] + (1 + ea[i + low]) * eb[j]
        keep = about - bound >= threshold
        unsure = np.flatnonzero(~keep & (about + bound >= threshold))
        for at in range(0, len(unsure), 100_000):
            u = unsure[at : at + 100_000]
            keep[u] = np.einsum("ij,ij->i", a[i[u] + low], b[j[u]]) >= threshold
        yield i[keep] + low, j[keep]


def packed_blocks(classes: DataFrame, block_rows: int | None = None, block_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """(a table of one row per block of class vectors: dim, block, reps, sizes, vectors; the number of blocks).

    A block has at most about ``block_bytes`` of doubles, whatever the vectors'
    width, and there are enough blocks for four tiles a core, of 256 vectors or more.
    """
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    rows = block_rows or min(8192, max(64, block_bytes // (8 * max(width or 1, 1))))
    cores = classes.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // rows), 0 if block_rows else min(int((8 * cores) ** 0.5) + 1, -(-n // 256)))

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(x["vector"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"dim": x["dim"].iloc[:1], "block": x["block"].iloc[:1], "reps": [x["rep"].to_numpy(dtype=np.int64).tobytes()], "sizes": [x["n"].to_numpy(dtype=np.int64).tobytes()], "vectors": [vectors.tobytes()]})

    dealt = classes.select("rep", "n", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    return saved(dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, reps binary, sizes binary, vectors binary"), "vector-blocks"), blocks


def class_links(classes: DataFrame, threshold: float = 0.95, block_rows: int | None = None) -> DataFrame:
    """Rows (u, v, links): v set for an edge of a star, links set for a part of u's number of links.  ``classes``: rep, n, vector."""
    packed, blocks = packed_blocks(classes, block_rows)
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})

    def tile(x: pd.DataFrame) -> pd.DataFrame:
        first, second = int(x["a"].iloc[0]), int(x["b"].iloc[0])
        rep, n = (np.concatenate([np.frombuffer(v, dtype=np.int64) for v in x[c]]) for c in ("reps", "sizes"))
        block = np.repeat(x["block"].to_numpy(), [len(v) // 8 for v in x["reps"]])
        vectors = unit(np.concatenate([np.frombuffer(v, dtype=np.float64) for v in x["vectors"]]).reshape(len(rep), -1))
        ia, ib = np.flatnonzero(block == first), np.flatnonzero(block == second)
        links = np.zeros(len(rep), dtype=np.int64)
        us, vs, held = [], [], 0
        if len(ia) and len(ib):
            for i, j in tile_links(vectors[ia], vectors[ib], threshold, first == second):
                i, j = ia[i], ib[j]
                links += np.bincount(i, weights=n[j], minlength=len(rep)).astype(np.int64)
                if first != second:
                    links += np.bincount(j, weights=n[i], minlength=len(rep)).astype(np.int64)
                us.append(rep[i])
                vs.append(rep[j])
                held += len(i)
                if held > 1_000_000:
                    u, v = local_stars(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
        u, v = local_stars(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, dtype=np.int64),) * 2
        some = links > 0
        return pd.DataFrame({
            "u": np.concatenate([u, rep[some]]),
            "v": pd.array([*v.tolist(), *[None] * int(some.sum())], dtype="Int64"),
            "links": pd.array([*[None] * len(u), *links[some].tolist()], dtype="Int64"),
        })

    return dealt.groupBy("dim", "a", "b").applyInPandas(tile, "u long, v long, links long")


def embedding_components(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda c: c != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, F.col("embedding")).alias("vector"))
    classes = saved(rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    links = saved(class_links(classes, threshold), "vector-links")
    components = connected_components(links.where("v is not null").select("u", "v"))
    counts = links.where("links is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("others"))
    of_class = (
        classes.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
        .select(F.col("vector").alias("_v"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return rows.join(of_class, F.col("vector") == F.col("_v"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
