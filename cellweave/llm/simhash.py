"""SimHash near-duplicates: fingerprints, linked by BK-trees over bounded shards.

1. Each task fingerprints its documents (64 bits).  Documents with one
   fingerprint form a class; only distinct fingerprints go on, so that a group
   of copies, however large, costs one row.
2. Two fingerprints that differ in at most ``radius`` bits agree on at least
   ``blocks - radius`` of ``blocks`` bit blocks.  Every fingerprint is dealt to
   one shard for each choice of that many blocks.
3. A shard's fingerprints form a BK-tree (children keyed by Hamming distance to
   their parent).  Each fingerprint walks the trees of its shards along the
   edges within the radius only.  A shard that holds more than
   ``tree_size`` fingerprints is split into several trees, and each tree meets
   the shard's fingerprints in pieces of that size, each in its own task group;
   no pair is lost and no group grows.
4. Links leave a task as stars, one row per node; components are found on Spark.

Trees are not broadcast whole: their number grows with the corpus.  A shard's
trees go, by shuffle, just to where its fingerprints are.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; a text of fewer words than a shingle is one shingle; rows that repeat a
doc_id are compared as rows; rows with a null doc_id are fingerprinted and linked
with nothing; an empty table gives an empty result; other columns, whatever their
names, are ignored by ``simhash_components`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import giving_back, saved
from .components import connected_components, local_stars

_SHIFTS = np.arange(8, dtype=np.uint64) * np.uint64(8)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text: bit set if set in over half of its shingles' XXH64 (seed 42)."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(s), 42) for s in zip(*(words[i:] for i in range(shingle)))]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)))[2 * ones > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for b in giving_back(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, type=pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def bk_forest(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees, one per value of ``group``, over distinct fingerprints; inserted level by level.

    Returns (root of each row's tree, edge keys in order, children): the key of
    an edge is ``parent * 65 + distance``.
    """
    _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
    root = first[inverse]
    waiting = np.flatnonzero(root != np.arange(len(fp)))
    at = root[waiting]
    keys, children = [], []
    while len(waiting):
        edge = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at])
        new, index, inverse = np.unique(edge, return_index=True, return_inverse=True)
        child = waiting[index]
        keys.append(new)
        children.append(child)
        at = child[inverse]
        stays = at != waiting
        waiting, at = waiting[stays], at[stays]
    keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    children = np.concatenate(children) if children else np.zeros(0, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    return root, keys[order], children[order]


def bk_search(query: np.ndarray, start: np.ndarray, fp: np.ndarray, keys: np.ndarray, children: np.ndarray, radius: int, at_once: int = 4096):
    """Yields (query positions, node positions) within ``radius``; walks only edges within the radius."""
    for low in range(0, len(query), at_once):
        q = np.arange(low, min(low + at_once, len(query)))
        node = start[q]
        while len(q):
            d = np.bitwise_count(query[q] ^ fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            if not len(keys):
                break
            wanted = (node * 65 + d)[:, None] + np.arange(-radius, radius + 1)
            inside = (wanted >= (node * 65)[:, None]) & (wanted <= (node * 65 + 64)[:, None])
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = inside & (keys[place] == wanted)
            node = children[place[found]]
            q = np.broadcast_to(q[:, None], found.shape)[found]


def fingerprint_links(distinct: DataFrame, radius: int = 2, blocks: int = 4, tree_size: int = 2048, at_once: int = 500_000) -> DataFrame:
    """Edges (u, v) of class representatives.  ``distinct``: (fp long, rep long), each fingerprint once.

    A task takes whole groups, about ``at_once`` rows of them at a time.
    """
    if not 0 <= radius < blocks or 64 % blocks:
        raise ValueError("radius must be below blocks, and blocks divide 64")
    width = 64 // blocks
    masks = []
    for choice in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << width) - 1) << (b * width) for b in choice)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    dealt = distinct.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "bits"))
    sizes = dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / F.lit(tree_size)).cast("int")
    shards = (
        dealt.join(sizes, ["choice", "bits"])  # singletons go here
        .withColumn("pieces", pieces)
        .withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("fp", "rep", "choice", "bits", "piece", F.least("piece", "other").alias("tree"), F.greatest("piece", "other").alias("walkers"))
        .repartition("choice", "bits", "tree", "walkers")
        .sortWithinPartitions("choice", "bits", "tree", "walkers")
    )
    group_of = ["choice", "bits", "tree", "walkers"]

    def whole_groups(frames):
        held, rows = [], 0
        for f in frames:
            held.append(f)
            rows += len(f)
            if rows >= at_once:
                x = pd.concat(held, ignore_index=True)
                ends = (x[group_of] == x[group_of].iloc[-1]).all(axis=1).to_numpy()
                if not ends.all():
                    yield x[~ends]
                held, rows = [x[ends]], int(ends.sum())
        if rows:
            yield pd.concat(held, ignore_index=True)

    def run(frames):
        for x in whole_groups(frames):
            yield from links_of(x.reset_index(drop=True))

    def links_of(x: pd.DataFrame):
        fp, rep = x["fp"].to_numpy().view(np.uint64), x["rep"].to_numpy()
        group = x.groupby(group_of, sort=False).ngroup().to_numpy()
        in_tree, walks = (x["piece"] == x["tree"]).to_numpy(), (x["piece"] == x["walkers"]).to_numpy()
        t, w = np.flatnonzero(in_tree), np.flatnonzero(walks)
        root, keys, children = bk_forest(fp[t], group[t])
        start = np.full(group.max() + 1, -1)
        start[group[t]] = root
        w = w[start[group[w]] >= 0]
        us, vs, held = [], [], 0
        for q, node in bk_search(fp[w], start[group[w]], fp[t], keys, children, radius):
            u, v = rep[w[q]], rep[t[node]]
            us.append(u[u != v])
            vs.append(v[u != v])
            held += len(us[-1])
            if held > 2_000_000:
                u, v = local_stars(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], len(u)
        if us:
            u, v = local_stars(np.concatenate(us), np.concatenate(vs))
            yield pd.DataFrame({"u": u, "v": v})

    return shards.mapInPandas(run, "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fp (signed long), component_id (smallest doc_id reachable, itself included).

    Rows with a null doc_id are fingerprinted and left alone (component null).
    """
    prints = saved(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = saved(distinct, "classes")
    found = connected_components(fingerprint_links(distinct, radius))
    of_class = distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_class.select("fp", F.col("component_id").alias("_c")), "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("_c")).alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose doc_id names its component: one document of each group stays, with all its columns.

    Rows that repeat a kept doc_id stay as they are; rows with a null doc_id stay.
    """
    gone = simhash_components(docs, shingle, radius, id_col, text_col).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`") == F.col("g.doc_id"), "left_anti")
