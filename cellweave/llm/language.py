"""Language identification by nearest centroid.

A text is a vector of TF-IDF weights of character 1- to 3-grams (lower-cased,
anything but letters as a blank, hashed to ``BUCKETS`` buckets), at length 1.
Each language has several centroids, found by spherical k-means on a bounded
sample of its labelled rows (about ``sample_per_language``, drawn by a hash; rows
that repeat count once), each language by a task of its own.  The weights' document
frequencies are counted over all labelled training rows; a task sends one row
of counts, whose size is the number of buckets.  Every labelled language is learned: the model
is at most 130 kB a language (``BUCKETS`` weights for each centroid), and texts
meet it in the tasks, so it grows with the languages and with nothing else.

A prediction is the language of the centroid with the largest cosine.  A text
that is farther from it than nearly all of its sample were (``quantile``) is
rejected: ``rejected`` is set and the score falls with the distance; with
``reject_as_und`` the prediction becomes ``und`` as well.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text if there is no labelled row; texts of any length are read whole;
repeated rows are predicted each; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8192


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """Counts of the hashed n-grams; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters[codes]
    if not is_letter.any():
        return None
    c = np.concatenate([[32], np.where(is_letter, codes, 32), [32]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]  # runs of blanks are one blank
    m1, m2, m3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
    one = c * m1
    two = one[:-1] ^ (c[1:] * m2)
    three = two[:-1] ^ (c[2:] * m3)
    grams = np.concatenate([one, two * m1 + m2, three * m2 + m3])
    return np.bincount((grams ^ (grams >> np.uint32(15))) * m1 >> np.uint32(19), minlength=BUCKETS)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """At most k unit centroids; starts at the row nearest the mean, then the row farthest from all chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return centres.astype(np.float32)


def train(labelled: DataFrame, centroids: int = 4, sample_per_language: int = 200, quantile: float = 0.01) -> dict | None:
    """The model from (doc_id, text, lang) rows without nulls in text and lang."""

    def frequencies(batches):
        letters, df, n = letter_table(), np.zeros(BUCKETS, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                counts = gram_counts(t, letters)
                if counts is not None:
                    df += counts > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64()), pa.array([df], type=pa.list_(pa.int64()))], names=["n", "df"])

    parts = labelled.select("text").mapInArrow(frequencies, "n long, df array<long>")
    # element-wise sums: as many rows as buckets, whatever the input
    found = parts.select(F.posexplode(F.array_append("df", F.col("n")))).groupBy("pos").agg(F.sum("col").alias("df")).collect()
    df = np.zeros(BUCKETS + 1)
    for r in found:
        df[r["pos"]] = r["df"]
    if not df[-1]:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32)

    # a row per language: far smaller than the model, which holds some vectors for each and goes to all tasks as well
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.xxhash64(F.lit("sample"), "doc_id", "text")
    share = F.pmod(draw, F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.join(F.broadcast(sizes), "lang").where(share < F.lit(float(sample_per_language)) / F.col("n"))
    # rows that repeat are drawn alike; one of them is enough, so that about sample_per_language rows a language meet in a task
    sample = drawn.groupBy("lang", "doc_id", draw.alias("draw")).agg(F.min("text").alias("text")).select("draw", "lang", "text")

    def sparse(batches):
        letters = letter_table()
        for b in batches:
            keys, langs, at, value = [], [], [], []
            for k, lang, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                counts = gram_counts(t, letters)
                if counts is not None:
                    keys.append(k), langs.append(lang), at.append(np.flatnonzero(counts).astype(np.int32)), value.append(counts[counts > 0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(langs, type=pa.string()), pa.array(at, type=pa.list_(pa.int32())), pa.array(value, type=pa.list_(pa.int32()))], names=["draw", "lang", "at", "value"])

    def centres_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("draw").head(2 * sample_per_language)
        counts = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for i, (at, value) in enumerate(zip(rows["at"], rows["value"])):
            counts[i, at] = value
        x = weigh(counts, idf)
        own = spherical_kmeans(x, centroids)
        sims = x @ own.T
        nearest = np.argmax(sims, axis=1)
        limits = [float(np.quantile(mine, quantile)) if len(mine := sims[nearest == c, c]) else 0.0 for c in range(len(own))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "n": range(len(own)), "centre": [c.tobytes() for c in own], "edge": limits})

    drawn_counts = sample.mapInArrow(sparse, "draw long, lang string, at array<int>, value array<int>")
    rows = sorted(drawn_counts.groupBy("lang").applyInPandas(centres_of, "lang string, n int, centre binary, edge double").collect())
    if not rows:
        return None
    names = sorted({r["lang"] for r in rows})
    number = {n: i for i, n in enumerate(names)}
    return {"idf": idf, "centres": np.stack([np.frombuffer(r["centre"], dtype=np.float32) for r in rows]), "names": names, "of": np.array([number[r["lang"]] for r in rows]), "limits": np.array([r["edge"] for r in rows])}


def predict(docs: DataFrame, model: dict | None, sharpness: float = 20.0, reject_as_und: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, rejected for (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors per language

    def run(batches):
        m, letters = shared.value, letter_table()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts = [gram_counts(t, letters) if m else None for t in part.column(1).to_pylist()]
                lang, score, far = ["und"] * len(counts), np.zeros(len(counts)), np.zeros(len(counts), dtype=bool)
                some = [i for i, c in enumerate(counts) if c is not None]
                if some:
                    sims = weigh(np.stack([counts[i] for i in some]), m["idf"]) @ m["centres"].T
                    best = np.argmax(sims, axis=1)
                    top = sims[np.arange(len(some)), best].astype(np.float64)
                    by_lang = np.stack([sims[:, m["of"] == i].max(axis=1) for i in range(len(m["names"]))], axis=1).astype(np.float64)
                    weight = np.exp(sharpness * (by_lang - by_lang.max(axis=1, keepdims=True)))
                    sure = weight.max(axis=1) / weight.sum(axis=1)
                    limit = m["limits"][best]
                    far[some] = top < limit
                    score[some] = np.clip(sure * np.where(top < limit, np.maximum(top, 0) / np.maximum(limit, 1e-9), 1), 0, 1)
                    for i, c in zip(some, best):
                        lang[i] = "und" if reject_as_und and far[i] else m["names"][m["of"][c]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(far, type=pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the identifier as text falls in ``fold``; a null identifier is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, folds: int = 3, fold: int = 1, **options) -> DataFrame:
    """Trains on the rows outside ``fold`` that have text and lang, and predicts all: doc_id, held_out, lang_pred, score, rejected."""
    model = train(docs.where(~held_out(F.col("doc_id"), folds, fold) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang")), **options)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score", "rejected")
