"""Runs of repeated words against a plain search of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cellweave.llm import periods


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_report(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + k for s, k, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(kept)))


def random_words(r):
    k, n = r.choice([1, 2, 2, 3, 5, 30]), r.choice([0, 1, 5, 11, 12, 13, 30, 100, 300])
    words = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randrange(3) if n > 20 else 0):
        a, p = r.randrange(n), r.randrange(1, n // 3)
        for i in range(a, r.randrange(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


def test_random_texts():
    r = random.Random(11)
    for _ in range(25):
        texts = [random_words(r) for _ in range(30)]
        got = periods.runs_of(np.array([w for t in texts for w in t], dtype=np.int64), np.cumsum([len(t) for t in texts]))
        assert [got.get(i, []) for i in range(30)] == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("from_", [0, 1e9])
def test_lag_counts(from_, monkeypatch):
    """All words by FFT, and none, give the same counts."""
    monkeypatch.setattr(periods, "heavy_from", lambda n: np.full(len(n), from_))
    r = random.Random(12)
    texts = [random_words(r) for _ in range(20)]
    counts, begins = periods.lag_counts(np.array([w for t in texts for w in t], dtype=np.int64), np.cumsum([len(t) for t in texts]))
    for t, b in zip(texts, begins):
        assert [sum(t[i] == t[i + q] for i in range(len(t) - q)) for q in range(1, len(t) // 2 + 1)] == counts[b + 1 : b + len(t) // 2 + 1].tolist()


def test_small_pieces(monkeypatch):
    monkeypatch.setattr(periods, "AT_ONCE", 7)
    test_random_texts()


def test_many_runs_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 2500:  # a word with as many runs as there can be, nearly
        a, b = b, b + a
    assert periods.runs_of(np.array(b), np.array([len(b)]))[0] == plain_runs(b)
    assert periods.runs_of(np.zeros(300_000, dtype=np.int64), np.array([300_000])) == {0: [(0, 300_000, 1)]}


def test_tables(spark):
    r = random.Random(13)
    texts = [None, "", " \n\t", "one", "a " * 12, "a " * 11, "x y " * 6 + "x", " ".join(map(str, range(3000))), "é\x1c\xa0 " * 30]
    texts += [" ".join(f"w{w}" for w in random_words(r)) for _ in range(150)]
    rows = [(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "a b " * 9, 2, "r"), (4, "a " * 40, 3, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, r string")
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 9
    got = sorted(map(tuple, periods.run_report(docs, plant=True).collect()), key=str)
    assert got == sorted((plain_report(i, t) for i, t, *_ in rows), key=str)
    assert sorted(map(tuple, periods.run_report(docs).collect()), key=str) == sorted((plain_report(i, t, False) for i, t, *_ in rows), key=str)
    assert periods.run_report(docs.limit(0)).count() == 0
    own = {x["doc_id"]: x for x in periods.word_runs(docs.where("doc_id = 6")).collect()}[6]
    assert [tuple(x) for x in own["runs"]] == [(0, 13, 2)] and own["text"] == "x y"
