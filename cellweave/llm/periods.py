"""Periodic runs of words: every maximal stretch that repeats with a smallest period, by heavy/light lag counting.

Documents are independent, so this is a map over partitions without a shuffle.
A block of texts is handled at once.  First every lag's matches (words that
equal the word so many places on) are counted exactly: for words that are
frequent in their document by FFT autocorrelation, which costs the same however
often a word occurs, for all others by the differences of their positions.  A
run of period q needs at least max(q, 12 - q) matches at lag q; only lags with
so many are scanned for islands of consecutive matches.  From lag 16 on a scan
looks at every (q / 4)-th place first, since an island of q places holds four of
them in a row, so all scans of a text of n words take about n log n steps.

A stretch is reported with its smallest period: lags go up, and a stretch that was
found with a smaller one is not found again.  Nor is it scanned again at a
multiple of its period, so one word repeated a million times is no square.

Defined cases: null and empty texts, and texts of fewer words than a run, have no runs;
texts are handled whole, whatever their length: a block is at least one text, and holds
some dozen numbers for each of its words; rows that repeat are handled each; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbers, ragged, text_blocks

#: Shortest run, in words.
LEAST = 12
#: From this lag on a scan looks at some places first; numbers handled at a time.
SPARSE, AT_ONCE = 16, 2_000_000


def matches_needed(lag: np.ndarray | int):
    return np.maximum(lag, LEAST - lag)


def heavy_from(n: np.ndarray) -> np.ndarray:
    """Occurrences from which a word of a text of ``n`` words goes by FFT: a transform takes as long as so many squared position pairs."""
    size = np.maximum(2.0 * n, 2.0)
    return np.sqrt(size * np.log2(size)) / 2


def lag_counts(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, begins): matches of each text at each lag up to half its length; those of text d at lag q are at begins[d] + q.

    ``words`` holds all texts' words as numbers, ``ends`` where each text ends.
    """
    n = np.diff(np.concatenate([[0], ends]))
    sizes = n // 2 + 1
    begins = np.cumsum(sizes) - sizes
    counts = np.zeros(int(sizes.sum()), dtype=np.int64)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - np.repeat(ends - n, n)
    order = np.argsort(text * (int(words.max(initial=0)) + 1) + words, kind="stable")
    same = np.flatnonzero(np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])]))
    group_size = np.diff(np.concatenate([same, [len(order)]]))
    group_text = text[order[same]] if len(order) else same
    heavy = group_size > heavy_from(n[group_text])

    spectra: dict[int, np.ndarray] = {}
    for g in np.flatnonzero(heavy).tolist():
        d = int(group_text[g])
        size = 1 << int(n[d] + n[d] // 2).bit_length()  # no lag up to half wraps around
        where = np.zeros(size)
        where[place[order[same[g] : same[g] + group_size[g]]]] = 1
        spectra[d] = spectra.get(d, 0) + np.abs(np.fft.rfft(where)) ** 2
    for d, power in spectra.items():
        # sums of ones: exact after rounding, as the error is about 1e-15 log(n) times the number of words
        counts[begins[d] : begins[d] + sizes[d]] += np.rint(np.fft.irfft(power)[: sizes[d]]).astype(np.int64)

    # light words: each place with the next, the next but one, ... of its group, as long as they are within half the text
    group_end = np.repeat(same + group_size, group_size)
    at = np.flatnonzero(~np.repeat(heavy, group_size))
    place, text, step, held, size = place[order], text[order], 1, [], 0
    while len(at):
        at = at[at + step < group_end[at]]
        lag = place[at + step] - place[at]
        near = lag <= n[text[at]] // 2
        at, lag = at[near], lag[near]
        held.append(begins[text[at]] + lag)
        size += len(at)
        step += 1
        if size > AT_ONCE or not len(at):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, size = [], 0
    return counts, begins


def pieces_of(sizes: np.ndarray, most: int = AT_ONCE):
    """Slices of consecutive items whose sizes sum to about ``most``."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def islands(hit: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the stretches of consecutive hits that stay within one item."""
    fresh = np.concatenate([[True], item[1:] != item[:-1]]) if len(item) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(hit & (fresh | ~np.concatenate([[False], hit[:-1]])))
    last = np.flatnonzero(hit & np.concatenate([fresh[1:] | ~hit[1:], [True]]))
    return first, last - first + 1


def runs_of(words: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Per text that has any: its runs (start, length, period)."""
    n = np.diff(np.concatenate([[0], ends]))
    begin = ends - n
    counts, begins = lag_counts(words, ends)
    lag = np.arange(len(counts)) - np.repeat(begins, n // 2 + 1)
    enough = np.flatnonzero((lag > 0) & (counts >= matches_needed(lag)) & (np.repeat(n, n // 2 + 1) >= LEAST))
    text, lag = np.searchsorted(begins, enough, side="right") - 1, lag[enough]
    found: dict[int, dict[tuple[int, int], int]] = {}
    low = 1
    while low <= (lag.max() if len(lag) else 0):  # lags by powers of two: no lag is a multiple of another of its round
        now = (lag >= low) & (lag < 2 * low)
        d, q = text[now], lag[now]
        low *= 2
        if not len(d):
            continue
        if low <= SPARSE:
            lo, hi = np.zeros(len(d), dtype=np.int64), n[d] - q
        else:
            d, q, lo, hi = _chains(words, begin, n, d, q, found)
        for part in pieces_of(hi - lo):
            dd, qq, size = d[part], q[part], (hi - lo)[part]
            item = np.repeat(np.arange(len(size)), size)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - lo[part], size)
            where = begin[dd][item] + at
            first, length = islands(words[where] == words[where + qq[item]], item)
            whole = length >= matches_needed(qq[item[first]])
            rows = [(int(dd[item[f]]), int(qq[item[f]]), int(at[f]), int(k)) for f, k in zip(first[whole], length[whole])]
            for k, period, start, size_ in sorted(rows):
                found.setdefault(k, {}).setdefault((start, start + size_ + period), period)
    return {k: sorted((s, e - s, p) for (s, e), p in runs.items()) for k, runs in found.items()}


def _chains(words, begin, n, d, q, found):
    """The parts (text, lag, from, to) of the texts that may hold an island, told by every (q // 4)-th place; without stretches found before."""
    step = q // 4
    sizes = (n[d] - q + step - 1) // step
    kept: list[tuple[int, int, int, int]] = []
    longest = {k: sorted(((e - s, s, e, p) for (s, e), p in found[k].items()), reverse=True) for k in set(d.tolist()) if k in found}
    for part in pieces_of(sizes):
        dd, qq, ss, size = d[part], q[part], step[part], sizes[part]
        item = np.repeat(np.arange(len(size)), size)
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        where = begin[dd][item] + nth * ss[item]
        first, length = islands(words[where] == words[where + qq[item]], item)
        whole = length >= qq[item[first]] // ss[item[first]]
        for f, k in zip(first[whole].tolist(), length[whole].tolist()):
            i = item[f]
            text, lag, s = int(dd[i]), int(qq[i]), int(ss[i])
            a, z = int(nth[f]) * s, (int(nth[f]) + k - 1) * s
            known = False
            for size_, start, end, period in longest.get(text, ()):
                if size_ < 2 * lag:
                    break
                if lag % period == 0 and start <= a and z < end - lag:
                    known = True
                    break
            if not known:
                kept.append((text, lag, max(0, a - s + 1), min(z + s, int(n[text]) - lag)))
    return tuple(np.array(c, dtype=np.int64) for c in (zip(*kept) if kept else [[]] * 4))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's test data: of every tenth document the places from which its words come, the end being periodic."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def word_runs(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, runs (start, length, period; by start, then period), text: its words but for those of runs after their first period, with one space between."""
    def run(batches):
        for keys, texts in text_blocks(batches, 2, 1, most=3_000_000):
            number, all_words, spans = Numbers().__getitem__, [], []
            for key, text in zip(keys, texts):
                own = text.encode().split() if text else []  # by ASCII white space
                ids = np.fromiter(map(number, own), dtype=np.int64, count=len(own))
                places = planted(key, len(own)) if plant else None
                if places is not None:
                    own, ids = [own[i] for i in places.tolist()], ids[places]
                all_words.append(own)
                spans.append(ids)
            sizes = np.array([len(s) for s in spans])
            runs = runs_of(np.concatenate(spans), np.cumsum(sizes))
            kept = []
            for i, own in enumerate(all_words):
                if i in runs:
                    turn = np.zeros(len(own) + 1, dtype=np.int64)
                    for start, length, period in runs[i]:
                        turn[start + period] += 1
                        turn[start + length] -= 1
                    own = [own[j] for j in np.flatnonzero(np.cumsum(turn[:-1]) == 0).tolist()]
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs.get(i, [])] for i in range(len(keys))], type=RUNS), pa.array(kept, type=pa.string())],
                names=["doc_id", "runs", "text"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def run_report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per document: number of runs, the longest (of equals the first, then that of the smallest period), digests of all runs and of the text without repeats."""
    longest = F.expr("aggregate(runs, CAST(null AS struct<start: long, length: long, period: long>), (best, r) -> CASE WHEN best IS NULL OR r.length > best.length THEN r ELSE best END)")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return word_runs(docs, plant).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.expr("r.length * 1000 div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
