"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A token has a word input (a hashed embedding) and a character input (mean and
maximum of the embeddings of its hashed 3- to 6-grams, word borders included),
so that unseen words built from known stems are understood.  Two GRUs read a
window of ``WINDOW`` tokens in both directions, attention pools their states,
and a logistic output scores the window.  All windows of a text, overlapping by
half, are scored; the text's score is the highest.

Training (by one task, so that no texts come to the driver) uses a bounded sample
of labelled rows, at most ``positives`` and ``negatives`` of them, the same at every
size of input: rows with the smallest hash of their identifier.  Labels are for texts, so each round
trains on the window of each text that scores highest so far.  The schedule is
one formula: a batch is a 24th of the sample, 16 to ``batch`` windows, and there
are as many rounds as make ``steps`` steps, ``rounds`` to four times that.
Scoring is a map over partitions.

Defined cases: null and empty texts are one window without tokens and get the
network's score for that; labels that are null are no labels; of labels that
repeat a doc_id the highest counts; without labels of both kinds the score is
the share of toxic labels (0 if none); an empty table gives an empty result;
repeated rows are scored each; of texts that repeat a labelled doc_id the smallest
is learned; other columns, whatever their names, are ignored by ``toxicity`` and
kept by ``drop_toxic``.
"""

from __future__ import annotations

import multiprocessing
import pickle
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbers, ragged
from .language import held_out

WINDOW, STEP, HIDDEN, ATTEND, SIZE = 32, 16, 8, 8, 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 16
ORDERS = (3, 4, 5, 6)
TOKEN = re.compile(r"[^\W_]+")


def word_inputs(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of all their n-grams one after the other, number of n-grams of each); each word has one at least."""
    if not words:
        return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int64)
    parts = [_word_inputs(words[a : a + at_once]) for a in range(0, len(words), at_once)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[word] - place
    grams, owners = [], []
    h = codes.copy()
    for n in range(2, ORDERS[-1] + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] if len(h) > 1 else h[:0]
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            ok = left[: len(h)] >= n
            grams.append(((h[ok] * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(48)).astype(np.uint16))  # GRAM_BUCKETS of them
            owners.append(word[: len(h)][ok])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    # the whole word's bucket: a hash over all its characters
    weight = np.power(np.uint64(0x100000001B3), place.astype(np.uint64))
    whole = np.add.reduceat(codes * weight, np.cumsum(lengths) - lengths)
    bucket = ((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.uint16)  # WORD_BUCKETS of them
    return bucket, grams[order], np.bincount(owners, minlength=len(words))


def windows(tokens: np.ndarray) -> np.ndarray:
    """Token numbers of all overlapping windows, shifted by one; 0 fills the end."""
    n = len(tokens)
    count = 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STEP)
    padded = np.zeros((count - 1) * STEP + WINDOW, dtype=np.int32)
    padded[:n] = tokens + 1
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters in ``p``; the passes over windows of word numbers (0: none)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        norm = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"Ew": (0.1 * r.standard_normal((WORD_BUCKETS, SIZE))).astype(np.float32), "Ec": (0.1 * r.standard_normal((GRAM_BUCKETS, SIZE))).astype(np.float32), "Wa": norm(2 * HIDDEN, ATTEND), "va": norm(ATTEND), "wo": norm(2 * HIDDEN), "bo": np.full(1, -2, dtype=np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": norm(3 * SIZE, 3 * HIDDEN), f"U{d}": norm(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}

    def word_blocks(self, bucket: np.ndarray, grams: np.ndarray, counts: np.ndarray, at_once: int = 20_000):
        """The input vectors of words, so many at a time."""
        ends = np.cumsum(counts)
        for low in range(0, len(bucket), at_once):
            high = min(low + at_once, len(bucket))
            begin = ends[low] - counts[low]
            e = self.p["Ec"][grams[begin : ends[high - 1]]]
            at, out = ends[low:high] - counts[low:high] - begin, np.empty((high - low, 3 * SIZE), dtype=np.float32)
            out[:, :SIZE] = self.p["Ew"][bucket[low:high]]
            out[:, SIZE : 2 * SIZE] = np.add.reduceat(e, at, axis=0) / counts[low:high, None]
            out[:, 2 * SIZE :] = np.maximum.reduceat(e, at, axis=0)
            yield out

    def words(self, inputs) -> np.ndarray:
        """The input vector of each word."""
        return np.concatenate([np.zeros((0, 3 * SIZE), dtype=np.float32), *self.word_blocks(*inputs)])

    def gates(self, blocks) -> tuple[np.ndarray, np.ndarray]:
        """Input parts of both directions' gates, by word number, from blocks of input vectors; number 0 is no word."""
        parts = {d: [np.zeros((1, 3 * HIDDEN), dtype=np.float32)] for d in "fb"}
        for x in blocks:
            for d in "fb":
                parts[d].append(x @ self.p[f"W{d}"] + self.p[f"b{d}"])
        return tuple(np.concatenate(parts[d]) for d in "fb")

    def forward(self, gates, idx: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what backward() needs."""
        mask = (idx > 0).astype(np.float32)
        states, steps = [], {}
        for d, g, times in (("f", gates[0], range(WINDOW)), ("b", gates[1], range(WINDOW - 1, -1, -1))):
            U, h = self.p[f"U{d}"], np.zeros((len(idx), HIDDEN), dtype=np.float32)
            out = np.empty((WINDOW, len(idx), HIDDEN), dtype=np.float32)
            for t in times:
                x, m = g[idx[:, t]], mask[:, t, None]
                u = h @ U
                zr = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                new = h + m * (1 - z) * (n - h)
                if keep:
                    steps[d, t] = (h, z, r, n, u[:, 2 * HIDDEN :])
                h = out[t] = new
            states.append(out)
        s = np.concatenate(states, axis=2)
        a = np.tanh(s @ self.p["Wa"])
        e = np.where(mask.T > 0, a @ self.p["va"], -1e9)
        w = np.exp(e - e.max(axis=0)) * mask.T
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * s).sum(axis=0)
        logits = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logits, (mask, steps, s, a, w, pooled)) if keep else logits

    def backward(self, idx, kept, dlogit: np.ndarray, size: int):
        """Gradients of the parameters above the words, and of both gate tables (with ``size`` rows)."""
        mask, steps, s, a, w, pooled = kept
        g = {"wo": pooled.T @ dlogit, "bo": dlogit.sum(keepdims=True)}
        dp = dlogit[:, None] * self.p["wo"]
        dw = (s * dp).sum(axis=2)
        ds = w[:, :, None] * dp
        de = w * (dw - (w * dw).sum(axis=0))
        g["va"] = np.einsum("tb,tba->a", de, a)
        da = de[:, :, None] * self.p["va"] * (1 - a * a)
        g["Wa"] = np.einsum("tbs,tba->sa", s, da)
        ds = ds + da @ self.p["Wa"].T
        tables = []
        order = np.argsort(idx.T.ravel(), kind="stable")
        found = idx.T.ravel()[order]
        begins = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        for k, (d, times) in enumerate((("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW)))):
            U = self.p[f"U{d}"]
            dU, each = np.zeros_like(U), np.empty((WINDOW, len(idx), 3 * HIDDEN), dtype=np.float32)
            dh = np.zeros((len(idx), HIDDEN), dtype=np.float32)
            for t in times:
                h, z, r, n, un = steps[d, t]
                m = mask[:, t, None]
                dh = dh + ds[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                dU += h.T @ du
                each[t] = dx
                dh = dh * (1 - m * (1 - z)) + du @ U.T
            g[f"U{d}"] = dU
            table = np.zeros((size, 3 * HIDDEN), dtype=np.float32)
            table[found[begins]] = np.add.reduceat(each.reshape(-1, 3 * HIDDEN)[order], begins, axis=0)
            tables.append(table)
        return g, tables


def log_odds(texts: list[np.ndarray], labels: np.ndarray, of_words, buckets: int) -> np.ndarray:
    """Per bucket, the log-odds of being in a toxic text, for a start of the embeddings; ``of_words`` gives the buckets of word numbers."""
    counts = np.zeros((2, buckets))
    for t, y in zip(texts, labels):
        counts[int(y), np.unique(of_words(t))] += 1
    total = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    rate = (counts + 0.5 * total / total.sum()) / (total + 1)
    seen = counts.sum(axis=0)
    return np.clip(np.log(rate[1] / rate[0]) * seen / (seen + 4), -2, 4)  # few texts say little


def train(texts: list[str | None], labels: list[int], rounds: int = 8, batch: int = 128, steps: int = 300, rate: float = 0.01, seed: int = 7) -> dict:
    """The network's parameters, with an output shifted so that a score of 0.3 parts the sample's texts best."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return {"prior": float(y.mean()) if len(y) else 0.0}
    r = np.random.default_rng(seed)
    back = r.random(len(y)) < 0.2  # a fifth is held back and sets the threshold
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    numbers = Numbers()
    tokens = [np.array([numbers[w] for w in TOKEN.findall((t or "").lower())], dtype=np.int64) for t in texts]
    bucket, grams, counts = word_inputs(list(numbers))
    begins = np.cumsum(counts) - counts
    of_words = lambda w: ragged(grams, begins[w], counts[w])
    net = Network(seed)
    distinct = [np.unique(t) for t in tokens]
    filled = [i for i, t in enumerate(distinct) if len(t) and not back[i]]
    some = [distinct[i] for i in filled]
    net.p["Ec"][:, 0] = log_odds(some, y[filled], of_words, GRAM_BUCKETS) / 2
    net.p["Ew"][:, 0] = log_odds(some, y[filled], bucket.__getitem__, WORD_BUCKETS) / 2
    every = [windows(t) for t in tokens]
    starts = np.cumsum([0] + [len(e) for e in every])
    with_empty = np.concatenate([*every, np.zeros((1, WINDOW), dtype=np.int32)])
    idx = with_empty[:-1]
    del every, tokens, numbers, distinct, some
    blocks = lambda: net.word_blocks(bucket, grams, counts)
    hint = np.concatenate([[-3], *(x[:, 2 * SIZE] + x[:, 0] for x in blocks())])  # the first round takes the windows with the most telling words
    scores = np.concatenate([np.sort(hint[idx[a : a + 8192]], axis=1)[:, -3:].sum(axis=1) for a in range(0, len(idx), 8192)])
    del hint
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("Ew", "Ec")}
    square = {k: np.full(net.p[k].shape, 1e-2, dtype=np.float32) for k in ("Ew", "Ec")}
    step = 0
    batch = min(batch, max(16, len(y) // 24))
    rounds = max(rounds, min(4 * rounds, -(-steps * batch // max(len(y), 1))))
    for _ in range(rounds):
        best = np.array([s + int(np.argmax(scores[s:e])) for s, e, b in zip(starts, starts[1:], back) if not b])
        other = np.array([r.integers(s, e) for s, e, label, b in zip(starts, starts[1:], y, back) if not label and not b])
        empty = np.full(max(1, len(other) // 20), len(idx))  # windows without tokens are clean
        chosen, goal = np.concatenate([best, other, empty]), np.concatenate([y[~back], np.zeros(len(other) + len(empty), dtype=np.float32)])
        order = r.permutation(len(chosen))
        weight = np.where(goal > 0, min(5.0, float((goal == 0).sum() / (goal > 0).sum())), 1.0).astype(np.float32)
        for low in range(0, len(order), batch):
            take = order[low : low + batch]
            used, local = np.unique(with_empty[chosen[take]], return_inverse=True)
            local = local.reshape(len(take), WINDOW)
            if used[0] == 0:
                used = used[1:]
            else:
                local = local + 1
            w = used.astype(np.int64) - 1
            spans = counts[w]
            from_gram = of_words(w)
            mine = (bucket[w], from_gram, spans)
            xin = net.words(mine)
            logits, kept = net.forward(net.gates([xin]), local, keep=True)
            dlogit = ((sigmoid(logits) - goal[take]) * weight[take] / len(take)).astype(np.float32)
            grads, tables = net.backward(local, kept, dlogit, len(w) + 1)
            dx = np.zeros_like(xin)
            for d, table in zip("fb", tables):
                grads[f"W{d}"], grads[f"b{d}"] = xin.T @ table[1:], table[1:].sum(axis=0)
                dx += table[1:] @ net.p[f"W{d}"].T
            step += 1
            for k, v in grads.items():
                m1, m2 = moment[k]
                m1 *= 0.9
                m1 += 0.1 * v
                m2 *= 0.999
                m2 += 0.001 * v * v
                net.p[k] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            if len(w):
                e = net.p["Ec"][from_gram]
                at = np.repeat(np.arange(len(w)), spans)
                top = (e == xin[at, 2 * SIZE :]) * dx[at, 2 * SIZE :]
                for key, rows, grad in (("Ew", mine[0], dx[:, :SIZE]), ("Ec", from_gram, dx[at, SIZE : 2 * SIZE] / spans[at, None] + top)):
                    own, inverse = np.unique(rows, return_inverse=True)
                    order_of = np.argsort(inverse, kind="stable")
                    total = np.add.reduceat(grad[order_of], np.searchsorted(inverse[order_of], np.arange(len(own))), axis=0)
                    square[key][own] += total * total
                    net.p[key][own] -= 0.05 * total / np.sqrt(square[key][own])
        gates = net.gates(blocks())
        scores = np.concatenate([net.forward(gates, idx[a : a + 4096]) for a in range(0, len(idx), 4096)])
    text_scores = np.maximum.reduceat(scores, starts[:-1])
    cuts = np.unique(text_scores)
    cuts = np.concatenate([cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2])
    judged = back if back.any() else np.ones(len(y), dtype=bool)
    ranked = np.sort(text_scores[judged & (y == 1)]), np.sort(text_scores[judged & (y == 0)])
    caught = 1 - np.searchsorted(ranked[0], cuts) / len(ranked[0])
    clean = np.searchsorted(ranked[1], cuts) / len(ranked[1])
    good = caught + 10 * clean  # a percent of the clean texts lost costs as much as a tenth of the toxic ones kept
    best = np.flatnonzero(good >= good.max() - 1e-12)
    net.p["bo"] = net.p["bo"] + np.float32(np.log(0.3 / 0.7) - cuts[best[len(best) // 2]])
    return net.p


class Scorer:
    """Scores blocks of texts; keeps the gates of words between blocks up to ``keep`` words."""

    def __init__(self, params: dict, keep: int = 200_000):
        self.params, self.keep = params, keep
        if "prior" not in params:
            self.net = Network.__new__(Network)
            self.net.p = params
        self._clear()

    def _clear(self) -> None:
        self.numbers = Numbers()
        self.gates = tuple(np.zeros((1, 3 * HIDDEN), dtype=np.float32) for _ in "fb")

    def score(self, texts: list[str | None], at_once: int = 2048) -> np.ndarray:
        if "prior" in self.params:
            return np.full(len(texts), self.params["prior"])
        if len(self.numbers) > self.keep:
            self._clear()
        number, known = self.numbers.__getitem__, len(self.numbers)
        every = [windows(np.array(list(map(number, TOKEN.findall(t.lower()))) if t else [], dtype=np.int64)) for t in texts]
        if len(self.numbers) > known:
            more = self.net.gates(self.net.word_blocks(*word_inputs(list(self.numbers)[known:])))
            self.gates = tuple(np.concatenate([old, new[1:]]) for old, new in zip(self.gates, more))
        starts = np.cumsum([0] + [len(e) for e in every])
        idx = np.concatenate(every)
        logits = np.concatenate([self.net.forward(self.gates, idx[a : a + at_once]) for a in range(0, len(idx), at_once)])
        return sigmoid(np.maximum.reduceat(logits, starts[:-1]).astype(np.float64))


def training_sample(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 3000, folds: int = 4, fold: int = 2) -> DataFrame:
    """(doc_id, toxic, text) of at most so many labelled rows outside ``fold``, by the smallest hashes of their identifiers; of rows that repeat one, the smallest text."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("draw", F.xxhash64(F.lit("toxicity"), "doc_id"))
    ids = marks.where("toxic = 1").orderBy("draw").limit(positives).unionByName(marks.where("toxic = 0").orderBy("draw").limit(negatives))
    # at most positives + negatives rows: safe to broadcast whatever the input
    return docs.select("doc_id", "text").join(F.broadcast(ids.select(F.col("doc_id").alias("_id"), "toxic")), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def in_a_child(work: Callable[[], object]) -> bytes:
    """What ``work`` returns, pickled, from a process of its own: the worker that Spark keeps for later tasks does not keep the memory that it took."""
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)

    def run() -> None:
        try:
            there.send_bytes(b"+" + pickle.dumps(work()))
        except BaseException as e:
            there.send_bytes(b"-" + repr(e).encode())

    child = context.Process(target=run)
    child.start()
    there.close()
    try:
        answer = here.recv_bytes()
    except EOFError:
        answer = b"-the process ended without an answer"
    child.join()
    if answer[:1] == b"-":
        raise RuntimeError(answer[1:].decode("utf-8", "replace"))
    return answer[1:]


def trained(docs: DataFrame, labels: DataFrame, **options) -> dict:
    """The network's parameters, learned from :func:`training_sample` by one task: the driver gets parameters, no texts."""

    def run(batches):
        rows = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))), key=lambda r: r[0])
        params = in_a_child(lambda: train([text for _, _, text in rows], [toxic for _, toxic, _ in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([params], type=pa.binary())], names=["params"])

    row = training_sample(docs, labels, **options).coalesce(1).mapInArrow(run, "params binary").first()
    return pickle.loads(row["params"]) if row else train([], [])


def score(docs: DataFrame, params: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for (doc_id, text); with all columns of ``docs`` beside them see :func:`drop_toxic`."""
    shared = docs.sparkSession.sparkContext.broadcast(params)  # of the network's size

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, type=pa.float64()), pa.array((s >= threshold).astype(np.int32), type=pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, positives: int = 1500, negatives: int = 3000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    params = trained(docs, labels, positives=positives, negatives=negatives, folds=folds, fold=fold)
    return score(docs, params, threshold).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Rows of ``docs``, with their columns, whose text scores below ``threshold``."""
    params = trained(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(params)
    text_at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield part.filter(pa.array(scorer.score(part.column(text_at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
