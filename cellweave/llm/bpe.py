"""Byte-level BPE encoding and decoding with a pair occurrence index.

Documents are independent, so this is a map over partitions without a shuffle.
Within a task the distinct pre-tokens of a block of texts are encoded together:
an index maps each adjacent pair to all its positions, the pairs' ranks are
taken in ascending order, all of a rank's positions merge at once, and the
lists of the pairs to their left and right are updated.  (A merge makes pairs of
higher rank only, because a pair of the new token was learned after it; so
ascending order over all words is each word's own order.)  Words once encoded
are kept for the rest of the partition, up to a stated number.

Defined cases: null and empty texts have no tokens; texts are encoded whole,
whatever their length; the special token's string in a text is the special
token, as in the library that the vocabulary file is for; rows that repeat are
encoded each; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the byte-level vocabulary's texts are cut before merging: a fixed value of the vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same cuts by the standard library, about twice as fast, for texts of characters below U+0250 on which its classes agree with Unicode's.
SIMPLE_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_SIMPLE = "[\x1c-\x1f\xb2\xb3\xb9\xbc\xbd\xbe]|[^\x00-\u024f]"

#: Characters of texts, and bytes of new words, that a task encodes at once: they set what a worker keeps of memory for later tasks.
TEXT_CHARACTERS, WORD_BYTES = 1_000_000, 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[s : s + n]``, one after the other."""
    if not len(starts):
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class BytePairs:
    """A vocabulary: merge ranks, token bytes, special tokens."""

    def __init__(self, definition: str):
        data = json.loads(definition)
        model, alphabet = data["model"], byte_alphabet()
        vocab = model["vocab"]
        specials = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort((self.left << 32) | self.right, kind="stable")
        self.pair_keys, self.pair_ranks = ((self.left << 32) | self.right)[order], order
        self.byte_id = np.zeros(256, dtype=np.int32)
        for char, b in alphabet.items():
            self.byte_id[b] = vocab[char]
        size = max([*vocab.values(), *specials.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(alphabet[c] for c in token)
        for token, i in specials.items():
            spelled[i] = token.encode()
        self.specials = specials
        self.split = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.token_bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.token_length = np.array([len(t) for t in spelled], dtype=np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.pattern, self.simple, self.not_simple = regex.compile(PRETOKEN), re.compile(SIMPLE_PRETOKEN), re.compile(NOT_SIMPLE)

    def pretokens(self, text: str) -> list[str]:
        return (self.pattern if self.not_simple.search(text) else self.simple).findall(text)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(ids)
        place = np.int32 if n < 1 << 31 else np.int64
        following, previous = np.arange(1, n + 1, dtype=place), np.arange(-1, n - 1, dtype=place)
        if n:
            ends = np.cumsum(lengths)[lengths > 0] - 1
            following[ends] = -1
            previous[np.concatenate([[0], ends[:-1] + 1])] = -1
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}  # rank of a pair: its positions, in parts
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self.ranks(ids[at], ids[following[at]])
            known = rank >= 0
            at, rank = at[known].astype(place), rank[known].astype(np.int32)
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = 0
            for end in [*cuts.tolist(), len(at)]:
                r = int(rank[begin])
                if r in index:
                    index[r].append(at[begin:end])
                else:
                    index[r] = [at[begin:end]]
                    heapq.heappush(active, r)
                begin = end

        note(np.flatnonzero(following >= 0))
        while active:
            r = heapq.heappop(active)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
            right = following[at]
            ok = alive[at] & (ids[at] == self.left[r]) & (right >= 0)
            ok &= ids[np.maximum(right, 0)] == self.right[r]
            at, right = at[ok], right[ok]
            if self.left[r] == self.right[r] and len(at) > 1:  # in a run of equal tokens every other position merges, from the left
                linked = np.concatenate([[False], right[:-1] == at[1:]])
                heads = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                every_other = (np.arange(len(at)) - heads) % 2 == 0
                at, right = at[every_other], right[every_other]
            if not len(at):
                continue
            ids[at] = self.merged[r]
            alive[right] = False
            after = following[right]
            following[at] = after
            previous[after[after >= 0]] = at[after >= 0]
            before = previous[at]
            note(np.unique(np.concatenate([before[before >= 0], at[after >= 0]])))
        begins = np.cumsum(lengths) - lengths
        left = np.concatenate([[0], np.cumsum(alive)])
        return ids[alive], left[begins + lengths] - left[begins]

    def decode(self, ids: np.ndarray) -> str:
        return ragged(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes().decode("utf-8", "replace")


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pieces_of(words, most: int):
    """The words as UTF-8, in lists of about ``most`` bytes; a longer word is whole."""
    held, size = [], 0
    for w in words:
        held.append(w.encode())
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Encoder:
    """Encodes blocks of texts; keeps up to ``keep`` distinct words between blocks."""

    def __init__(self, vocabulary: BytePairs, keep: int = 200_000):
        self.v, self.keep = vocabulary, keep
        self._clear()

    def _clear(self) -> None:
        self.words = Numbers()
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts = self.lengths = np.zeros(0, dtype=np.int64)
        for token in self.v.specials:
            self.words[token]  # numbers the special tokens first
        if self.v.specials:
            self._add(np.array(list(self.v.specials.values()), dtype=np.uint32), np.ones(len(self.v.specials), dtype=np.int64))

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > self.keep:
            self._clear()
        number, cut, split, specials = self.words.__getitem__, self.v.pretokens, self.v.split, self.v.specials
        known, spans = len(self.words), []
        for text in texts:
            if not text:
                spans.append(np.zeros(0, dtype=np.int64))
            elif split is not None and split.search(text):
                found, at = [], 0
                for m in split.finditer(text):
                    found += map(number, cut(text[at : m.start()]))
                    found.append(number(m[0]))
                    at = m.end()
                found += map(number, cut(text[at:]))
                spans.append(np.array(found, dtype=np.int64))
            else:
                spans.append(np.array(list(map(number, cut(text))), dtype=np.int64))
        if len(self.words) > known:
            for piece in pieces_of(islice(self.words, known, None), WORD_BYTES):
                self._add(*self.v.encode_words(piece))
        return [ragged(self.flat, self.starts[s], self.lengths[s]) for s in spans]


def text_blocks(batches, columns: int, text_at: int, most: int = 8_000_000):
    """Column lists of the batches, joined until their texts have ``most`` characters."""
    held, size = [[] for _ in range(columns)], 0
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = [b.column(i).slice(at, 512).to_pylist() for i in range(columns)]
            size += sum(len(t) for t in part[text_at] if t)
            for h, p in zip(held, part):
                h += p
            if size >= most:
                yield held
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held


def arrow_blocks(batches, text_at: int, most: int = 6 << 20):
    """The batches, joined until their texts have ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(text_at))).as_py() or 0
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _definition(docs: DataFrame, path: str):
    """The vocabulary file, read once on the driver and sent to the executors; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    definition = _definition(docs, path)

    def run(batches):
        encoder = Encoder(BytePairs(definition.value))
        for keys, texts in text_blocks(batches, 2, 1, TEXT_CHARACTERS):
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array([i.astype(np.int32) for i in encoder.encode(texts)], type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    definition = _definition(tokens, path)

    def run(batches):
        v = BytePairs(definition.value)
        for b in batches:
            texts = [None if i is None else v.decode(np.array(i, dtype=np.int64)) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32 bits), decoded_sha256."""
    definition = _definition(docs, path)
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        v = BytePairs(definition.value)
        encoder = Encoder(v)
        for keys, texts in text_blocks(batches, 2, 1, TEXT_CHARACTERS):
            pa.default_memory_pool().release_unused()  # Arrow keeps what earlier batches, and earlier tasks of this worker, took
            ids = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.int64()), pa.array([len(i) for i in ids], type=pa.int64()), pa.array([sha(i.astype("<u4").tobytes()) for i in ids], type=pa.string()), pa.array([sha(v.decode(i.astype(np.int64)).encode()) for i in ids], type=pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
