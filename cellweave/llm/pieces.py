"""SentencePiece encoding and decoding of merge-type vocabularies with a score-ordered agenda.

Documents are independent, so this is a map over partitions without a shuffle.
A text is normalised (a space in front, spaces as U+2581) and cut into units:
before each U+2581 that follows another character, after each Latin letter that
another character follows, and around line feeds.  That is allowed because no
piece of the vocabulary crosses such a place (checked when the vocabulary is
read; else a text is one unit).  A unit's symbols are its characters; an agenda
holds its adjacent pairs that are pieces, and gives the best score first, of
equal scores the leftmost; a merge takes its neighbours' pairs off and puts the
new ones on.  The agenda is a list of the pairs' scores for short units and a
heap for long ones.  Characters that are no pieces fall back to their bytes.  Units once
encoded are kept for the rest of the partition, up to a stated number, and new
ones are compared, an Arrow batch at a time, with the sentencepiece library's
result, so that a vocabulary this module reads wrongly raises.

Defined cases: null and empty texts are the end id alone and decode to an empty
text; texts are encoded whole, whatever their length, one block of texts at a
time (a block is at least one text, with a few numbers for each unit of it);
strings of control pieces in a text are ordinary text; rows that repeat are
encoded each; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbers, ragged, text_blocks

SPACE = "▁"
#: Fixed values of the model file's format: kinds of pieces, and the number of the merge type.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
#: Letters after which a unit ends if another character follows.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A unit: spaces, other characters, letters, at least one of them.
UNIT = f"{SPACE}*[^{SPACE}{LETTER}\n]*[{LETTER}]+|{SPACE}+[^{SPACE}{LETTER}\n]*|[^{SPACE}{LETTER}\n]+|\n+"
#: Where no piece may reach across, if units are to be encoded on their own.
BETWEEN_UNITS = f"[^{SPACE}]{SPACE}|[{LETTER}][^{LETTER}]|\n[^\n]|[^\n]\n"


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message: integers, raw 4 or 8 bytes, or bytes."""
    found, at = [], 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            found.append((key >> 3, number()))
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            found.append((key >> 3, data[at : at + size]))
            at += size
    return found


#: Longest unit whose agenda is a list, and the cost of a pair that is no piece.
SHORT, NEVER = 48, float("inf")


def spelled(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:  # bytes that are no character, which no encoded text has: one sign for each
        return re.sub("[\udc80-\udcff]", "\ufffd", data.decode("utf-8", "surrogateescape"))


class Pieces:
    """A vocabulary: scores of pieces, ids, what each id stands for."""

    def __init__(self, model: bytes):
        parts = fields(model)
        trainer, normal = (dict(next((v for k, v in parts if k == n), []) and fields(next(v for k, v in parts if k == n))) for n in (2, 3))
        rows = [dict(fields(v)) for k, v in parts if k == 1]
        names = [r[1].decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        if trainer.get(3, 1) != MERGE_TYPE or trainer.get(24, 0):
            raise ValueError("not a merge-type vocabulary with spaces in front")
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or any(k in (USER_DEFINED, UNUSED) for k in kinds):
            raise ValueError("a normaliser or pieces that this module does not know")
        self.ids = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == NORMAL}
        self.cost = {n: -struct.unpack("<f", rows[i].get(2, bytes(4)))[0] for n, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.end = int(trainer.get(42, 2))
        self.bytes_of = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == BYTE} if trainer.get(35, 0) else {}
        self.cut = re.compile("(?s:.+)" if any(re.search(BETWEEN_UNITS, n) for n in self.ids) else UNIT)
        surface = trainer.get(44, " ⁇ ".encode())
        written = [b"" if k == CONTROL else surface if k == UNKNOWN else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds)]
        self.text = np.frombuffer(b"".join(written), dtype=np.uint8)
        self.text_length = np.array([len(s) for s in written], dtype=np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length
        self.kind = np.array(kinds)
        self.leads = np.array([n.startswith(SPACE) and k == NORMAL for n, k in zip(names, kinds)])
        decimals = [b" %d" % i for i in range(len(names))]
        self.decimal = np.frombuffer(b"".join(decimals), dtype=np.uint8)
        self.decimal_length = np.array([len(s) for s in decimals], dtype=np.int64)
        self.decimal_start = np.cumsum(self.decimal_length) - self.decimal_length

    def units(self, text: str | None) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_unit(self, unit: str) -> list[int]:
        """The ids of one unit."""
        found: list[int] = []
        for s in self.merged(unit) if len(unit) <= SHORT else self.merged_by_heap(unit):
            i = self.ids.get(s)
            if i is not None:
                found.append(i)
            elif self.bytes_of:
                found += [self.bytes_of[b] for b in s.encode()]
            else:
                found.append(self.unknown)
        return found

    def merged(self, unit: str) -> list[str]:
        """The symbols of a short unit: the agenda is the list of its pairs' costs, in the order of the text."""
        cost, symbols = self.cost.get, list(unit)
        agenda = [cost(unit[i : i + 2], NEVER) for i in range(len(unit) - 1)]
        while agenda and (best := min(agenda)) is not NEVER:
            at = agenda.index(best)
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at:
                agenda[at - 1] = cost(symbols[at - 1] + symbols[at], NEVER)
            if at < len(agenda):
                agenda[at] = cost(symbols[at] + symbols[at + 1], NEVER)
        return symbols

    def merged_by_heap(self, unit: str) -> list[str]:
        """The symbols of a unit of any length: the agenda is a heap, in which pairs that are no more are told by their length."""
        cost, symbols, n = self.cost, list(unit), len(unit)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost.get(unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            following[a] = c = following[b]
            if c < n:
                previous[c] = a
            for left, right in ((previous[a], a), (a, c)):
                if left >= 0 and right < n and (score := cost.get(pair := symbols[left] + symbols[right])) is not None:
                    heapq.heappush(agenda, (score, left, right, len(pair)))
        return [s for s in symbols if s]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library spells them."""
        shown = self.kind[ids] != CONTROL
        ends = np.flatnonzero(~shown)
        first = int(np.argmax(shown)) if shown.any() else 0
        skip = 1 if len(ids) and self.leads[ids[first]] else 0  # the space that was put in front
        if len(ends) and (ends[0] != len(ids) - len(ends)):  # control pieces within, which part the bytes of a character
            parts = np.split(ids, ends)
        else:
            parts = [ids]
        return "".join(spelled(ragged(self.text, self.text_start[p], self.text_length[p]).tobytes()) for p in parts)[skip:]

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers with a space between them."""
        return ragged(self.decimal, self.decimal_start[ids], self.decimal_length[ids])[1:].tobytes()


class Encoder:
    """Encodes blocks of texts; keeps up to ``keep`` distinct units between blocks and checks new ones with the library."""

    def __init__(self, model: bytes, keep: int = 400_000, check: bool = True):
        import sentencepiece

        self.v, self.keep = Pieces(model), keep
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model) if check else None
        self._clear()

    def _clear(self) -> None:
        self.seen = Numbers()
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = self.lengths = np.zeros(0, dtype=np.int64)

    def _check(self, units: list[str], ids: list[list[int]]) -> None:
        """Units that begin as a text does, with one space, are whole texts to the library too."""
        own = [(u[1:], i) for u, i in zip(units, ids) if u[0] == SPACE and u[1:2] not in ("", SPACE)]
        for (text, i), other in zip(own, self.library.encode([t for t, _ in own], num_threads=1)):
            if i != other:
                raise ValueError(f"the library encodes {text[:80]!r} as {other[:20]}, not as {i[:20]}")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        if len(self.seen) > self.keep:
            self._clear()
        known, number, cut = len(self.seen), self.seen.__getitem__, self.v.units
        spans = [np.array([*map(number, cut(t))], dtype=np.int64) for t in texts]
        new = list(self.seen)[known:]
        ids = [*map(self.v.encode_unit, new)]
        if self.library and new:
            self._check(new, ids)
        lengths = np.array([len(i) for i in ids], dtype=np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.array([i for part in ids for i in part], dtype=np.int32)])
        return [np.append(ragged(self.flat, self.starts[s], self.lengths[s]), np.int32(self.v.end)) for s in spans]


def _model(docs: DataFrame, path: str):
    """The model file, read once on the driver and sent to the executors; its size does not depend on the data."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, with the end id."""
    model = _model(docs, path)

    def run(batches):
        encoder = Encoder(model.value)
        for keys, texts in text_blocks(batches, 2, 1):
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(encoder.encode(texts), type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    model = _model(tokens, path)

    def run(batches):
        v = Pieces(model.value)
        for b in batches:
            texts = [None if i is None else v.decode(np.array(i, dtype=np.int64)) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def library_differences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, what) of the rows, none if all is well, whose whole text the library encodes or decodes otherwise."""
    model = _model(docs, path)

    def run(batches):
        encoder = Encoder(model.value, check=False)
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for keys, texts in text_blocks(batches, 2, 1):
            own = encoder.encode(texts)
            other = library.encode([t or "" for t in texts], add_eos=True, num_threads=1)
            back = library.decode(other, num_threads=1) if other else []
            bad = [(k, "ids" if a.tolist() != b else "text") for k, a, b, c in zip(keys, own, other, back) if a.tolist() != b or encoder.v.decode(a) != c]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in bad], type=pa.int64()), pa.array([w for _, w in bad], type=pa.string())], names=["doc_id", "what"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, what string")


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256 (decimal ids with a space between), decoded_sha256."""
    model = _model(docs, path)
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        encoder = Encoder(model.value)
        v = encoder.v
        for keys, texts in text_blocks(batches, 2, 1, most=4_000_000):
            ids = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.int64()), pa.array([len(i) for i in ids], type=pa.int64()), pa.array([sha(v.decimals(i)) for i in ids], type=pa.string()), pa.array([sha(v.decode(i).encode()) for i in ids], type=pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
