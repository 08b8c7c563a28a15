"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record: the payload's length (u64), the masked checksum of those 8 bytes
(u32), the payload, its masked checksum (u32), all little-endian.  A checksum
is CRC-32; masked, so that checksums of data that hold checksums stay random:
rotated right by 15 bits, plus 0xA282EAD8.  A payload: doc_id (i64, 0 where null),
number of ids (u32), a flag byte (u8: bytes per id, 2 if all ids fit, else 4; plus 128 where
doc_id is null), the ids.

Documents are encoded where they are; their payloads go to ranges of doc_id,
whose bounds are quantiles, and are sorted by doc_id, then checksum; a doc_id of
many rows is spread over ranges by checksum.  There are as many ranges as shuffle
partitions, more where the input is above ``RANGE_BYTES`` for each.  A task writes its range to files of its own,
named by partition number, under an attempt name first and renamed when whole,
so a repeated task overwrites the same bytes.  It returns the index rows
(doc_id, file, offset, bytes, n_tokens), stored beside the files as Parquet.  Where a document begins in the stream of all ids is a prefix sum:
inside a file by its reader, over files by a window with a row per file.

Defined cases: null and empty texts hold the end id only; null doc_ids come
first, before the least number there is; rows that repeat a doc_id are a record each, next to each other, in order
of the payload's checksum, then of the compressed payload; an empty table writes no files;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import qualified
from ._spark import fresh_path
from .bpe import Numbers, arrow_blocks, byte_alphabet, ragged

NULL = 128
#: Bytes of the input, as Spark estimates it, for which there is a range at least.
RANGE_BYTES = 256 << 20
#: How the vocabulary cuts words: a fixed value of it, here for characters below U+0250 on which the standard library's classes agree with Unicode's.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The same rule as the vocabulary's file states it, with the steps around it; a file that states others is refused.
FILE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FILE_STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
NOT_SIMPLE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc\xbd\xbe\u0130]|[^\x00-\u024f]")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))])


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, offset of the next record); raises where a checksum or a length is wrong."""
    if at + 12 > len(data):
        raise ValueError(f"a record at {at} is cut short")
    length, check = struct.unpack_from("<QI", data, at)
    if masked_crc(data[at : at + 8]) != check:
        raise ValueError(f"the length at {at} does not match its checksum")
    if at + 16 + length > len(data):
        raise ValueError(f"a record at {at} is cut short")
    payload = data[at + 12 : at + 12 + length]
    if masked_crc(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"the payload at {at} does not match its checksum")
    return payload, at + 16 + length


def pack(doc_id: int | None, ids: bytes | np.ndarray) -> bytes:
    """A payload of ids, given as an array or as little-endian unsigned 32-bit integers."""
    numbers = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
    width = 2 if numbers.dtype.itemsize == 2 or not len(numbers) or numbers.max() < 1 << 16 else 4
    return struct.pack("<qIB", doc_id or 0, len(numbers), width | (NULL if doc_id is None else 0)) + numbers.astype(f"<u{width}", copy=False).tobytes()


def count_of(payload: bytes) -> int:
    return struct.unpack_from("<I", payload, 8)[0]


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, flags = struct.unpack_from("<qIB", payload)
    return None if flags & NULL else doc_id, np.frombuffer(payload, dtype=f"<u{flags & ~NULL}", count=n, offset=13).astype("<u4")


def special_pattern(definition: str) -> str:
    """A regular expression of the special tokens' strings; raises if the file cuts or changes texts by other rules than :class:`WordCache` knows."""
    data = json.loads(definition)
    steps = data["normalizer"] or {}, data["pre_tokenizer"] or {}
    kinds = [p["type"] for p in steps[0].get("normalizers", [])], [p["type"] for p in steps[1].get("pretokenizers", [])]
    split = (steps[1].get("pretokenizers") or [{}])[0]
    model = data["model"]
    if kinds != FILE_STEPS or split.get("pattern", {}).get("Regex") != FILE_RULE or not split.get("invert") or model["type"] != "BPE" or model.get("unk_token") or model.get("dropout"):
        raise ValueError("the tokenizer's file cuts texts by rules that are not those of WordCache")
    return "(?i)" + "|".join(re.escape(t["content"]) for t in data.get("added_tokens", []))  # in either case, so that normalised ones are met too


class WordCache:
    """The tokenizers library behind a cache of words.

    The vocabulary lower-cases and drops white space, so a text is its words,
    and a word is its pieces.  Words are numbered as they come; the new ones of
    a block are cut into pieces as the library cuts them, and the library's
    model encodes the pieces not seen before.  A text's ids are then gathered
    from one array.  Texts in which a special token or a separator that Python
    alone takes for white space may occur go to the library whole, as do words
    with characters on which Python and the library may differ.

    An instance keeps its words, up to ``keep`` of them, for all tasks that a
    Python worker runs.
    """

    def __init__(self, definition: str, keep: int = 350_000):
        self.keep, self.special = keep, special_pattern(definition)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.type = "<u2" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4"
        # bytes, as Latin-1 characters, to the characters that stand for them in the vocabulary; line feeds part the pieces
        self.letters = str.maketrans({chr(b): c for c, b in byte_alphabet().items() if b != 10})
        self._clear()

    def _clear(self) -> None:
        self.words = Numbers()
        self.ids, self.starts, self.lengths = np.zeros(0, dtype=self.type), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pieces(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """(ids one after the other, number of ids of each) of lower-case pieces, by the library's model."""
        # bytes outside of 0x21 to 0x7E stand as the vocabulary's characters for them
        plain = [p.isascii() and p.isprintable() for p in pieces]
        others = iter("\n".join(p for p, own in zip(pieces, plain) if not own).encode().decode("latin-1").translate(self.letters).split("\n"))
        model, ids, counts = self.model.tokenize, [], []
        for p, own in zip(pieces, plain):
            tokens = model(p if own else next(others))
            counts.append(len(tokens))
            ids += [t.id for t in tokens]
        return ids, counts

    def _learn(self) -> None:
        """Ids of the words that have a number and no ids yet."""
        known, number, words = len(self.lengths), self.words.__getitem__, list(self.words)[len(self.lengths) :]
        odd = bool(NOT_SIMPLE.search(" ".join(words)))
        own, whole, several, parts, sizes = [], [], [], [], []
        for i, w in enumerate(words):
            if odd and NOT_SIMPLE.search(w):
                whole.append(i)
                continue
            cut = [w] if w.isalpha() and w.islower() else PIECE.findall(w.lower())
            if cut == [w]:
                own.append(i)
            else:
                several.append(i)
                sizes.append(len(cut))
                parts += map(number, cut)
        pieces = list(self.words)[known + len(words) :]  # that are no words of the block
        ids, counts = self._pieces([words[i] for i in own] + pieces)
        for i in whole:
            ids += (more := self._library(words[i]))
            counts.append(len(more))
        at = np.concatenate([own, np.arange(len(words), len(words) + len(pieces)), whole]).astype(np.int64)
        starts, lengths = np.zeros(len(at) + len(several), dtype=np.int64), np.zeros(len(at) + len(several), dtype=np.int64)
        lengths[at] = counts
        starts[at] = len(self.ids) + np.cumsum(lengths[at]) - lengths[at]
        self.ids = np.concatenate([self.ids, np.array(ids, dtype=self.type)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        if several:
            ids, upto = self._gather(np.array(parts, dtype=np.int64))
            cuts = upto[np.cumsum([0, *sizes])]
            place = known + np.array(several)
            self.starts[place], self.lengths[place] = len(self.ids) + cuts[:-1], np.diff(cuts)
            self.ids = np.concatenate([self.ids, ids])

    def _gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, one after the other, and the number of ids before each word and at the end."""
        lengths = self.lengths[words]
        return ragged(self.ids, self.starts[words], lengths), np.concatenate([[0], np.cumsum(lengths)])

    def ids_of(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, in two bytes where the vocabulary allows, else in four."""
        if len(self.words) > self.keep:
            self._clear()
        special = pc.fill_null(pc.match_substring_regex(texts, self.special), False)
        apart = {i: np.array(self._library(texts[i].as_py()), dtype=self.type) for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()}
        lists = pc.ascii_split_whitespace(pc.if_else(special, "", pc.fill_null(texts, "")))
        distinct = lists.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.words.__getitem__, distinct.dictionary.to_numpy(zero_copy_only=False)), dtype=np.int64, count=len(distinct.dictionary))
        if len(self.words) > len(self.lengths):
            self._learn()
        ids, upto = self._gather(numbers[distinct.indices.to_numpy()])
        cuts = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist() if len(lists) else []
        return [apart.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [i.astype("<u4").tobytes() for i in self.ids_of(pa.array(texts, pa.string()))]


def range_count(docs: DataFrame) -> int:
    """Shuffle partitions, more for an input that would give each of them above ``RANGE_BYTES``; by Spark's estimate, so nothing is read."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, -(-size // RANGE_BYTES)) if size < 1 << 60 else own  # beyond that Spark knows no size


class Ranges:
    """At most ``parts`` ranges of about equally many rows of the one column of ``ids``, nulls first; a value may be several ranges' end."""

    LEAST = -(1 << 63)

    def __init__(self, ids: DataFrame, parts: int):
        c = F.col(ids.columns[0]).cast("long")
        places = F.array(*[F.lit(i / parts) for i in range(1, max(parts, 2))])
        found = ids.agg(F.percentile_approx(F.coalesce(c, F.lit(self.LEAST)), places, max(10_000, 20 * parts)).alias("ends"), F.count_if(c.isNull()).alias("nulls"), F.count_if(c == self.LEAST).alias("least")).first()
        self.bounds = np.array(found["ends"] if parts > 1 and found["ends"] else [], dtype=np.int64)
        # ranges that hold nothing but nulls and rows of the least number: the nulls have the first of them, in proportion
        first = int(np.searchsorted(self.bounds, self.LEAST, side="right"))
        self.null_end = first * found["nulls"] // max(1, found["nulls"] + found["least"])

    def of(self, keys: pa.Array, checks: np.ndarray) -> np.ndarray:
        """The range of each key; keys that are an end are spread by checksum over all ranges that they touch, which keeps the order (key, checksum)."""
        null = keys.is_null().to_numpy(zero_copy_only=False)
        values = pc.fill_null(keys, self.LEAST).to_numpy()
        low, high = np.searchsorted(self.bounds, values, side="left"), np.searchsorted(self.bounds, values, side="right")
        low = np.where((values == self.LEAST) & ~null, self.null_end, low)
        high = np.where(null, self.null_end, high)
        return low + ((high - low + 1) * checks >> 32)


def encoded(docs: DataFrame, tokenizer_path: str, parts: int, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, doc_id, check, n_tokens, payload) of every row: its range, and its record's payload, compressed, with a checksum."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = Ranges(rows.select("doc_id"), parts)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    special_pattern(definition)  # a file that is not for this module raises here
    # of the vocabulary's size; a worker puts its cache beside it and keeps it as long as the text
    shared = docs.sparkSession.sparkContext.broadcast({"definition": definition})

    def run(batches):
        held = shared.value
        if "cache" not in held:
            held["cache"] = WordCache(held["definition"])
        cache, squeeze = held["cache"], zstandard.ZstdCompressor(level=1).compress
        for b in arrow_blocks(batches, 1):
            payloads = [pack(k, np.append(i, np.array(end_id, dtype=i.dtype))) for k, i in zip(b.column(0).to_pylist(), cache.ids_of(b.column(1)))]
            checks = np.array([zlib.crc32(p) for p in payloads], dtype=np.int64)
            part = ranges.of(b.column(0), checks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, type=pa.int32()), b.column(0), pa.array(checks), pa.array([count_of(p) for p in payloads], type=pa.int64()), pa.array([*map(squeeze, payloads)], type=pa.binary())],
                names=["part", "doc_id", "check", "n_tokens", "payload"])

    return rows.mapInArrow(run, "part int, doc_id long, check long, n_tokens long, payload binary")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, roll_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes record files to ``path`` and their index to ``path/index``; returns the index."""
    spark = docs.sparkSession
    path = qualified(spark, path)
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.create_dir(folder)

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(path)
        task = TaskContext.get()
        out, roll, at, whole = None, 0, 0, zstandard.ZstdDecompressor().decompress

        def close():
            out.close()
            fs.move(temporary, f"{folder}/{name}")

        for b in batches:
            rows = []
            for key, n, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{roll:04d}.records"
                    temporary = f"{folder}/_attempt-{task.taskAttemptId()}-{name}"
                    out, at = fs.open_output_stream(temporary), 0
                record = frame(whole(payload.as_py()))
                out.write(record)
                rows.append((key, name, at, len(record), n))
                at += len(record)
                if at >= roll_bytes:
                    close()
                    out, roll = None, roll + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "file", "offset", "bytes", "n_tokens"])
        if out is not None:
            close()

    parts = range_count(docs.select(id_col, text_col))
    # texts are encoded where they are, once; ids are shuffled
    ranged = encoded(docs, tokenizer_path, parts, end_id, id_col, text_col).repartitionById(parts, "part").sortWithinPartitions("doc_id", "check", "payload")
    index = ranged.select("doc_id", "n_tokens", "payload").mapInArrow(run, "doc_id long, file string, offset long, bytes long, n_tokens long")
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per record: doc_id, file, start (ids before it in all files), n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, at, before = [], 0, 0
                while at < len(data):
                    payload, at = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, name.rsplit("/", 1)[-1], before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "file", "before", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.records").load(path).select("path", "content")
    records = files.mapInArrow(run, "doc_id long, file string, before long, n_tokens long, ids_crc32 long")
    # the index gives each file's total without another pass over the ids; a row per file
    totals = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    begins = totals.withColumn("_begin", F.sum("_total").over(Window.orderBy("file")) - F.col("_total")).select(F.col("file").alias("_file"), "_begin")
    return records.join(begins, F.col("file") == F.col("_file")).select("doc_id", "file", (F.col("_begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_at(path: str, entries: list[tuple[str, int, int]]) -> list[tuple[int | None, np.ndarray]]:
    """Records by index entries (file, offset, bytes) in any order: a shuffled read without scanning."""
    fs, folder = pafs.FileSystem.from_uri(path)
    found = []
    for name, offset, size in entries:
        with fs.open_input_file(f"{folder}/{name}") as f:
            f.seek(offset)
            found.append(unpack(unframe(f.read(size))[0]))
    return found


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the record files to the shared folder and reads them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
