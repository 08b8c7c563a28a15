"""Removal of repeated byte strings, by bucket-pointer refinement of suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts in a document
with a smaller doc_id goes.  Texts are taken whole, as UTF-8; matches do not
cross documents; strings are judged on the input.

Which suffixes can be equal at all is found first.  Each window of ``LENGTH``
bytes has an anchor: the ``GRAM``-byte gram with the least hash in it, the
leftmost of equals.  Equal windows have equal anchors, and neighbouring windows
mostly share one, so a text is cut into runs of windows with one anchor each.

1. Texts are packed into blocks of a few MB, a table of one row per block.
2. Every block sends its distinct anchors to shards, with a count of the
   documents and of the different segments (a run's bytes) of each; a shard
   tells each block which of them occur in another document too.
3. For those, a block sends its distinct segments with the smallest doc_id that
   has them.  A shard sorts their suffixes: buckets of the first eight bytes are
   refined by the bucket of the suffix 8, 16 and then 18 bytes on.  Buckets
   are taken in order, a few at a time, and pointers move at once, so that later
   buckets use what earlier ones have found.  Equal windows are neighbours then;
   their smallest doc_id decides.
4. A block gets back the windows to remove, settles repeats among its own
   documents, and cuts its texts.

No group grows with a passage's number of copies.  Where a passage that many
documents share ends, the anchor is shared and the segments differ in each
document; an anchor with over ``HOT`` different segments is not one group:
its windows go one by one, each to the shard of its own hash.  Inside the
passage a block sends one segment, however often it has it.

Messages go from blocks to shards, both in proportion to the texts; an empty one
is not sent, so their number is at most that of blocks times shards and at most
that of the blocks' anchors.

Defined cases: null and empty texts have no bytes and keep none; a null doc_id
is later than all others (for which the two least numbers there are count as one); rows that repeat a doc_id do not count as each other's
predecessors; texts below ``LENGTH`` bytes stay; an empty table gives an empty
result; other columns, whatever their names, are kept by :func:`drop_repeats`
and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import fresh_path, saved
from .bpe import ragged

LENGTH, GRAM, LAST, LEAST = 50, 16, (1 << 63) - 1, -(1 << 63)
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 8 << 20
#: Different segments of one anchor, over all blocks, beyond which its windows are dealt one by one.
HOT = 4096
_STEP = 1 << 19
#: Windows whose strings are held at once.
_WINDOWS = 1 << 20
#: Parts of a shard, by bits of the anchor, that are judged one after the other.
PARTS = 64
#: Segments of a block that are compared, and windows that are spread out, at once.
_SEGMENTS = 1 << 15


def _squeeze(data: bytes, level: int = 7) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _arrays(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other; bytes of a place in the numbers lie together, which compresses sorted numbers well."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) + a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return _squeeze(b"".join(parts), 1)


def _from_arrays(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sQ", data, at)
        kind = np.dtype(kind.decode())
        at += 10
        planes = np.frombuffer(data, dtype=np.uint8, count=n * kind.itemsize, offset=at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def pack(docs: DataFrame, path: str, block_bytes: int) -> DataFrame:
    """(block, size, ids, texts, rest): a row per block of documents; ``ids`` has doc_ids, lengths, which texts and which doc_ids are null, ``rest`` the other columns as Arrow."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches):
        seq, ids, texts, rest, size = TaskContext.get().partitionId() << 40, [], [], [], 0

        def block():
            sink = pa.BufferOutputStream()
            if others and rest:
                with pa.ipc.new_stream(sink, rest[0].schema) as w:
                    for b in rest:
                        w.write_batch(b)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([seq], type=pa.int64()), pa.array([size], type=pa.int64()),
                    pa.array([_arrays(np.array([i or 0 for i in ids], dtype=np.int64), np.array([len(t or b"") for t in texts], dtype=np.int64), *[np.array([x is None for x in c], dtype=np.uint8) for c in (texts, ids)])], type=pa.binary()),
                    pa.array([_squeeze(b"".join(t or b"" for t in texts))], type=pa.binary()), pa.array([_squeeze(sink.getvalue().to_pybytes())], type=pa.binary()),
                ],
                names=["block", "size", "ids", "texts", "rest"])

        for b in batches:
            begin = 0
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                ids.append(k), texts.append(None if t is None else t.encode())
                size += len(t and texts[-1] or b"")
                if size >= block_bytes or i + 1 == b.num_rows:
                    rest.append(b.slice(begin, i + 1 - begin).select(others))
                    begin = i + 1
                    if size >= block_bytes:
                        yield block()
                        seq, ids, texts, rest, size = seq + 1, [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[docs[c] for c in others])
    return saved(rows.mapInArrow(run, "block long, size long, ids binary, texts binary, rest binary"), "text-blocks", path)


def _block(ids: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers in the order of doc_id, nulls last; ends of the documents; bytes)."""
    doc_ids, lengths, _, no_id = _from_arrays(ids)
    return np.where(no_id, LAST, np.maximum(doc_ids, LEAST + 1) - 1), np.cumsum(lengths), np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), dtype=np.uint8)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the ``GRAM`` bytes from each position (a power of two), by doubling."""
    spread = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    h, factor, n = (spread * np.uint64(0xD6E8FEB86659FD93))[data], np.uint64(0xBF58476D1CE4E5B9), 1
    while n < GRAM:
        h = h[:-n] * factor + h[n:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _anchor_number(h: np.ndarray) -> np.ndarray:
    """48 evenly spread bits: anchors are least hashes, so the hashes themselves crowd at the low end.

    Two anchors with one number only cost a comparison.
    """
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(16)


def runs(data: np.ndarray, ends: np.ndarray):
    """(first windows, numbers of windows, anchors, documents, signs) of all runs of windows with one anchor; equal segments have equal signs."""
    found = []
    for low in range(0, max(len(data) - LENGTH + 1, 0), _STEP):
        piece = data[low : low + _STEP + LENGTH - 1]
        h = gram_hashes(piece)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        wide, n = LENGTH - GRAM + 1, 1
        while 2 * n <= wide:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < wide:
            least = np.minimum(least[: len(least) - (wide - n)], least[wide - n :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(low, low + len(anchor))
        doc = np.searchsorted(ends, start, side="right")
        ok = np.flatnonzero(start + LENGTH <= ends[doc])
        if not len(ok):
            continue
        anchor, doc = anchor[ok], doc[ok]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1] + 1)]))
        count = np.diff(np.append(first, len(ok)))
        sign = h[ok[first]] ^ (h[ok[first] + count + LENGTH - 1 - GRAM] * np.uint64(0x9E3779B97F4A7C15)) ^ count.astype(np.uint64)
        found.append((ok[first] + low, count, _anchor_number(h[anchor[first]]), doc[first], sign))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted keys pass from one shard to the next: shards are ranges of anchors."""
    low = (np.arange(shards + 1, dtype=object) << 48) // shards
    return np.searchsorted(keys, np.array(low[:-1], dtype=np.uint64)).tolist() + [len(keys)]


def _changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(sorted_columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _anchor_keys(doc_ids, ends, data):
    """The block's distinct anchors in order; of each, the number of documents (2: two or more) and of different segments (up to 65,535)."""
    _, _, keys, docs, signs = runs(data, ends)
    order = np.argsort(keys, kind="stable")
    keys, who, signs = keys[order], doc_ids[docs[order]], signs[order]
    first = np.flatnonzero(_changes(keys))
    if not len(first):
        return keys, np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint16)
    twice = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
    size = np.diff(np.append(first, len(keys)))
    several = np.ones(len(first), dtype=np.int64)
    at = np.flatnonzero(np.repeat(size > 1, size))
    owner = np.repeat(np.arange(len(first)), size)[at]
    order = np.lexsort((signs[at], owner))
    new = _changes(owner[order], signs[at][order])
    several[size > 1] = np.bincount(owner[order][new], minlength=len(first))[size > 1]
    return keys[first], 1 + twice.astype(np.uint8), np.minimum(several, 65_535).astype(np.uint16)


def shared_anchors(blocks: DataFrame, shards: int, most: int = HOT) -> DataFrame:
    """(block, shard, data): per block and shard, bits for each of the block's distinct anchors: shared, then hot."""

    def send(batches):
        for b in batches:
            for block, ids, texts in zip(*(b.column(i).to_pylist() for i in range(3))):
                keys, docs, several = _anchor_keys(*_block(ids, texts))
                edges = _shard_edges(keys, shards)
                some = [s for s in range(shards) if edges[s] < edges[s + 1]]
                data = [_arrays(np.diff(keys[c], prepend=np.uint64(0)), docs[c], several[c]) for c in (slice(edges[s], edges[s + 1]) for s in some)]
                yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array([block] * len(some), type=pa.int64()), pa.array(data, type=pa.binary())], names=["shard", "block", "data"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_from_arrays(d) for d in rows["data"]]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        _, at = np.unique(keys, return_inverse=True)
        shared = (np.bincount(at, weights=np.concatenate([p[1] for p in parts])) > 1)[at]
        several, blocks = np.bincount(at, weights=np.concatenate([p[2] for p in parts])), np.bincount(at)
        hot = ((several > most) & (several > 2 * blocks))[at]
        cuts = np.cumsum([0] + [len(p[0]) for p in parts])
        return pd.DataFrame({"block": rows["block"], "shard": rows["shard"], "data": [_arrays(np.packbits(shared[a:b]), np.packbits(hot[a:b])) for a, b in zip(cuts, cuts[1:])]})

    return blocks.select("block", "ids", "texts").mapInArrow(send, "shard int, block long, data binary").groupBy("shard").applyInPandas(meet, "block long, shard int, data binary")


def _with_texts(blocks: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of ``more`` beside their blocks; a block's own row has shard -1."""
    own = blocks.select("block", F.lit(-1).alias("shard"), F.col("texts").alias("data"), F.col("ids").alias("extra"))
    return own.unionByName(more, allowMissingColumns=True)


def _window_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 48-bit hash of the ``LENGTH`` bytes from each start."""
    factors = np.random.default_rng(7).integers(1, 1 << 63, LENGTH, dtype=np.uint64) | np.uint64(1)
    view, out = np.lib.stride_tricks.sliding_window_view(data, LENGTH), np.zeros(len(starts), dtype=np.uint64)
    for low in range(0, len(starts), 1 << 16):
        out[low : low + (1 << 16)] = (view[starts[low : low + (1 << 16)]] * factors).sum(axis=1, dtype=np.uint64)
    return _anchor_number(out)


def _distinct(text: bytes, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each segment, the segment that stands for each class: of its smallest document, the first)."""
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(text[s : s + n + LENGTH - 1], len(number)) for s, n in zip(starts.tolist(), counts.tolist())), dtype=np.int64, count=len(starts))
    order = np.lexsort((starts, docs, at))
    return at, order[_changes(at[order])]


def _by_key(keys: np.ndarray):
    """Slices of sorted keys, of about ``_SEGMENTS`` each, that part no key."""
    first, low = np.flatnonzero(_changes(keys)), 0
    while low < len(keys):
        next_key = np.searchsorted(first, low + _SEGMENTS)
        high = int(first[next_key]) if next_key < len(first) else len(keys)
        yield slice(low, high)
        low = high


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each start and the places after it, as many as its count."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def segments(blocks: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """(block, shard, data): distinct segments with the smallest doc_id that has them and their first place there."""

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["shard"] == -1
        doc_ids, ends, data = _block(rows.loc[own, "extra"].iloc[0], rows.loc[own, "data"].iloc[0])
        starts, counts, keys, docs, _ = runs(data, ends)
        who, order = doc_ids[docs], np.argsort(keys, kind="stable")
        first = np.flatnonzero(_changes(keys[order]))
        edges = _shard_edges(keys[order][first], shards)
        bits = np.zeros((2, len(first)), dtype=bool)
        for shard, d in zip(rows.loc[~own, "shard"], rows.loc[~own, "data"]):
            a, b = edges[shard], edges[shard + 1]
            bits[:, a:b] = [np.unpackbits(x, count=b - a) for x in _from_arrays(d)]
        size = np.diff(np.append(first, len(order)))
        taken = order[np.repeat(bits[0] & ~bits[1], size)]
        text = data.tobytes()
        take = [some[_distinct(text, starts[some], counts[some], who[some])[1]] for some in (taken[c] for c in _by_key(keys[taken]))]
        take = np.concatenate(take) if take else taken
        starts_of, counts_of, keys_of, least = [starts[take]], [counts[take]], [keys[take]], [who[take]]
        hot = order[np.repeat(bits[0] & bits[1], size)]
        hot_keys = keys[order[first[bits[0] & bits[1]]]]
        for w, n in _window_parts(data, starts[hot], counts[hot], who[hot]):
            _, of = _distinct(text, w, np.ones(len(w), dtype=np.int64), n)
            starts_of.append(w[of]), counts_of.append(np.ones(len(of), dtype=np.int64)), keys_of.append(_window_keys(data, w[of])), least.append(n[of])
        begin, counts, keys, least = (np.concatenate(x) for x in (starts_of, counts_of, keys_of, least))
        order = np.argsort(keys, kind="stable")
        begin, counts, keys, least = begin[order], counts[order], keys[order], least[order]
        part = (keys >> np.uint64(8) & np.uint64(PARTS - 1)).astype(np.uint8)
        edges, lengths, out = _shard_edges(keys, shards), counts + LENGTH - 1, []
        for shard in range(shards):
            c = slice(edges[shard], edges[shard + 1])
            if c.start < c.stop:
                # the block's hot anchors travel with its first message and come back with the verdicts
                message = (lengths[c].astype(np.int32), least[c], ragged(data, begin[c], lengths[c]), part[c], begin[c].astype(np.int32), hot_keys if not out else hot_keys[:0])
                out.append((rows["block"].iloc[0], shard, _arrays(*message)))
        return pd.DataFrame(out, columns=["block", "shard", "data"])

    return _with_texts(blocks, shared).groupBy("block").applyInPandas(send, "block long, shard int, data binary")


def _window_parts(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, who: np.ndarray):
    """The windows of segments one by one, (starts, doc_ids), in parts of about ``_WINDOWS``; equal windows are in one part."""
    if not len(starts):
        return
    windows, who = _places(starts, counts), np.repeat(who, counts)
    parts = -(-len(windows) // _WINDOWS)
    part = _window_keys(data, windows) % np.uint64(parts) if parts > 1 else np.zeros(len(windows), dtype=np.uint64)
    for p in range(parts):
        mine = np.flatnonzero(part == p)
        yield windows[mine], who[mine]


def refine(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, at_once: int = 1 << 18) -> np.ndarray:
    """Numbers of the suffixes of segments (``ends``: each position's segment end) that are equal in their first ``length`` bytes; -1 where fewer are left.

    A suffix's pointer is the last place of its bucket in the sorted order, so
    a refined bucket has pointers of its own and no other bucket's change.
    A suffix with fewer bytes than a pass compares leaves the order: none that stays asks for its pointer again.
    """
    n, q = len(data), min(8, length)
    room, result = ends - np.arange(n), np.full(n, -1, dtype=np.int64)
    order = np.flatnonzero(room >= q)
    if not len(order):
        return result
    # the first byte of a number is the highest
    code = np.ndarray(n, dtype=">u8", buffer=np.append(data, np.zeros(7, dtype=np.uint8)), strides=(1,))[order].astype(np.uint64) >> np.uint64(8 * (8 - q))
    rank = np.argsort(code)
    order, code = order[rank], code[rank]
    begin = np.flatnonzero(_changes(code))
    size = np.diff(np.append(begin, len(order)))
    pointer = np.full(n, -1, dtype=np.int64)
    pointer[order] = np.repeat(begin + size - 1, size)
    del rank, code
    depth = q
    while depth < length:
        shift, many = min(depth, length - depth), size > 1
        begin, size, depth = begin[many], size[many], depth + shift
        next_begin, next_size = [], []
        total = np.cumsum(size)
        cuts = np.unique(np.searchsorted(total, np.arange(at_once, total[-1] if len(total) else 0, at_once)))
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(begin)]):
            b, k = begin[low:high], size[low:high]
            place = _places(b, k)
            suffix, bucket = order[place], np.repeat(np.arange(len(b)), k)
            stays = room[suffix] >= depth
            order[place] = -1
            suffix, bucket = suffix[stays], bucket[stays]
            if not len(suffix):
                continue
            place = _places(b, np.bincount(bucket, minlength=len(b)))
            # pointers of buckets before these may have moved in this pass already
            ahead = pointer[suffix + shift]
            rank = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64))
            order[place], ahead = suffix[rank], ahead[rank]
            new = np.flatnonzero(_changes(bucket, ahead))  # buckets are in order already
            many_now = np.diff(np.append(new, len(place)))
            pointer[order[place]] = np.repeat(place[new] + many_now - 1, many_now)
            next_begin.append(place[new]), next_size.append(many_now)
        begin, size = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (next_begin, next_size))
    # Pointers that moved in time have parted some suffixes further on than ``length``; neighbours tell.
    whole = order[order >= 0]
    whole = whole[room[whole] >= length]
    if len(whole):
        view, new = np.lib.stride_tricks.sliding_window_view(data, length), np.ones(len(whole), dtype=bool)
        apart = np.flatnonzero(pointer[whole[1:]] != pointer[whole[:-1]])
        new[1:] = False
        for low in range(0, len(apart), 1 << 17):
            a = apart[low : low + (1 << 17)]
            new[a + 1] = (view[whole[a]] != view[whole[a + 1]]).any(axis=1)
        result[whole] = np.cumsum(new) - 1
    return result


def judge(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block of a shard, the runs of its windows that an earlier document has too: (block, data).  Hot anchors go back as they came.

    Equal segments are in one part.  The messages are one table of segments, so a part
    costs its segments, however many blocks they come from; segments, suffixes and verdicts of one part at a time are held beside it.
    """
    columns, out = [[] for _ in range(5)], []
    for block, d in zip(rows["block"], rows["data"]):
        *message, hot_keys = _from_arrays(d)
        message[2] = message[2].tobytes()
        for c, a in zip(columns, message):
            c.append(a)
        if len(hot_keys):
            out.append((block, _arrays(hot_keys)))
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(a) for a in columns[0]])
    lengths, docs, text, part, start = (b"".join(c) if i == 2 else np.concatenate(c) for i, c in enumerate(columns))
    del columns, message, d
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    order = np.argsort(part, kind="stable")
    cuts, found = np.searchsorted(part, np.arange(PARTS + 1), sorter=order), []
    for p in range(PARTS):
        o = order[cuts[p] : cuts[p + 1]]
        if len(o):
            found += _judge_part(text, lengths[o], at[o], docs[o], start[o], of[o])
    if found:
        first, size = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(first)
        first, size = first[order], size[order]
        new = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1] + size[:-1]]))
        first, size = first[new], np.add.reduceat(size, new).astype(np.int32)
        ends, blocks = np.searchsorted(first >> 32, np.arange(len(rows) + 1)), rows["block"].tolist()
        for block, a, b in zip(blocks, ends, ends[1:]):
            if a < b:
                out.append((block, _arrays(np.diff(first[a:b] & 0xFFFFFFFF, prepend=0), size[a:b])))
    return pd.DataFrame(out, columns=["block", "data"])


def _judge_part(text: bytes, lengths: np.ndarray, at: np.ndarray, docs: np.ndarray, start: np.ndarray, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The runs (message above 32 bits of the first window, number of windows) that an earlier document has too, of a part's segments (lengths, places in ``text``, documents, first windows, messages)."""
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(text[a : a + n], len(number)) for a, n in zip(at.tolist(), lengths.tolist())), dtype=np.int64, count=len(at))
    least = np.full(len(number), LAST)
    np.minimum.at(least, own, docs)
    lengths = np.fromiter(map(len, number), dtype=np.int64, count=len(number))
    data = np.frombuffer(b"".join(number), dtype=np.uint8)
    del number
    bucket = refine(data, np.repeat(np.cumsum(lengths), lengths))
    counts = lengths - LENGTH + 1
    begins = np.cumsum(counts) - counts
    bucket = bucket[bucket >= 0]  # a segment's windows, in order of segment and place
    first_doc = np.full(int(bucket.max()) + 1, LAST)
    np.minimum.at(first_doc, bucket, np.repeat(least, counts))
    earliest = first_doc[bucket]
    found = []
    for low in range(0, len(own), _SEGMENTS):
        c = slice(low, low + _SEGMENTS)
        n = counts[own[c]]
        hit = np.flatnonzero(earliest[_places(begins[own[c]], n)] < np.repeat(docs[c], n))
        if len(hit):
            window = np.sort(_places(start[c] | of[c].astype(np.int64) << 32, n)[hit])
            new = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1] + 1]))
            found.append((window[new], np.diff(np.append(new, len(window)))))
    return found


def _own_repeats(doc_ids, ends, data, repeated: np.ndarray, hot_keys: np.ndarray) -> None:
    """Adds to ``repeated``, which has the windows that earlier documents have by the shards' verdicts, those of equal segments of the block.

    ``repeated`` is set at the place that stands for equal segments or windows;
    places in the same document follow it, places in later documents go.  Of hot
    anchors the windows were sent, not the segments, so equal windows count.
    """
    starts, counts, keys, docs, _ = runs(data, ends)
    order = np.argsort(keys, kind="stable")
    size = np.diff(np.append(np.flatnonzero(_changes(keys[order])), len(keys)))
    order = order[np.repeat(size > 1, size)]
    who, text, hot = doc_ids[docs], data.tobytes(), np.isin(keys[order], hot_keys)
    same_keys = order[~hot]
    for c in _by_key(keys[same_keys]):
        same = same_keys[c]
        at, of = _distinct(text, starts[same], counts[same], who[same])
        stands = same[of][at]
        several = stands != same
        same, stands = same[several], stands[several]
        n = counts[same]
        repeated[_places(starts[same], n)] |= np.repeat(who[same] > who[stands], n) | repeated[_places(starts[stands], n)]
    for w, whose in _window_parts(data, starts[order[hot]], counts[order[hot]], who[order[hot]]):
        at, of = _distinct(text, w, np.ones(len(w), dtype=np.int64), whose)
        least = whose[of][at]
        known = np.zeros(len(of), dtype=bool)
        known[at[repeated[w] & (whose == least)]] = True
        repeated[w] |= known[at] | (whose > least)


def _removed(rows: pd.DataFrame):
    """(doc_ids, which texts are null, ends, bytes, flags of the removed bytes) of a block."""
    own = rows["extra"].notna()
    ids = rows.loc[own, "extra"].iloc[0]
    doc_ids, ends, data = _block(ids, rows.loc[own, "data"].iloc[0])
    repeated = np.zeros(len(data) + 1, dtype=bool)
    hot_keys = np.zeros(0, dtype=np.uint64)
    for d in rows.loc[~own, "data"]:
        begin, *size = _from_arrays(d)
        if not size:
            hot_keys = begin
            continue
        size = size[0]
        repeated[_places(np.cumsum(begin), size.astype(np.int64))] = True
    _own_repeats(doc_ids, ends, data, repeated, hot_keys)
    edge = np.diff(repeated.view(np.int8), prepend=np.int8(0))
    change = np.zeros(len(data) + LENGTH + 1, dtype=np.int32)
    change[np.flatnonzero(edge > 0)] += 1
    np.subtract.at(change, np.flatnonzero(edge < 0) + LENGTH - 1, 1)
    named, _, no_text, no_id = _from_arrays(ids)
    return pa.array(named, mask=no_id.astype(bool)), no_text.astype(bool), ends, data, np.cumsum(change[: len(data)], out=change[: len(data)]) > 0


def _judged(docs: DataFrame, rest: bool, path: str, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Rows to group by block: its texts, and the windows to remove.  ``path``: for the table of blocks."""
    blocks = pack(docs, path, block_bytes)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    verdicts = segments(blocks, shared_anchors(blocks, shards, hot), shards).groupBy("shard").applyInPandas(judge, "block long, data binary")
    own = blocks.select("block", F.col("texts").alias("data"), F.col("ids").alias("extra"), *(["rest"] if rest else []))
    return own.unionByName(verdicts, allowMissingColumns=True)


def repeat_report(docs: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        doc_ids, _, ends, data, gone = _removed(rows)
        out, begin = [], 0
        for k, end in zip(doc_ids.to_pylist(), ends.tolist()):
            g = gone[begin:end]
            out.append((k, end - begin, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(data[begin:end][~g].tobytes()).hexdigest()))
            begin = end
        found = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return found.assign(doc_id=pd.array(doc_ids.to_pylist(), dtype="Int64"))

    path = fresh_path(docs.sparkSession, "text-blocks")
    return _judged(docs.select("doc_id", "text"), rest=False, path=path, **sizes).groupBy("block").applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, **sizes) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes cut from their texts; a character that a cut leaves incomplete goes too.

    All columns stay, of whatever types, and as they were: they are kept and given back as Arrow.  A null text stays null.
    """
    schema, names = docs.schema, docs.columns
    others = [c for c in names if c not in ("doc_id", "text")]
    path = fresh_path(docs.sparkSession, "text-blocks")

    def cut(table: pa.Table) -> pa.Table:
        doc_ids, no_text, ends, data, gone = _removed(table.select(["block", "data", "extra"]).to_pandas())
        texts, begin = [], 0
        for end in ends.tolist():
            texts.append(data[begin:end][~gone[begin:end]].tobytes().decode("utf-8", "ignore"))
            begin = end
        columns = {"doc_id": doc_ids, "text": pa.array(texts, type=pa.string(), mask=no_text)}
        if others:
            rest = next(r for r in table.column("rest").to_pylist() if r is not None)
            stream = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)).read_all()
            columns |= {c: stream.column(c).combine_chunks() for c in others}
        return pa.table([columns[c] for c in names], names=names)

    return _judged(docs, rest=True, path=path, **sizes).groupBy("block").applyInArrow(cut, schema)
