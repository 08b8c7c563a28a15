"""SentencePiece encoding and decoding against the library, on odd texts and random ids."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cellweave.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "▁", "▁▁ a", "<s>", "</s> <0x41> <unk>", " a" * 50, "a" * 1000, "ab" * 700, " " * 100, "a\0b", "tab\tnew\r\nline\n\nx", "é日本🙂 é ﬁ", "a1b22.c, d.\nE", "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return pieces.Encoder(f.read())


def test_random_texts(library, encoder):
    r = random.Random(5)
    letters = [chr(i) for i in range(0x250)] + list("   \n▁<>/s0123456789日本語🙂é") + [chr(r.randrange(0x250, 0xD7FF)) for _ in range(300)]
    texts = [t or "" for t in TEXTS] + [chr(i) for i in range(0x250)] + [f"a{chr(i)}b" for i in range(0x250)]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(90))) for _ in range(3000)]
    texts += ["".join(r.choice("  ▁abthe.\n1") for _ in range(r.randrange(120))) for _ in range(3000)]
    want = library.encode(texts, add_eos=True)
    got = [i.tolist() for i in encoder.encode(texts)]
    assert got == want
    assert [encoder.v.decode(np.array(i)) for i in got] == library.decode(want)


def test_random_ids(library, encoder):
    r = random.Random(6)
    ids = [[r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randrange(12))] for _ in range(5000)]
    ids += [[225, 1, 184], [1, 1], [2, 28705, 264], [0, 0], [259], [240, 159]]
    assert [encoder.v.decode(np.array(i, dtype=np.int64)) for i in ids] == library.decode(ids)


def test_short_and_long_agenda_agree(encoder):
    r = random.Random(7)
    for _ in range(500):
        unit = "▁" * r.randrange(4) + "".join(r.choice("theringaes") for _ in range(r.randrange(1, 60)))
        assert encoder.v.merged(unit) == encoder.v.merged_by_heap(unit)


def test_tables(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "again", "x", 1), (3, "again", "x", 1)], "doc_id long, text string, ids string, n_tokens int")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.piece_digests(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert pieces.library_differences(docs, PATH).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(docs, PATH), PATH)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((k, (t or "").replace("▁", " ")) for k, t in rows), key=str)  # the sign for a space is one
    assert pieces.piece_digests(docs.limit(0), PATH).count() == 0


def test_other_vocabularies_raise(encoder):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    piece = field(1, field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + b"\x18\x02")
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Pieces(piece + field(2, b"\x18\x01") + field(3, b""))  # a unigram vocabulary
    with pytest.raises(ValueError, match="normaliser"):
        pieces.Pieces(piece + field(2, b"\x18\x02") + field(3, b"\x20\x01"))  # one that removes white space
    encoder.library, kept = type("Other", (), {"encode": lambda self, texts, num_threads: [[0]] * len(texts)})(), encoder.library
    with pytest.raises(ValueError, match="the library encodes"):
        encoder.encode(["anotherunseenword"])
    encoder.library = kept
