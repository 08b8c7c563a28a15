"""The training-data operators against brute force, on small tables with the odd cases."""

import hashlib
import sys
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import xxhash
from tokenizers import Tokenizer

from cellweave.llm import bpe, embedding_dedup, language, mixing, near_copies, simhash, suffix_dedup, token_records, topk, toxicity, warc
from cellweave.llm.components import connected_components, local_stars

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(30_000))
TEXTS = [None, "", " \n ", "one", "One two", "one two three four five", "one two three four five", "The cat's  café naïve ¼ ½ x² don't <|endoftext|> end", "日本語 テキスト 🙂 é́", "a" * 300, LONG, LONG + " tail", "!!! ??? ...", "tab\tnew\r\nline\x1cfs"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[4], rows[10]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(links, nodes):
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 800)] + [(5, 5)]
    want = {n: c for n, c in components(links, {n for e in links for n in e}).items()}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    assert got == {n: want[n] for n in got}
    assert {n for n, c in want.items() if n != c} <= set(got)
    u, v = local_stars(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert all(want[a] == b for a, b in zip(u.tolist(), v.tolist()))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    """Stars need no round, a chain of stars a few; each round's steps are tables of their own, so that no plan holds two of them."""
    from cellweave.llm import components as module

    steps, star = [], module._star
    monkeypatch.setattr(module, "_star", lambda edges, large: steps.append(len(edges._jdf.queryExecution().optimizedPlan().toString().split("\n"))) or star(edges, large))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([(5, 1), (1, 7), (8, 2), (9, 2), (7, 1)], "u long, v long")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 2: 2, 8: 2, 9: 2} and not steps
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([(5, 1), (5, 3), (9, 3)], "u long, v long")).collect()}
    assert got == {1: 1, 3: 1, 5: 1, 9: 1} and steps and len(steps) % 2 == 0 and max(steps) <= 2


class TestMixing:
    def test_budgets(self, docs):
        got = mixing.mix_report(docs).toPandas()
        assert len(got) == docs.count()
        words = [0 if t is None else len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t)) for t in [*TEXTS, TEXTS[4], TEXTS[10]]]
        assert sorted(got["size"]) == sorted(words)
        assert (got["taken"] <= 2 * got["size"]).all()
        assert abs(got.groupby("source", dropna=False)["target"].first().sum() - 1.5 * sum(words)) < 1
        for _, g in got.groupby("source", dropna=False):
            repeated = g["size"].max() if g["doc_id"].duplicated().any() else 0
            assert abs(g["taken"].sum() - np.floor(g["target"].iloc[0])) <= max(len(g), repeated)
            assert g["target"].iloc[0] <= 2 * g["size"].sum()

    def test_targets(self, spark):
        sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "_source string, _size long")
        got = {r["_source"]: r["target"] for r in mixing.source_targets(sized, (3, 1, 2), 1.5, 2).collect()}
        # a and the null source are capped at twice their size; b and c share the rest 1 to 2, and c is capped too
        assert got["a"] == 20 and got[None] == 10
        rest = 1.5 * 2015 - 30
        assert got["c"] == min(2000, rest * 2 / 3) and got["b"] == pytest.approx(rest - got["c"])

    def test_reruns_and_rows(self, docs):
        a, b = (sorted(map(str, mixing.mix_report(docs.repartition(n)).collect())) for n in (1, 7))
        assert a == b
        mixed = mixing.mix_documents(docs)
        assert mixed.columns == docs.columns and mixed.count() > 0

    def test_empty_and_clashing_columns(self, empty, docs):
        assert mixing.mix_report(empty).count() == 0
        more = docs.withColumnsRenamed({"lang": "_key", "n_chars": "_size"})
        assert mixing.mix_report(more).count() == docs.count()
        assert mixing.mix_documents(more).columns == more.columns


class TestSimhash:
    @staticmethod
    def brute(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    def test_fingerprints(self, docs):
        got = [(r["doc_id"], r["fp"] % (1 << 64)) for r in simhash.fingerprints(docs).collect()]
        assert sorted(got) == sorted((i, self.brute(t)) for i, t in [*enumerate(TEXTS), (4, TEXTS[4]), (10, TEXTS[10])])

    @pytest.mark.parametrize("tree_size", [7, 2048])
    def test_links_are_whole(self, spark, tree_size):
        r = np.random.default_rng(3)
        base = r.integers(0, 1 << 63, 20)
        prints = {int(b) for b in base}
        for b in base[:6]:
            for _ in range(60):  # a cloud of near copies: one shard is far over the tree's size
                flips = r.integers(0, 63, r.integers(1, 4))
                prints.add(int(b) ^ int(sum({1 << int(f) for f in flips})))
        prints = sorted(prints)
        want = components([(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(prints)))
        links = simhash.fingerprint_links(spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long"), tree_size=tree_size, at_once=40 if tree_size == 7 else 500_000).collect()
        assert components([(x["u"], x["v"]) for x in links], range(len(prints))) == want

    def test_groups(self, docs, empty):
        got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
        assert {(0, 0), (1, 0), (2, 0), (5, 5), (6, 5), (11, 10)} <= got
        assert simhash.simhash_components(empty).count() == 0
        kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect())
        assert 1 not in kept and 6 not in kept and 11 not in kept and kept.count(10) == 2


def similar_texts():
    """Documents with planted near copies from below 0.8 to 0.95, a chain, and a group whose key holds several components."""
    r, rows = np.random.default_rng(8), []
    for _ in range(60):
        words = [f"w{x}" for x in r.integers(0, 5000, r.integers(60, 400))]
        rows.append(words)
        for want in (0.7, 0.78, 0.8, 0.82, 0.85, 0.9, 0.95):
            copy, n = list(words), len(words) - 4
            for at in r.choice(len(words), max(1, round(n * (1 - want) / (1 + want) / 5)), replace=False):
                copy[at] = f"new{r.integers(0, 10**9)}"
            rows.append(copy)
    words = [f"c{i}" for i in range(200)]
    for i in range(60):  # each step is a near copy of the step before only
        words = [*words[6:], *(f"c{200 + 6 * i + k}" for k in range(6))]
        rows.append(words)
    order = r.permutation(len(rows))
    return [(int(i), " ".join(rows[k])) for i, k in enumerate(order)] + [(2000, None), (2001, ""), (2002, "two words"), (2003, "Two  words")]


class TestNearCopies:
    def test_planted_near_copies(self, spark):
        rows = similar_texts()
        sets = {i: {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in rows}
        like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i > j}
        assert sum(0.8 <= s <= 0.95 for s in like.values()) > 100
        want = components([p for p, s in like.items() if s >= 0.8], sets)
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        got = {r["doc_id"]: r["component_id"] for r in near_copies.similar_components(docs).collect()}
        assert got == want
        import corpus_pipeline

        stage = dict(corpus_pipeline.STAGES)["near-dedup"]
        assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == set(want.values())

    def test_the_stage_takes_the_fingerprints_pairs(self, spark, monkeypatch):
        """The keys find nothing here: only pairs of fingerprints are left, and the similarity decides on them."""
        import corpus_pipeline

        words = [f"w{i}" for i in range(900)]
        often = " ".join(["one two three four five six seven"] * 80)
        rows = [(3, often), (5, often + " " + " ".join(f"tail{i}" for i in range(12))), (8, " ".join(words)), (9, " ".join(words[:-1]))]
        bits = [(simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[i + 1][1])).bit_count() for i in (0, 2)]
        assert max(bits) <= 2
        monkeypatch.setattr(near_copies, "likely_pairs", lambda pairs, classes, similarity: pairs.where("false"))
        monkeypatch.setattr(near_copies, "cross_links", lambda *a: spark.createDataFrame([], "u long, v long"))
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [3, 5, 8]

    def test_the_table_against_an_exact_join(self, spark):
        """All documents of a table: every component, and so every link between different texts, of an exact join is found."""
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
        sets = {i: near_copies.shingle_set(t, 5) for i, t in rows}
        holders = defaultdict(list)
        for i, s in sets.items():
            for x in s.tolist() or [None]:
                holders[x].append(i)
        common = defaultdict(int)
        for ids in holders.values():
            for k, i in enumerate(ids):
                for j in ids[:k]:
                    common[i, j] += 1
        links = [(i, j) for (i, j), n in common.items() if not len(sets[i]) or n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
        assert len(links) > 50
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in near_copies.similar_components(docs).collect()} == components(links, sets)

    def test_texts_that_stay_are_not_shuffled(self, spark):
        """Also where the ids that go are too many to broadcast."""
        context, r = spark.sparkContext, np.random.default_rng(4)
        texts = [" ".join(f"{x:x}" for x in r.integers(0, 1 << 60, 1000)) for _ in range(200)]
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([*texts, *texts[:3]])] + [(None, texts[5], None, None, None)], DOCS)

        def shuffled() -> int:
            time.sleep(0.3)
            spark.range(1).count()
            context._jsc.sc().listenerBus().waitUntilEmpty()
            found = context._jsc.sc().statusStore().executorList(False)
            return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            kept, began = near_copies.drop_similar(docs), shuffled()
            assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == [*range(200)]
            assert 0 < shuffled() - began < sum(map(len, texts)) / 10
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns

    def test_bits_keep_what_is_asked_for(self, spark):
        table = spark.range(5000).withColumnRenamed("id", "k")
        for bits in (64, 1 << 20):
            kept = {r["k"] for r in near_copies.met(table, "k", spark.range(0, 5000, 50), bits).collect()}
            assert set(range(0, 5000, 50)) <= kept and (bits == 64 or len(kept) < 150)
        assert near_copies.met(table, "k", spark.range(0)).count() == 0

    @pytest.mark.parametrize("piece_size", [3, 1024])
    def test_cross_links_are_whole(self, spark, piece_size):
        r, rows = np.random.default_rng(9), []
        base = [f"w{x}" for x in range(150)]
        for i in range(70):  # from far below the bound to far above it, about one text
            words = list(base)
            for at in r.choice(150, r.integers(0, 7), replace=False):
                words[at] = f"n{r.integers(0, 30)}"
            rows.append((i, " ".join(words)))
        sets = {i: near_copies.shingle_set(t, 5) for i, t in rows}
        want = [(i, j) for i in sets for j in sets if i > j and near_copies.similarity_of(sets[i], sets[j]) >= 0.8]
        assert 100 < len(want) < 2300
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        prints = near_copies.sketches(docs, 5)
        classes = prints.groupBy("digest").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id").join(prints.drop("digest"), "doc_id").withColumnRenamed("doc_id", "rep")
        members = classes.select("rep", F.posexplode("keys").alias("band", "key"), F.col("rep").alias("c"))
        links = near_copies.cross_links(docs, members, classes, 5, 0.8, piece_size).collect()
        same = [(i, int(j)) for i, _ in rows for j in sets if j < i and near_copies.similarity_of(sets[i], sets[j]) == 1]
        assert components([(x["u"], x["v"]) for x in links] + same, sets) == components(want, sets)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


ODD = [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] + [1.0] * 7, 0), (903, [None] + [1.0] * 7, 0), (904, [float("inf")] + [1.0] * 7, 0), (905, [1.0, 0.0], 0), (906, [2.0, 0.0], None), (None, [1.0] * 8, 1)]


class TestEmbeddings:
    @pytest.mark.parametrize("block_rows", [16, 8192])
    def test_against_brute_force(self, spark, block_rows, monkeypatch):
        r = np.random.default_rng(5)
        x = r.standard_normal((60, 8))
        x = np.concatenate([x, x[:20] + r.normal(0, 0.1, (20, 8)), np.repeat(x[:1], 30, axis=0), x[:1] + r.normal(0, 0.02, (30, 8))]).astype(np.float32)
        rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD
        monkeypatch.setattr(embedding_dedup.class_links, "__defaults__", (0.95, block_rows))
        got = {r["vec_id"]: r for r in embedding_dedup.embedding_components(vectors(spark, rows)).collect()}
        u = x.astype(np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        links = [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and u[i] @ u[j] >= 0.95]
        comp = components(links, range(len(x)))
        for i in range(len(x)):
            assert got[i]["n_links"] == sum(a == i for a, _ in links) and got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i)
        assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (900, 901, 902, 903, 904))
        assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
        assert embedding_dedup.embedding_components(vectors(spark, [])).count() == 0

    def test_error_bound_holds(self):
        r = np.random.default_rng(6)
        x = embedding_dedup.unit(r.standard_normal((200, 48)))
        q, s, e = embedding_dedup.quantise(x)
        about = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None, :]
        assert (np.abs(about - x @ x.T) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()

    @pytest.mark.parametrize("shard_rows,block", [(50, 7), (16384, 4096)])
    def test_top_k(self, spark, shard_rows, block):
        r = np.random.default_rng(7)
        x = np.round(r.standard_normal((300, 8)), 1).astype(np.float32)
        x[250:] = x[0]  # ties
        whole = topk.whole_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD))
        assert {r["vec_id"] for r in whole.collect()} == {*range(300), 901, 905, 906, None}
        queries = whole.where("vec_id % 20 = 0")
        got = defaultdict(list)
        for row in topk.top_k(whole, queries, k=20, shard_rows=shard_rows, query_block=block).orderBy("query_id", "rank").collect():
            got[row["query_id"]].append((row["vec_id"], row["score"]))
        v = {i: np.floor(64 * x[i].astype(float)).astype(int) for i in range(300)} | {901: np.zeros(8, dtype=int)}
        for q in range(0, 300, 20):
            assert got[q] == sorted(((i, int(v[i] @ v[q])) for i in v if i != q), key=lambda t: (-t[1], t[0]))[:20]
        assert topk.top_k(whole.where("false"), queries.where("false")).count() == 0


BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


class TestTokens:
    def test_bpe_is_the_library(self, docs, empty):
        t = Tokenizer.from_file(BYTE)
        encoded = bpe.encode_documents(docs, BYTE)
        got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
        back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, BYTE).collect()}
        assert back == {i: x or "" for i, x in enumerate(TEXTS)}
        for r in bpe.token_digests(docs, BYTE).collect():
            ids = got[r["doc_id"]]
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
        assert bpe.encode_documents(empty, BYTE).count() == 0

    def test_bpe_on_random_texts(self):
        r = np.random.default_rng(8)
        texts = ["".join(chr(c) for c in r.choice([*range(32, 127), 10, 32, 32, *range(0xC0, 0x250), 0x3042, 0x1F642, 0x85, 0x2003, 0x1D], 200)) for _ in range(200)] + ["aaaaaaaa", "abababab", "\n\n\n  x"]
        e = bpe.Encoder(bpe.BytePairs(open(BYTE).read()), keep=500)
        t = Tokenizer.from_file(BYTE)
        for at in range(0, len(texts), 50):
            assert [i.tolist() for i in e.encode(texts[at : at + 50])] == [x.ids for x in t.encode_batch(texts[at : at + 50], add_special_tokens=False)]
        c, w = token_records.WordCache(open(WORD).read(), keep=300), Tokenizer.from_file(WORD)
        for at in range(0, len(texts), 50):
            assert [np.frombuffer(b, "<u4").tolist() for b in c.encode(texts[at : at + 50])] == [x.ids for x in w.encode_batch(texts[at : at + 50], add_special_tokens=False)]

    def test_every_character_of_the_simple_kind(self):
        """Alone and inside a word, controls and special strings too."""
        t = Tokenizer.from_file(WORD)
        texts = [w for c in range(0x250) for w in (chr(c), f"ab{chr(c)}cd", f"{chr(c)}1{chr(c)}.")]
        texts += ["a\0b\x1bc\x7f", "<|endoftext|>", "x<|startoftext|>y <|STARTOFTEXT|>", "<| a", "İ ͅ \u0338<|endoftext|>\u0338"]
        r = np.random.default_rng(12)
        texts += ["".join(chr(c) for c in r.choice([*range(0x250), 32, 32, 32], 30)) for _ in range(3000)]
        c = token_records.WordCache(open(WORD).read())
        assert [np.frombuffer(b, "<u4").tolist() for b in c.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        with pytest.raises(ValueError, match="rules"):
            token_records.special_pattern(open(BYTE).read())

    def test_ranges_keep_the_order(self, spark):
        """Nulls come before the least number, whatever many ranges either fills; ranges grow with the bytes."""
        import pyarrow as pa

        low = token_records.Ranges.LEAST
        ids = [None] * 500 + [low] * 300 + [low + 1] * 3 + [7] * 400 + list(range(100)) + [(1 << 63) - 1]
        ranges = token_records.Ranges(spark.createDataFrame([(i,) for i in ids], "doc_id long"), 13)
        checks = np.random.default_rng(3).integers(0, 1 << 32, len(ids))
        part = ranges.of(pa.array(ids, pa.int64()), checks).tolist()
        order = sorted(zip(part, [(i is not None, i or 0, c) for i, c in zip(ids, checks.tolist())]))
        assert [k for _, k in order] == sorted(k for _, k in order)
        assert max(np.bincount(part)) < 200 and len(set(part)) == 13
        payload = token_records.pack(low, np.array([1, 2], dtype="<u2"))
        assert token_records.unpack(payload)[0] == low and token_records.unpack(token_records.pack(None, np.array([], dtype="<u4")))[0] is None

    def test_more_ranges_for_more_bytes(self, spark, docs, monkeypatch):
        assert token_records.range_count(docs) == token_records.range_count(spark.range(10_000)) == 4
        monkeypatch.setattr(token_records, "RANGE_BYTES", 1000)
        assert token_records.range_count(spark.range(10_000)) == 80 and token_records.range_count(docs) >= 4

    def test_frames(self):
        data = token_records.frame(b"abc") + token_records.frame(b"")
        payload, at = token_records.unframe(data)
        assert payload == b"abc" and token_records.unframe(data, at) == (b"", len(data))
        for place in (0, 9, 13, 15):
            broken = bytearray(data)
            broken[place] ^= 1
            with pytest.raises(ValueError):
                token_records.unframe(bytes(broken))
        for ids in ([], [1, 2], [70_000, 1]):
            assert token_records.unpack(token_records.pack(None, np.array(ids, dtype="<u4").tobytes()))[1].tolist() == ids

    def test_files(self, spark, docs, empty, tmp_path):
        path = f"file://{tmp_path}/t"
        index = token_records.write_tokens(docs, path, WORD, end_id=2, roll_bytes=2000).collect()
        got = token_records.read_tokens(spark, path).collect()
        t, start = Tokenizer.from_file(WORD), 0
        want = []
        for i, x in sorted([*enumerate(TEXTS), (4, TEXTS[4]), (10, TEXTS[10])], key=lambda p: p[0]):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
        assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
        some = [(r["file"], r["offset"], r["bytes"]) for r in index][::-1]
        assert [k for k, _ in token_records.read_at(path, some)] == [r["doc_id"] for r in index][::-1]
        token_records.write_tokens(empty, f"file://{tmp_path}/e", WORD)
        assert token_records.token_files(empty, WORD).count() == 0


class TestRepeats:
    @staticmethod
    def brute(rows):
        first = {}
        for i, b in rows:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                first[s] = min(first.get(s, 1 << 62), i)
        out = []
        for i, b in rows:
            gone = [False] * len(b)
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = [True] * 50
            kept = bytes(x for x, g in zip(b, gone) if not g)
            out.append((i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
        return out

    def test_against_brute_force(self, spark, empty):
        r = np.random.default_rng(9)
        word = lambda: "".join(r.choice(list("abcdeé"), r.integers(2, 8)))
        shared = [" ".join(word() for _ in range(n)) for n in (9, 20, 60)]
        texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "x" * 200, "ab" * 100]
        for k in range(60):
            own = [" ".join(word() for _ in range(15)) for _ in range(2)]
            texts.append(own[0] + shared[k % 3][r.integers(0, 20) :] + own[1] if k % 4 else texts[r.integers(4, len(texts))])
        rows = [(int(i), t) for i, t in enumerate(texts)] + [(20, texts[30]), (7, texts[7])]
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted(tuple(x) for x in suffix_dedup.repeat_report(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
        assert got == sorted(self.brute([(i, (t or "").encode()) for i, t in rows]))
        assert suffix_dedup.repeat_report(empty).count() == 0
        # many blocks and shards, and windows dealt one by one wherever an anchor has over two segments
        for sizes in ({"block_bytes": 700, "shard_bytes": 900, "hot": 2}, {"block_bytes": 3000, "shard_bytes": 500, "hot": 0}, {"hot": 1}):
            small = suffix_dedup.repeat_report(table, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
            assert sorted(tuple(x) for x in small) == got

    def test_clashing_columns(self, spark, docs):
        clash = docs.selectExpr("doc_id", "text", "lang as _no_text", "source as block", "n_chars as shard", "lang as data", "source as extra", "n_chars as rest")
        kept = suffix_dedup.drop_repeats(clash)
        plain = {(r["doc_id"], r["text"]) for r in suffix_dedup.drop_repeats(docs).collect()}
        assert kept.columns == clash.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == plain

    def test_columns_stay(self, spark, docs):
        kept = suffix_dedup.drop_repeats(docs.withColumnRenamed("n_chars", "block"))
        rows = {r["doc_id"]: r for r in kept.collect()}
        assert kept.columns == ["doc_id", "text", "lang", "source", "block"] and kept.count() == docs.count()
        assert rows[0]["text"] is None and rows[11]["text"] != LONG + " tail" and rows[6]["text"] == TEXTS[6] and rows[8]["source"] == "s2" and rows[3]["block"] is None

    def test_columns_of_any_type_stay(self, spark, docs):
        typed = docs.where("doc_id > 2").selectExpr(
            "doc_id", "text", "IF(doc_id = 5, double('NaN'), doc_id / 2) AS d", "IF(doc_id = 6, null, map('k', doc_id, 'n', null)) AS m", "named_struct('a', doc_id, 'b', array(text, null)) AS s",
            "cast(doc_id AS smallint) AS h", "cast(doc_id AS decimal(20, 3)) AS dec", "encode(text, 'UTF-8') AS bin", "timestamp'2020-01-01 12:00:00' + make_interval(0, 0, 0, doc_id) AS ts",
            "date'2021-02-03' AS day", "IF(doc_id = 7, null, doc_id = 8) AS flag", "cast(null AS float) AS f", "map(1, named_struct('x', 1.5f)) AS ms")
        kept = suffix_dedup.drop_repeats(typed, block_bytes=9000)
        rest = [c for c in typed.columns if c != "text"]
        assert kept.schema.simpleString() == typed.schema.simpleString()
        assert sorted(map(str, kept.select(rest).collect())) == sorted(map(str, typed.select(rest).collect()))

    def test_greatest_and_least_numbers(self, spark):
        text, low, high = "some text of a good many letters that is in all of these documents", -(1 << 63), (1 << 63) - 1
        rows = [(None, text), (high, text), (high - 1, text), (None, "other " + text), (high, "b")]
        table = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.repeat_report(table).collect()}
        assert got == {(high - 1, 0), (high, len(text)), (None, len(text)), (high, 0)}
        table = spark.createDataFrame([(low, text), (high, text), (None, text)], "doc_id long, text string")
        assert {(r["doc_id"], r["text"]) for r in suffix_dedup.drop_repeats(table).collect()} == {(low, text), (high, ""), (None, "")}

    def test_refine_is_a_suffix_sort(self):
        r = np.random.default_rng(10)
        data = r.integers(0, 2, 3000).astype(np.uint8)
        ends = np.repeat([1000, 2200, 3000], [1000, 1200, 800])
        bucket = suffix_dedup.refine(data, ends)
        seen = {}
        for p in range(3000):
            if p + 50 <= ends[p]:
                assert seen.setdefault(data[p : p + 50].tobytes(), bucket[p]) == bucket[p]
            else:
                assert bucket[p] == -1
        assert len(set(seen.values())) == len(seen)


def corpus(n=400, seed=11):
    r = np.random.default_rng(seed)
    parts = {"en": ["the", "ing", "tion", "er", "and", "th"], "de": ["sch", "ung", "der", "ein", "ich", "ß"], "fr": ["eau", "que", "é", "les", "oi", "ç"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        words = ["".join(r.choice(parts[lang], r.integers(1, 4))) for _ in range(r.integers(20, 60))]
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(4):
                words.insert(int(r.integers(0, len(words))), str(r.choice(["idiot", "scum", "moronish", "moronly", "moroner"])))
        rows.append((i, " ".join(words), lang, "s", toxic))
    return rows


class TestClassifiers:
    def test_language(self, spark, empty):
        rows = [(i, t, None if i % 9 == 0 else lang) for i, t, lang, _, _ in corpus()] + [(1001, None, "en"), (1002, "", "de"), (1003, "12 !?", "fr"), (None, "the thing", "en")]
        got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        assert len(got) == len(rows)
        held = [(got[i]["lang_pred"], lang) for i, _, lang, _, _ in corpus() if got[i]["held_out"]]
        assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
        assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items() if i is not None)
        assert language.identify(empty.select("doc_id", "text", "lang")).count() == 0

    def test_toxicity(self, spark, docs, empty):
        rows = corpus(900)
        table = spark.createDataFrame([(i, t, s) for i, t, _, s, _ in rows] + [(5000, None, "s"), (5001, "", "s"), (None, "the thing", "s")], "doc_id long, text string, source string")
        labels = spark.createDataFrame([(i, y) for i, _, _, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
        got = {r["doc_id"]: r for r in toxicity.toxicity(table, labels).collect()}
        held = [(got[i]["predicted"], y) for i, _, _, _, y in rows if got[i]["held_out"]]
        assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.05
        assert got[5000]["predicted"] == 0 and got[5001]["score"] == got[5000]["score"]
        assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
        assert toxicity.toxicity(empty, labels).count() == 0
        none = toxicity.toxicity(docs, labels.where("false")).collect()
        assert {r["score"] for r in none} == {0.0}

    def test_gradients(self):
        r = np.random.default_rng(12)
        net = toxicity.Network(3)
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        idx = r.integers(0, 6, (5, toxicity.WINDOW))
        idx[0, 10:] = 0
        idx[1] = 0
        gates = tuple(np.concatenate([np.zeros((1, 24)), r.standard_normal((5, 24))]) for _ in "fb")
        weight = r.standard_normal(5)
        loss = lambda: float(net.forward(gates, idx) @ weight)
        _, kept = net.forward(gates, idx, keep=True)
        grads, tables = net.backward(idx, kept, weight, 6)
        for name in ("Uf", "Ub", "Wa", "va", "wo"):
            at = tuple(r.integers(0, n) for n in net.p[name].shape)
            old = net.p[name][at]
            net.p[name][at] = old + 1e-4
            up = loss()
            net.p[name][at] = old - 1e-4
            assert grads[name][at] == pytest.approx((up - loss()) / 2e-4, rel=2e-2, abs=2e-4)
            net.p[name][at] = old
        for table, gate in zip(tables, gates):
            old = gate[3, 7]
            gate[3, 7] = old + 1e-4
            up = loss()
            gate[3, 7] = old - 1e-4
            assert table[3, 7] == pytest.approx((up - loss()) / 2e-4, rel=2e-2, abs=2e-4)
            gate[3, 7] = old

    def test_windows_cover_all(self):
        for n in (0, 1, 32, 33, 48, 49, 200):
            w = toxicity.windows(np.arange(n))
            assert set(w.ravel().tolist()) - {0} == set(range(1, n + 1))


class TestArchives:
    PAGES = [(5, "http://a/x y", "p" * 200), (3, "http://b", "p" * 200), (9, None, "p" * 200), (1, "http://c", "tiny"), (2, "http://d", "tiny"), (4, "http://e", None), (6, "http://f", "é\r\n\r\nWARC/1.1\r\n\r\n" * 30), (6, "http://f", "é\r\n\r\nWARC/1.1\r\n\r\n" * 30), (None, "http://g", "p" * 200)]

    def test_round_trip(self, spark):
        pages = spark.createDataFrame(self.PAGES, "page_id long, url string, html string")
        rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()]
        want = []
        for k, _, h in self.PAGES:
            b = (h or "").encode()
            first = min((p for p, _, x in self.PAGES if p is not None and x == h), default=None)
            revisit = len(b) >= 100 and k != first
            want.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
        assert sorted(rows, key=str) == sorted(want, key=str)
        assert warc.archive_pages(pages.where("false")).count() == 0

    @pytest.mark.parametrize("version", ["1", "2"])
    def test_arc(self, version):
        blocks = [("http://a/", "20010203", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi\nthere"), ("dns:x", "19990101000000", "text/dns", b"1.2.3.4\n")]
        parsed = list(warc.arc_records(warc.arc_file(blocks, version)))
        assert [(r["url"], r["date"], r["type"], r["block"]) for r in parsed] == blocks
        head, block = next(warc.warc_records(warc.warc_from_arc(parsed[0]) + b"\n"))
        assert head["WARC-Date"] == "2001-02-03T00:00:00Z" and head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"hi\nthere").hexdigest() and block == blocks[0][3]
        assert next(warc.warc_records(warc.warc_from_arc(parsed[1]) + b"\n"))[0]["WARC-Type"] == "resource"
        with pytest.raises(ValueError):
            list(warc.arc_records(warc.arc_file(blocks, version)[:-5]))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, f"s{i % 4}", len(t)) for i, t, lang, _, _ in corpus(300)]
    rows += [(1000 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(0, 60, 2)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    labels = [(i, 1, y) for i, _, _, _, y in corpus(300)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-dedup", "suffix-array dedup", "mixing", "bpe"]
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in clean.collect()}
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 0").collect()
    assert ids == {r["doc_id"] for r in scores} and {2000, 2001} <= ids
    one = stages["near-dedup"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in one.collect()} & {r[0] for r in rows if 1000 <= r[0] < 2000} == set()
    cut = stages["suffix-array dedup"](spark, docs, str(tmp_path)).toPandas()
    assert (cut.loc[cut.doc_id.between(1000, 1999), "text"] == "").all() and (cut["n_chars"].dropna() == cut.loc[cut["n_chars"].notna(), "text"].str.len()).all()
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    sizes = mixing.mix_report(docs).groupBy("source").agg({"taken": "sum", "size": "max"}).collect()
    have = {r["source"]: r["sum(_w)"] for r in mixed.select("source", mixing.word_count(mixed["text"]).alias("_w")).groupBy("source").agg({"_w": "sum"}).collect()}
    assert all(abs(have.get(r["source"], 0) - r["sum(taken)"]) <= r["max(size)"] for r in sizes)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs.where("false"), str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert pd.Series(out.columns).is_unique


def test_clashing_columns(spark, docs):
    """Columns named like the operators' own helpers change nothing and are kept where rows are kept."""
    helpers = ["_id", "_source", "_key", "_size", "_cut", "_left", "_epochs", "times", "epoch", "_mix_times", "_mix_source", "document", "d", "g", "rep", "fp", "_c", "keys", "digest", "component_id", "_gone", "draw", "part", "check", "payload", "row", "v", "vector", "score", "score_text"]
    wide = docs.select("*", *[F.lit(i).alias(h) for i, h in enumerate(helpers)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(14)], "doc_id long, quality int, toxic int").withColumn("draw", F.lit(1)).withColumn("text", F.lit("x"))
    for report in (mixing.mix_report, simhash.simhash_components, near_copies.similar_components, lambda d: bpe.token_digests(d, BYTE), language.identify, suffix_dedup.repeat_report):
        assert sorted(map(tuple, report(wide).collect()), key=str) == sorted(map(tuple, report(docs).collect()), key=str)
    assert sorted(map(tuple, token_records.token_files(wide, WORD).select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, token_records.token_files(docs, WORD).select("doc_id", "start", "ids_crc32").collect()))
    for stage in (mixing.mix_documents, simhash.drop_near_copies, near_copies.drop_similar, suffix_dedup.drop_repeats, lambda d: toxicity.drop_toxic(d, labels)):
        kept = stage(wide)
        assert kept.columns == wide.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in stage(docs).collect())
    rows = vectors(spark, [(i, [float(i), 1.0], 0) for i in range(50)])
    more = rows.select("*", *[F.lit(i).alias(h) for i, h in enumerate(["rep", "n", "vector", "_v", "others", "node", "row", "v", "dim", "shard"])])
    assert sorted(map(tuple, embedding_dedup.embedding_components(more).collect())) == sorted(map(tuple, embedding_dedup.embedding_components(rows).collect()))
    for a, b in [(topk.whole_vectors(more), topk.whole_vectors(rows))]:
        assert sorted(map(tuple, topk.top_k(a, a).collect())) == sorted(map(tuple, topk.top_k(b, b).collect()))
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "w", "x" * 200), (None, None, None)], "page_id long, url string, html string")
    report = lambda p: sorted((tuple(x) for x in warc.archive_pages(p).select("page_id", "record_type", "payload_digest", "refers_to").collect()), key=str)
    assert report(pages.select("*", F.lit("d").alias("digest"), F.lit(1).alias("first"), F.lit("r").alias("record"))) == report(pages)


def test_repeated_vectors_are_rows(spark):
    """Each row of a repeated vec_id is a query and a candidate of its own."""
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    whole = topk.whole_vectors(vectors(spark, [(i, v, 0) for i, v in rows]))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(whole, whole.where("vec_id % 20 = 0"), k=2).collect())
    scaled = [[int(64 * c) for c in v] for _, v in rows]
    want = []
    for q in (0, 1):
        best = sorted((-sum(a * b for a, b in zip(scaled[q], scaled[c])), rows[c][0]) for c in range(4) if c != q)[:2]
        want += [(20, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_shared_folder(spark, tmp_path):
    from cellweave.llm import _spark

    held = spark.sparkContext.getCheckpointDir()
    kept = _spark.fresh_path(spark, "kept")
    folder = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or held or spark.sparkContext.getCheckpointDir()).rstrip("/")
    assert kept.startswith("file:///") and kept.removeprefix("file://").startswith(folder.removeprefix("file:").replace("///", "/"))
    with _spark.dropping_tables(spark, [kept]):
        _spark.saved(spark.range(3), "x", kept)
        gone = _spark.fresh_path(spark, "gone")
        _spark.saved(spark.range(3), "x", gone)
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone).count()


def test_tables_of_a_failing_step_and_of_two_runs(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from cellweave.llm import _spark

    def there(path):
        jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)

    paths = [_spark.fresh_path(spark, "run") for _ in range(5)]
    with pytest.raises(ZeroDivisionError), _spark.dropping_tables(spark, [paths[0]]):
        _spark.saved(spark.range(2), "x", paths[0])
        with _spark.dropping_tables(spark, []):
            _spark.saved(spark.range(2), "x", paths[1])
            1 / 0
    assert there(paths[0]) and not there(paths[1])
    both = Barrier(2, timeout=60)

    def run(path, other):
        with _spark.dropping_tables(spark, [other]):
            table = _spark.saved(spark.range(7), "x", path)
            both.wait()  # the other run has written its table, and one of the two ends first
        if path == paths[2]:
            both.wait()
            return not there(path)
        alive = table.sparkSession.read.parquet(paths[4]).count() == 7
        both.wait()
        return alive

    _spark.saved(spark.range(7), "x", paths[4])
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, paths[2:4], [paths[2] + "-no", paths[3] + "-no"])) == [True, True]
    assert not there(paths[2]) and not there(paths[3]) and there(paths[4])


def test_training_is_one_task_and_the_same_again(spark):
    docs = spark.createDataFrame(corpus(60), DOCS)
    labels = spark.createDataFrame([(i, y) for i, *_, y in corpus(60)], "doc_id long, toxic int")
    a, b = (toxicity.trained(d, labels, folds=4, fold=2) for d in (docs, docs.repartition(7)))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)
    assert toxicity.trained(docs.limit(0), labels.limit(0)) == toxicity.train([], [])


def test_scorer_is_the_plain_network():
    """Scores against a loop over windows, tokens and gates, one at a time, with the parameters of a trained network."""
    texts = [t for _, t, _, _, _ in corpus(120)]
    params = toxicity.train(texts, [y for *_, y in corpus(120)], rounds=1, steps=10)
    p, size, hidden = {k: v.astype(np.float64) for k, v in params.items()}, toxicity.SIZE, toxicity.HIDDEN
    squash = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        bucket, grams, _ = toxicity.word_inputs([word])
        rows = p["Ec"][grams]
        return np.concatenate([p["Ew"][bucket[0]], rows.mean(axis=0), rows.max(axis=0)])

    def window(words):
        states = []
        for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
            h, out = np.zeros(hidden), [None] * len(words)
            for t in order:
                x, u = vector(words[t]) @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
                z, r = squash(x[:hidden] + u[:hidden]), squash(x[hidden : 2 * hidden] + u[hidden : 2 * hidden])
                h = z * h + (1 - z) * np.tanh(x[2 * hidden :] + r * u[2 * hidden :])
                out[t] = h
            states.append(out)
        if not words:
            return float(p["bo"][0])
        s = np.array([np.concatenate([a, b]) for a, b in zip(*states)])
        e = np.tanh(s @ p["Wa"]) @ p["va"]
        w = np.exp(e - e.max())
        return float((w / w.sum()) @ s @ p["wo"] + p["bo"][0])

    some = [None, "", texts[0], " ".join(texts[:6]), "!!", " ".join(texts[:2])]
    got = toxicity.Scorer(params).score(some)
    for text, score in zip(some, got):
        words = toxicity.TOKEN.findall((text or "").lower())
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP) if len(words) > toxicity.WINDOW else [0]
        assert abs(score - squash(max(window(words[a : a + toxicity.WINDOW]) for a in starts))) < 1e-3


def test_prediction_is_the_nearest_centroid(spark):
    """Predictions against cosines of dictionaries of weights, one centroid at a time."""
    rows = [(i, t, lang) for i, t, lang, _, _ in corpus(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, letters = language.train(docs), language.letter_table()
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.predict(docs, model).collect()}
    for i, text, _ in rows:
        counts = language.gram_counts(text, letters)
        if counts is None:
            assert got[i][0] == "und"
            continue
        weights = {g: np.log1p(float(n)) * float(model["idf"][g]) for g, n in enumerate(counts) if n}
        length = sum(w * w for w in weights.values()) ** 0.5
        cosines = [sum(w * float(c[g]) for g, w in weights.items()) / length for c in model["centres"]]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        close = [model["names"][model["of"][k]] for k, c in enumerate(cosines) if c > cosines[best] - 1e-5]
        assert got[i][0] in close
        if abs(cosines[best] - model["limits"][best]) > 1e-4 and len(close) == 1:
            assert got[i][1] == (cosines[best] < model["limits"][best])


def traced_peak(f) -> int:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_repeats_follows_the_texts():
    """A shard is judged and a block is cut within a small multiple of their bytes (29 and 31 times before, where every text came twice)."""
    r = np.random.default_rng(5)
    text = r.integers(97, 123, (500, 4000), dtype=np.uint8)[r.permutation(np.repeat(np.arange(500), 2))].ravel()
    ids = suffix_dedup._arrays(np.arange(1000), np.full(1000, 4000), *[np.zeros(1000, dtype=np.uint8)] * 2)
    rows = pd.DataFrame({"data": [suffix_dedup._squeeze(text.tobytes())], "extra": [ids]})
    assert traced_peak(lambda: suffix_dedup._removed(rows)) < 20 * len(text)
    messages = []
    for half, first in ((text[:2_000_000], 0), (text[2_000_000:], 500)):
        starts, counts, keys, docs, _ = suffix_dedup.runs(half, np.arange(4000, len(half) + 1, 4000))
        part = (keys >> np.uint64(8) & np.uint64(suffix_dedup.PARTS - 1)).astype(np.uint8)
        lengths = counts + suffix_dedup.LENGTH - 1
        messages.append(suffix_dedup._arrays(lengths.astype(np.int32), docs + first, bpe.ragged(half, starts, lengths), part, starts.astype(np.int32), keys[:0]))
    assert traced_peak(lambda: suffix_dedup.judge(pd.DataFrame({"block": [1, 2], "data": messages}))) < 20 * len(text)


def test_memory_of_tokens_does_not_follow_the_new_words():
    """New words are encoded piece by piece: 28 bytes of work for each byte of these texts, 101 before."""
    r = np.random.default_rng(6)
    words = ["".join(w) for w in r.choice(list("abcdefghijklmnopqrstuvwxyz"), (300_000, 12)).tolist()]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    vocabulary = bpe.BytePairs(open(BYTE).read())
    assert traced_peak(lambda: bpe.Encoder(vocabulary).encode(texts)) < 60 * sum(map(len, texts))
    some, t = texts[::300], Tokenizer.from_file(BYTE)
    assert [i.tolist() for i in bpe.Encoder(vocabulary).encode(some)] == [x.ids for x in t.encode_batch(some, add_special_tokens=False)]
    pieces = list(bpe.pieces_of(["a", "é" * 40, "", "b", "cd"], 50))
    assert b"".join(b"".join(p) for p in pieces).decode() == "a" + "é" * 40 + "bcd" and [len(p) for p in pieces] == [2, 3]


def test_work_of_a_shard_does_not_follow_parts_times_messages():
    """A shard's segments cost the same from few blocks or many (a message more took 2,800 calls before: each part went over all messages)."""
    r = np.random.default_rng(12)
    text = r.integers(97, 100, 60_000).astype(np.uint8)
    text[30_000:40_000] = text[:10_000]
    starts, counts, keys, docs, _ = suffix_dedup.runs(text, np.arange(500, len(text) + 1, 500))
    part, lengths = (keys >> np.uint64(8) & np.uint64(suffix_dedup.PARTS - 1)).astype(np.uint8), counts + suffix_dedup.LENGTH - 1

    def judged(blocks):
        some = [np.flatnonzero(docs * blocks // 120 == b) for b in range(blocks)]
        data = [suffix_dedup._arrays(lengths[i].astype(np.int32), docs[i], bpe.ragged(text, starts[i], lengths[i]), part[i], starts[i].astype(np.int32), keys[:0]) for i in some]
        rows, calls = pd.DataFrame({"block": range(blocks), "data": data}), Counter()
        sys.setprofile(lambda frame, event, arg: calls.update([event]))
        try:
            verdicts = suffix_dedup.judge(rows)
        finally:
            sys.setprofile(None)
        found = [suffix_dedup._from_arrays(d) for d in verdicts["data"]]
        windows = np.concatenate([suffix_dedup._places(np.cumsum(first), size.astype(np.int64)) for first, size in found])
        return sorted(windows.tolist()), calls["call"] + calls["c_call"]

    (few, calls_few), (many, calls_many) = judged(2), judged(60)
    seen, repeated = {}, []
    for p in range(len(text) - 49):
        if p // 500 == (p + 49) // 500 and seen.setdefault(text[p : p + 50].tobytes(), p // 500) < p // 500:
            repeated.append(p)
    assert few == many == repeated and len(repeated) > 5000
    assert calls_many - calls_few < 300 * 58


def test_refine_of_short_segments():
    r = np.random.default_rng(13)
    lengths = r.integers(1, 90, 400)
    data, ends = r.integers(0, 2, int(lengths.sum())).astype(np.uint8) * 255, np.repeat(np.cumsum(lengths), lengths)
    data[2000:2500] = 0
    for length in (5, 8, 20, 50):
        for at_once in (16, 1 << 18):
            bucket, of = suffix_dedup.refine(data, ends, length, at_once), {}
            for p in range(len(data)):
                assert (bucket[p] == -1) == (p + length > ends[p])
                if bucket[p] >= 0:
                    assert of.setdefault(data[p : p + length].tobytes(), bucket[p]) == bucket[p]
            assert len(set(of.values())) == len(of)
    assert suffix_dedup.refine(data[:0], ends[:0]).tolist() == []
