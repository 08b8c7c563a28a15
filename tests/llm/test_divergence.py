"""Divergence of sources against a plain computation over all terms, absent ones too."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cellweave.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top=10):
    found = [(lang or "", source or "", Counter(TERM.findall(lower(text or "")))) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in found}:
        own = [r for r in found if r[0] == lang]
        held = Counter(t for r in own for t in r[2])
        kept = {t for t, n in held.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, c in own:
            counts[source].update({t: n for t, n in c.items() if t in kept})
        whole = sum(counts.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(counts[s]) for s in counts}, share(whole)
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:top], 1)}
    return out


def corpus(seed=3):
    r = random.Random(seed)
    words = ["Ab", "ab", "aB", "É", "é", "ſ", "K", "don't", "x1y", "日本", "tail", "\x00z", "ß"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(None, "en", "a"), ("", None, None), ("...", "fr", "a"), (None, None, "b"), ("only here", "de", "a"), ("only here", "de", "a"), ("", "de", "ñ")]
    for _ in range(220):
        lang = r.choice(["en", "en", "fr", None])
        source = r.choice(["a", "a", "a", "b", "B", "é", None])
        rows.append((" ".join(r.choices(words, k=r.randrange(25))), lang, source))
    return rows


@pytest.mark.parametrize("at_once", [5, 1 << 20])
@pytest.mark.parametrize("least", [1, 10])
def test_against_all_terms(spark, monkeypatch, at_once, least):
    rows = corpus()
    docs = spark.createDataFrame([(i, *row, 1, "m") for i, row in enumerate(rows)], "doc_id long, text string, lang string, source string, x int, m string").repartition(3)
    monkeypatch.setattr(divergence, "AT_ONCE", at_once)
    got = divergence.source_divergence(docs, least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == plain(rows, least)


def test_no_terms_and_no_rows(spark):
    docs = spark.createDataFrame([("few words", "en", s) for s in "abc"], "text string, lang string, source string")
    got = {tuple(r) for r in divergence.source_divergence(docs).collect()}
    assert got == plain([("few words", "en", s) for s in "abc"], 10) and {r[4] for r in got} == {0}
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_large_counts(spark):
    """Products beyond 64 bits."""
    n, total, terms = 10**12, 3 * 10**12 + 7, 11
    got = spark.range(1).select(divergence.share(f"{n}L", f"{total}L", f"{terms}L").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
    p, q = 10**9 + 1, 3
    assert spark.range(1).select(divergence.divergence(f"{p}L", f"{q}L").alias("f")).first()["f"] == (p - q) ** 2 // (p + q)
