"""How far the sources of a language lie from each other, by joint histograms of their terms' counts.

Blocks of whole texts are counted inside tasks, so that what is shuffled is a row per
(block, language, source, term), never a row per word.  The terms that a language keeps
stand with their sources in one row each; tasks tally, for every two sources of such a
row, the combination of the two counts, and sum equal combinations before they
leave.  Terms that one or both sources lack are not visited: their combinations (count,
0), (0, count) and (0, 0) are what the sources' own histograms of counts leave over.
The divergence is then evaluated once for each combination and taken times its
multiplicity.

A row of a term holds a count for each source of its language that has it, and the
result a row for every two sources: both are bounded by the number of sources, not of
documents.  All arithmetic is in integers, products beyond 64 bits in decimals.

Defined cases: null texts, languages and sources are empty ones; a group without terms and a
language that keeps none have their rows (value 0, no terms); rows that repeat a document count as documents
of their own; an empty table gives an empty result; texts are read whole, one block of texts at a time;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved
from .bpe import arrow_blocks, ragged

#: A term of a text that was lower-cased (A-Z only), in its UTF-8 bytes.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Pairs of counts tallied at a time.
AT_ONCE = 1 << 20
#: Parts into which the pairs of a language's sources are dealt.
DEALT = 32


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, summed over blocks."""

    def run(batches):
        for b in arrow_blocks(batches, 2, 8 << 20):
            groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = TERM.findall(text.as_py().lower())
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                docs.update(set(found))
            for (lang, source), (n, docs) in groups.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), type=pa.string()), pa.array([source] * len(n), type=pa.string()), pa.array([t.decode() for t in n], type=pa.string()), pa.array(n.values(), type=pa.int64()), pa.array([docs[t] for t in n], type=pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    rows = docs.select(named[0].alias("lang"), named[1].alias("source"), named[2].cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, counts): the terms in at least so many documents of their language, with (source, n) by source."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_term.where(F.col("docs") >= least).drop("docs")


def joint_counts(kept: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m): of the terms that sources a < b both have, m have x occurrences in a and y in b."""

    def tally(lang, rows, entries, source, count):
        """Combinations of one language: ``rows`` holds the first entry of each term, ``entries`` their number."""
        names = source.dictionary_encode()
        code, name = names.indices.to_numpy().astype(np.int64), names.dictionary
        # every entry with each entry after it of its row, so many pairs at a time
        after = np.repeat(rows + entries, entries) - np.arange(len(code)) - 1
        upto, at = np.cumsum(after), 0
        while at < len(after):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
            left = np.repeat(np.arange(at, end), after[at:end])
            right = ragged(np.arange(len(code)), np.arange(at, end) + 1, after[at:end])
            at = end
            if not len(left):
                continue
            pair, which = np.unique(code[left] * len(name) + code[right], return_inverse=True)
            x, x_of = np.unique(count[left], return_inverse=True)
            y, y_of = np.unique(count[right], return_inverse=True)
            # each of the three has fewer than 2 ** 21 values
            cell, m = np.unique((which * len(x) + x_of) * len(y) + y_of, return_counts=True)
            p = pair[cell // len(y) // len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cell), type=pa.string()), name.take(pa.array(p // len(name))), name.take(pa.array(p % len(name))), pa.array(x[cell // len(y) % len(x)]), pa.array(y[cell % len(y)]), pa.array(m.astype(np.int64))],
                names=["lang", "a", "b", "x", "y", "m"])

    def run(batches):
        for b in batches:
            langs = b.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                counts = b.column(1).filter(pa.array(langs.indices.to_numpy() == i))
                flat = counts.flatten()
                sizes = np.diff(counts.offsets.to_numpy()).astype(np.int64)
                yield from tally(lang, np.cumsum(sizes) - sizes, sizes, flat.field(0), flat.field(1).to_numpy())

    cells = kept.select("lang", "counts").mapInArrow(run, "lang string, a string, b string, x long, y long, m long")
    return cells.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {terms} AS DECIMAL(20, 0))")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so 64 bits do."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has a row for each other source, part ``term`` the group's most telling terms."""
    counts = term_counts(docs, lang_col, source_col, text_col)
    kept = saved(kept_terms(counts, least), "kept-terms")
    own = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    histograms = saved(own.groupBy("lang", "source", F.col("n").alias("x")).agg(F.count(F.lit(1)).alias("m")), "count-histograms")
    joint = saved(joint_counts(kept), "joint-counts")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = histograms.groupBy("lang", "source").agg(F.sum(F.col("x") * F.col("m")).alias("total"), F.sum("m").alias("held"))
    groups = saved(
        named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "held", "terms", "lang_total")]), "groups")

    def of(side: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(side), F.col("total").alias(f"{side}_total"), F.col("held").alias(f"{side}_held"), *(["terms"] if side == "a" else []))

    # the result's own rows, halved; dealt by both sources, so that a language of many is no single task
    dealt = of("a").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    pairs = saved(dealt.join(of("b").withColumn("part", F.pmod(F.hash("b"), F.lit(DEALT))), ["lang", "part"]).where("a < b").drop("part"), "pairs")

    # what the two sources' own histograms leave over once the shared terms are taken off
    zero = F.lit(0).cast("long")
    spec = ["lang", "a", "b"]
    single = histograms.withColumnRenamed("m", "h")
    cells = (
        pairs.select(*spec).join(single.withColumnRenamed("source", "a"), ["lang", "a"]).select(*spec, "x", zero.alias("y"), F.col("h").alias("m"))
        .unionAll(pairs.select(*spec).join(single.withColumnRenamed("source", "b"), ["lang", "b"]).select(*spec, zero.alias("x"), F.col("x").alias("y"), F.col("h").alias("m")))
        .unionAll(joint.groupBy(*spec, "x").agg((-F.sum("m")).alias("m")).select(*spec, "x", zero.alias("y"), "m"))
        .unionAll(joint.groupBy(*spec, "y").agg((-F.sum("m")).alias("m")).select(*spec, zero.alias("x"), "y", "m"))
    ).groupBy(*spec, "x", "y").agg(F.sum("m").alias("m")).where("m > 0")
    neither = (
        pairs.join(joint.groupBy(*spec).agg(F.sum("m").alias("both")), spec, "left")
        .select(*spec, zero.alias("x"), zero.alias("y"), F.expr("terms - a_held - b_held + coalesce(both, 0)").alias("m")).where("m > 0")
    )
    combinations = joint.select(*spec, "x", "y", "m").unionAll(cells).unionAll(neither)
    value = (
        combinations.join(pairs, spec).withColumn("p", share("x", "a_total", "terms")).withColumn("q", share("y", "b_total", "terms"))
        .groupBy(*spec).agg(F.sum(divergence("p", "q") * F.col("m")).alias("value"))
    )
    valued = pairs.select(*spec).join(value, spec, "left").select(*spec, F.coalesce("value", zero).alias("value"))
    # p and q change places without changing the value
    both = valued.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    pair_rows = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    telling = (
        own.join(groups.withColumnRenamed("total", "group_total"), ["lang", "source"])
        .withColumn("p", share("n", "group_total", "terms")).withColumn("q", share("total", "lang_total", "terms")).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # of a group's terms each task passes on its first ones only; a group's pairs are a row per source
    ranked_terms = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair_rows.withColumn("rank", F.row_number().over(order)).unionAll(ranked_terms).select("lang", "source", "part", "item", "value", "rank")
