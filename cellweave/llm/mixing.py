"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Within a source the keys are cut into
about sqrt(n) ranges, so that no source, however large, is sorted in one task:
the ranges' token counts are summed (with partial sums before the shuffle),
their prefix sums give the range in which the source's budget ends, and only
that range is sorted document by document.  The result is one small row per
source: how many whole epochs it runs and the key at which the last one stops.
Applying it to the documents is a join with that small table.

Defined cases: a null text counts 0 tokens; a null source is a source of its
own and comes last; an empty table gives an empty mix; rows that repeat a key
share what is left of the budget in proportion to their size (rounded down);
other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: str = "mix") -> Column:
    """60 random bits that depend on the identifier alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """One row per source of ``sized`` (``_source``, ``_size``): rows, size and target.

    The weights repeat over the sources in code-point order.  Targets above
    ``max_epochs`` times the size stay there and the excess goes to the others
    by weight.  In closed form: sort by cap/weight; the first k sources are
    capped, where k is the smallest number for which the remainder, shared by
    weight, puts none of the others above its cap.
    """
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    # These windows hold a row per source.
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    return (
        totals.withColumn("_weight", weight)
        .withColumn("_cap", F.col("_total") * max_epochs)
        .withColumn("_budget", F.least(F.sum("_total").over(everything) * F.lit(float(share)), F.sum("_cap").over(everything).cast("double")))
        .withColumn("_level", level)
        # the first source that the level does not lift over its cap sets the level of all after it
        .withColumn("_final", F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_level")))).over(everything)["_level"])
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_final") * F.col("_weight"), F.col("_cap").cast("double"))))
        .select("_source", "_total", "_rows", "target")
    )


def source_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds to ``targets``: whole epochs, the key where the last epoch stops, and what the rows at that key take.

    ``_epochs`` whole passes; rows with a key below ``_cut`` are taken once
    more; rows at ``_cut`` take ``_size * _left div _unit`` more.
    """
    t = (
        targets.withColumn("_words", F.floor("target").cast("long"))
        .withColumn("_epochs", F.when(F.col("_total") > 0, F.expr("_words div _total")).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("_words") - F.col("_epochs") * F.col("_total"))
        .withColumn("_ranges", F.ceil(F.sqrt("_rows")).cast("long"))
    )
    same_source = F.col("s._source").eqNullSafe(F.col("t._source"))
    ranged = (
        sized.alias("s").join(t.alias("t"), same_source)
        .select("t._source", "_key", "_size", "_rest", F.least(F.floor(F.col("_key") / F.lit(float(1 << 60)) * F.col("_ranges")), F.col("_ranges") - 1).alias("_range"))
    )
    by_range = Window.partitionBy("_source").orderBy("_range")
    sums = ranged.groupBy("_source", "_range", "_rest").agg(F.sum("_size").alias("_sum"))
    stop = (
        sums.withColumn("_end", F.sum("_sum").over(by_range))
        .where("_end > _rest and _end - _sum <= _rest")
        .select("_source", "_range", (F.col("_end") - F.col("_sum")).alias("_before"))
    )
    within = Window.partitionBy("_source").orderBy("_key")  # rows of one range of each source
    units = (
        ranged.alias("r").join(stop.alias("p"), F.col("r._source").eqNullSafe(F.col("p._source")) & (F.col("r._range") == F.col("p._range")))
        .groupBy(F.col("p._source").alias("_source"), "_key", "_before", "_rest").agg(F.sum("_size").alias("_unit"))
        .withColumn("_upto", F.sum("_unit").over(within) + F.col("_before"))
        .where("_upto > _rest and _upto - _unit <= _rest")
        .select("_source", F.col("_key").alias("_cut"), "_unit", (F.col("_rest") - F.col("_upto") + F.col("_unit")).alias("_left"))
    )
    return t.alias("t").join(units.alias("u"), F.col("t._source").eqNullSafe(F.col("u._source")), "left").select("t._source", "_total", "target", "_epochs", "_cut", "_unit", "_left")


def mixed_sizes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(sizes, cuts): a row per document with ``_id``, ``_source``, ``_key``, ``_size``, and the table of :func:`source_cuts`."""
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), mix_key(F.col(id_col), seed).alias("_key"), word_count(F.col(text_col)).alias("_size"))
    sized = saved(sized, "mix-sizes")  # texts are read once
    cuts = saved(source_cuts(sized, source_targets(sized, weights, share, max_epochs)), "mix-cuts")  # a row per source
    return sized, cuts


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted)."""
    sized, cuts = mixed_sizes(docs, **options)
    more = F.when(F.col("_key") < F.col("_cut"), F.col("_size")).when((F.col("_key") == F.col("_cut")) & (F.col("_unit") > 0), F.expr("_size * _left div _unit")).otherwise(F.lit(0))
    return (
        sized.alias("s").join(cuts.alias("c"), F.col("s._source").eqNullSafe(F.col("c._source")))
        .select(F.col("_id").alias("doc_id"), F.col("s._source").alias("source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), "target", (F.col("_epochs") * F.col("_size") + more).cast("long").alias("taken"))
    )


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as its source's epochs ask.

    Documents stay whole here: the one in which the budget ends is taken.  The
    columns are those of ``docs``.  Texts are not shuffled: a document's key and
    its source's row of the cuts decide alone.
    """
    _, cuts = mixed_sizes(docs, weights, share, max_epochs, id_col, source_col, text_col, seed)
    # the document is one column here, so that no name of its own can clash
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"))
    key, source = mix_key(F.col(f"document.`{id_col}`"), seed), F.col(f"document.`{source_col}`")
    once_more = F.when((key < F.col("_cut")) | ((key == F.col("_cut")) & (F.col("_left") > 0)), 1).otherwise(0)
    times = (F.col("_epochs") + once_more).cast("int")
    return (
        whole.join(cuts, source.eqNullSafe(F.col("_source")))
        .withColumn("times", times).where("times > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select("document.*")
    )
