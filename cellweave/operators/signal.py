"""Ordered operators over positions (key, pos, amplitude): grouping, regular spacing, folds, one-dimensional k-means.

What depends on neighbours is a window over the key; what depends on the last
row kept is a fold over the key's sorted array, inside the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digits import js_round, rounded


def gaps(positions: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    w = Window.partitionBy(key).orderBy(pos)
    return positions.withColumn("gap", F.col(pos) - F.lag(pos).over(w))


def chains(positions: DataFrame, key: str, most: float, pos: str = "pos") -> DataFrame:
    """``group``: a new one where the step from the last position is above ``most``."""
    w = Window.partitionBy(key).orderBy(pos)
    return gaps(positions, key, pos).withColumn("group", F.sum(F.when(F.col("gap") > most, 1).otherwise(0)).over(w)).drop("gap")


def border_centres(positions: DataFrame, key: str, most: float = 10, least: float = 0.001) -> DataFrame:
    """Centre (weighted by amplitude, rounded) and greatest amplitude of each island of non-zero positions."""
    grouped = chains(positions.where(F.col("amplitude") > least), key, most).groupBy(key, "group")
    return grouped.agg(js_round(F.sum(F.col("pos") * F.col("amplitude")) / F.sum("amplitude")).alias("centre"), F.max("amplitude").alias("amplitude")).select(key, "group", "centre", "amplitude")


def cluster_peaks(positions: DataFrame, key: str, radius: float) -> DataFrame:
    return chains(positions, key, radius).groupBy(key, "group").agg(js_round(F.avg("pos")).alias("centre"), F.count(F.lit(1)).alias("members"))


def peak_runs(positions: DataFrame, key: str, share: float = 0.4) -> DataFrame:
    """Maximal runs of consecutive positions strictly above a share of the key's greatest amplitude: first, last, weighted centre."""
    high = positions.withColumn("_top", F.max("amplitude").over(Window.partitionBy(key))).where(F.col("amplitude") > share * F.col("_top"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return high.withColumn("_run", run).groupBy(key, "_run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), js_round(F.sum(F.col("pos") * F.col("amplitude")) / F.sum("amplitude")).alias("centre")).drop("_run")


def local_maxima(positions: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("pos")
    return positions.withColumns({"_a": F.lag("amplitude").over(w), "_b": F.lead("amplitude").over(w)}).where("amplitude > 0 and amplitude >= _a and amplitude >= _b").drop("_a", "_b")


def upper_median(x: Column) -> Column:
    """sorted[n // 2] of an array column's values."""
    s = F.array_sort(x)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def by_index(x: Column, share: float) -> Column:
    """sorted[floor(n * share)]."""
    s = F.array_sort(x)
    return F.get(s, F.floor(F.size(s) * share).cast("int"))


def regularize(positions: DataFrame, key: str, step: Column, most: int = 4, gate: float | None = 2.0) -> DataFrame:
    """Positions with the missing ones between them: round(gap / step) - 1 of them, if 1 to ``most`` and the gap is above ``gate`` steps."""
    w = Window.partitionBy(key).orderBy("pos")
    n = js_round((F.lead("pos").over(w) - F.col("pos")) / step) - 1
    ratio = (F.lead("pos").over(w) - F.col("pos")) / step
    wanted = positions.withColumns({"_n": n, "_ratio": ratio, "_step": step})
    ok = F.col("_n").between(1, most) & (F.lit(True) if gate is None else F.col("_ratio") > gate)
    added = wanted.where(ok).select(key, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("m"), "pos", "_step").select(key, js_round(F.col("pos") + F.col("_step") * F.col("m")).cast("long").alias("pos"), F.lit(True).alias("inserted"))
    return positions.select(key, F.col("pos").cast("long").alias("pos"), F.lit(False).alias("inserted")).unionByName(added)


def gap_medians(positions: DataFrame, key: str, upper: bool = True) -> DataFrame:
    g = gaps(positions, key).where("gap is not null").groupBy(key)
    return g.agg(upper_median(F.collect_list("gap")).alias("median_gap") if upper else F.median("gap").alias("median_gap"))


def uniformity(positions: DataFrame, key: str, tolerance: float = 0.4, upper: bool = True) -> DataFrame:
    """Whether no gap is off the median gap by more than twice the tolerance."""
    medians = gap_medians(positions, key, upper)
    off = F.coalesce(F.try_divide(F.abs(F.col("gap") - F.col("median_gap")).cast("double"), F.col("median_gap")), F.lit(0.0))
    return gaps(positions, key).where("gap is not null").join(medians, key).groupBy(key).agg((F.max(off) <= 2 * tolerance).alias("uniform"), F.round(F.max(off), 9).alias("worst"))


def clue_column(positions: DataFrame, key: str) -> DataFrame:
    """Index of the widest gap (the first of equals), if it is above twice the upper median."""
    g = gaps(positions, key).withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 2).where("gap is not null")
    return g.groupBy(key).agg(F.max(F.struct("gap", (-F.col("ord")).alias("o"))).alias("m"), upper_median(F.collect_list("gap")).alias("median_gap")).select(key, F.when(F.col("m.gap") > 2 * F.col("median_gap"), -F.col("m.o")).alias("split_at"))


def order_statistics(values: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per key the values at places of the sorted order (from 0, as functions of the number of values); nulls do not count.

    A key may hold a third of all rows: its values fall into about sqrt(n)
    ranges of one width, whose counts' prefix sums tell the range of each place;
    only those ranges are sorted, and equal values are one row.
    """
    v = values.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    span = v.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    ranges = F.ceil(F.sqrt("_all"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges)).otherwise(0)
    ranged = v.join(span, key).withColumn("_range", at)
    by_range = Window.partitionBy(key).orderBy("_range")
    counts = ranged.groupBy(key, "_range").agg(F.sum("_n").alias("_in")).withColumn("_before", F.sum("_in").over(by_range) - F.col("_in"))
    asked = span.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("_all")).cast("long").alias("place")) for name, f in places.items()])).alias("a")).select(key, "a.*")
    hit = counts.join(asked, key).where("place >= _before and place < _before + _in").select(key, "_range", "name", "place", "_before")
    inside = ranged.join(hit, [key, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(key, "_range", "name").orderBy("_v")))
    found = inside.where("_upto > place").groupBy(key, "name").agg(F.min("_v").alias("_at"))
    return found.groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col("_at"))).alias(name) for name in places])


def modal_value(values: DataFrame, key: str, value: str, buckets: int = 10) -> DataFrame:
    """Middle of the fullest of equally wide buckets, the first of equals; the minimum if all values are equal."""
    span = values.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1)).cast("int")
    counts = values.join(span, key).withColumn("bucket", F.when(F.col("hi") > F.col("lo"), at).otherwise(0)).groupBy(key, "bucket", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key, "lo", "hi").agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("b"))
    return best.select(key, F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / buckets).otherwise(F.col("lo")).alias("modal"))


def _sorted_rows(positions: DataFrame, key: str, *columns: str) -> DataFrame:
    return positions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def dedupe_fold(positions: DataFrame, key: str, least: float) -> DataFrame:
    """Keeps positions at least ``least`` after the last one kept; a nearer one replaces it if its amplitude is larger."""
    def step(kept, x):
        last = F.element_at(kept, -1)
        return F.when(F.size(kept) == 0, F.array(x)).when(x["pos"] - last["pos"] >= least, F.concat(kept, F.array(x))).when(x["amplitude"] > last["amplitude"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)

    rows = _sorted_rows(positions, key, "pos", "amplitude")
    return rows.select(key, F.explode(F.aggregate("rows", F.slice("rows", 1, 0), step)).alias("x")).select(key, "x.pos", "x.amplitude")


def anchor_groups(positions: DataFrame, key: str, most: float) -> DataFrame:
    """Groups of positions within ``most`` of the group's first one: (anchor, members)."""
    def step(groups, x):
        last = F.element_at(groups, -1)
        grown = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.struct(last["anchor"].alias("anchor"), (last["members"] + 1).alias("members"))))
        return F.when((F.size(groups) > 0) & (x["pos"] - F.coalesce(last["anchor"], x["pos"]) <= most), F.when(F.size(groups) > 0, grown)).otherwise(F.concat(groups, F.array(F.struct(x["pos"].alias("anchor"), F.lit(1).alias("members")))))

    rows = _sorted_rows(positions, key, "pos")
    start = F.expr("cast(array() as array<struct<anchor:bigint,members:int>>)")
    return rows.select(key, F.explode(F.aggregate("rows", start, step)).alias("x")).select(key, "x.anchor", "x.members")


def merge_sorted(rows: Column, most: float) -> Column:
    """The lines (array of doubles) that rising positions (array) form: one within ``most`` of the running average of the last line is merged into it, pairwise."""
    def step(lines, x):
        last = F.element_at(lines, -1)
        return F.when((F.size(lines) > 0) & (F.abs(x - F.coalesce(last, F.lit(0.0))) <= most), F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array((last + x) / 2))).otherwise(F.concat(lines, F.array(x.cast("double"))))

    return F.aggregate(rows, F.expr("cast(array() as array<double>)"), lambda a, x: F.when(F.size(a) == 0, F.array(x.cast("double"))).otherwise(step(a, x)))


def merge_close(positions: DataFrame, key: str, most: float) -> DataFrame:
    """Positions within ``most`` of the running average of a line are merged into it, pairwise: (line)."""
    rows = _sorted_rows(positions, key, "pos")
    return rows.select(key, F.explode(merge_sorted(F.transform("rows", lambda x: x["pos"]), most)).alias("line"))


def nms_peaks(positions: DataFrame, key: str, separation: float) -> DataFrame:
    """Greedy: by falling amplitude, a peak stays if at least ``separation`` from all that stay."""
    rows = positions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("amplitude")).alias("a"), "pos"))).alias("rows"))
    step = lambda kept, x: F.when(F.exists(kept, lambda p: F.abs(p - x["pos"]) < separation), kept).otherwise(F.concat(kept, F.array(x["pos"])))
    return rows.select(key, F.explode(F.aggregate("rows", F.expr("cast(array() as array<bigint>)"), step)).alias("pos"))


def kmeans_1d(values: DataFrame, key: str, value: str, k: int, rounds: int = 10, rounded: bool = False) -> DataFrame:
    """(key, centroids): Lloyd's algorithm, exactly ``rounds`` rounds, from the values at i/k of the sorted order.

    An empty cluster keeps its centroid; fewer values than k give their mean.
    Works on (value, count) pairs in one array per key.
    """
    counted = values.groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("v")
    ranked = counted.withColumn("upto", F.sum("n").over(w))
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("v", "n", "upto"))).alias("rows"), F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    place = lambda i: (js_round(i / F.lit(float(k)) * F.col("total")) if rounded else F.floor(i / F.lit(float(k)) * F.col("total")))
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(F.filter("rows", lambda r: r["upto"] > F.least(place(i), F.col("total") - 1)), 1)["v"])
    nearest = lambda cs, v: F.array_position(F.transform(cs, lambda c: F.abs(c - v)), F.array_min(F.transform(cs, lambda c: F.abs(c - v))))

    def lloyd(cs, _):
        def moved(c, i):
            mine = F.filter("rows", lambda r: nearest(cs, r["v"]) == i + 1)
            n = F.aggregate(mine, F.lit(0).cast("long"), lambda s, r: s + r["n"])
            return F.when(n > 0, F.try_divide(F.aggregate(mine, F.lit(0.0), lambda s, r: s + r["v"] * r["n"]), n)).otherwise(c)

        return F.transform(cs, moved)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lloyd)
    return rows.select(key, F.when(F.col("total") < k, F.array("mean")).otherwise(found).alias("centroids"))


def regularize_positions(positions: DataFrame, key: str, radius: float = 6, deviation: float = 0.45, most: int = 3) -> DataFrame:
    """Chain clusters, gaps, 2-means of the gaps; a gap that is off its own mean is filled by that mean's step, 1 to ``most`` times.

    A gap's label is from the last round's start, its mean from that round's end.
    """
    peaks = cluster_peaks(positions, key, radius).select(key, F.col("centre").alias("pos"))
    between = gaps(peaks, key).where("gap is not null")
    labels = kmeans_1d(between, key, "gap", 2, rounds=9).select(key, F.col("centroids").alias("_last"))
    means = kmeans_1d(between, key, "gap", 2, rounds=10).select(key, F.col("centroids").alias("_means"))
    off = F.transform("_last", lambda c: F.abs(c - F.col("gap")))
    own = F.element_at("_means", F.array_position(off, F.array_min(off)).cast("int"))
    step = between.join(labels, key).join(means, key).withColumn("_step", own)
    n = js_round(F.col("gap") / F.col("_step")) - 1
    missing = step.where(F.abs(F.col("gap") - F.col("_step")) / F.col("_step") > deviation).withColumn("_n", n).where(F.col("_n").between(1, most))
    added = missing.select(key, (F.col("pos") - F.col("gap")).alias("pos"), "_step", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("m"))
    added = added.select(key, js_round(F.col("pos") + F.col("_step") * F.col("m")).cast("long").alias("pos"), F.lit(True).alias("inserted"))
    return peaks.select(key, F.col("pos").cast("long").alias("pos"), F.lit(False).alias("inserted")).unionByName(added)


def vote_accumulator(points: DataFrame, key: str, x: Column, y: Column, size: int = 8, least: int = 3) -> DataFrame:
    """Square buckets with at least ``least`` points, by their centre."""
    return points.groupBy(key, F.floor(x / size).alias("bx"), F.floor(y / size).alias("by")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least).select(key, ((F.col("bx") + 0.5) * size).alias("x"), ((F.col("by") + 0.5) * size).alias("y"), "votes")


def dealt_pairs(one: DataFrame, other: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """All pairs of a key's rows of two tables.  A key may hold a share of all rows: its rows of the first are dealt to ``parts`` parts, each of which meets all its rows of the other."""
    dealt = one.withColumn("_part", F.pmod(F.xxhash64(*[c for c in one.columns if c != key]), F.lit(parts)).cast("int")).repartition(4 * parts, key, "_part")
    every = other.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(every.hint("shuffle_hash"), [key, "_part"]).drop("_part")


def intersections(lines: DataFrame, key: str, width: float, height: float, decimals: int) -> DataFrame:
    """Where a key's horizontal and vertical lines cross, inside the image, a row for each pair.  Lines: key, kind, line (struct).

    Equal lines of a key are one row, with their number, until their crossings are known and rounded.  Ends are plain columns:
    structs made and taken apart for each pair are more code than Java compiles.
    """
    from ..functions.geometry import crossing

    counted = lines.groupBy(key, "kind", "line").agg(F.count(F.lit(1)).alias("_n"))
    ends = ("x1", "y1", "x2", "y2")
    h, v = (counted.where(F.col("kind") == kind).select(key, *[F.col("line")[e].alias(f"_{name}_{e}") for e in ends], F.col("_n").alias(f"_{name}")) for kind, name in (("horizontal", "h"), ("vertical", "v")))
    meet, x, y = crossing(*({e: F.col(f"_{name}_{e}") for e in ends} for name in "hv"))
    inside = dealt_pairs(h, v, key).where(meet & x.between(0, width) & y.between(0, height)).select(key, x.alias("x"), y.alias("y"), "_h", "_v")
    found = inside.select(key, rounded("x", decimals).alias("x"), rounded("y", decimals).alias("y"), F.least("_h", "_v").alias("_few"), F.greatest("_h", "_v").alias("_many"))
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    each = _one_by_one(_one_by_one(found).select(key, "x", "y", "_many", times("_few")).select(key, "x", "y", "_many"))
    return each.select(key, "x", "y", times("_many")).select(key, "x", "y")


def _one_by_one(rows: DataFrame) -> DataFrame:
    """The same rows, by an operator that is not compiled into those around it.

    What is compiled as one holds all that a row of its input becomes, so a line that meets many would hold all their crossings, each as often as it returns.
    """
    return rows.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)))


def nearest_rows(words: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each word's nearest row by |y - row_y|, the lowest of equals."""
    return words.join(rows, key).groupBy(key, "word").agg(F.min_by("row", F.struct(F.abs(F.col("y") - F.col("row_y")), "row")).alias("row"))


def phase(positions: DataFrame, key: str, period: float) -> DataFrame:
    """The offset that fits positions to a period: a circular mean."""
    turn = F.col("pos") * F.lit(2 * 3.141592653589793 / period)
    return positions.groupBy(key).agg((F.pmod(F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn))), F.lit(2 * 3.141592653589793)) * period / (2 * 3.141592653589793)).alias("phase"))


def distinct_positions(positions: DataFrame, key: str) -> DataFrame:
    """Each key's positions once, as a sorted array."""
    return positions.groupBy(key).agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def first_detection(results: list[DataFrame], key: str) -> DataFrame:
    """Of detectors in order (key, grid, error), the first result of each key that has no error."""
    tried = None
    for n, r in enumerate(results):
        part = r.where("error is null").select(key, F.lit(n).alias("detector"), "grid")
        tried = part if tried is None else tried.unionByName(part)
    return tried.groupBy(key).agg(F.min(F.struct("detector", "grid")).alias("r")).select(key, "r.detector", "r.grid")


def grid_lines(spark_positions: DataFrame, key: str, period: int) -> DataFrame:
    """Evenly spaced positions over each key's extent."""
    return spark_positions.groupBy(key).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).select(key, F.explode(F.sequence("lo", "hi", F.lit(period).cast("long"))).alias("pos"))
