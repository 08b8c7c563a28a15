"""Rules over recognised cells (puzzle, row, col, number, confidence).

A puzzle is small, so windows and aggregates are keyed by puzzle; neighbours
are found by expanding each cell to its eight places and an equi-join, not by
a band join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums

KEY = ["puzzle", "row", "col"]


def to_origin(cells: DataFrame, origin: int = 0) -> DataFrame:
    """Columns counted from ``origin``, for cells that carry the origin they were counted from."""
    return cells.withColumn("col", F.col("col") - F.col("col_origin") + origin).withColumn("col_origin", F.lit(origin))


def with_overrides(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """``effective``: an override's value where there is one, even a null one."""
    o = overrides.select(*KEY, F.col("number").alias("_value"), F.lit(True).alias("_set"))
    return cells.join(o, KEY, "left").withColumn("overridden", F.coalesce("_set", F.lit(False))).withColumn("effective", F.when(F.col("overridden"), F.col("_value")).otherwise(F.col("number"))).drop("_value", "_set")


def unrecognised(cells: DataFrame) -> DataFrame:
    return cells.where("effective is null")


def low_confidence(cells: DataFrame, limit: float = 0.60) -> DataFrame:
    return cells.where(F.col("effective").isNotNull() & ~F.col("overridden") & (F.col("confidence") < limit))


def diagnostics(cells: DataFrame, highest: int = 26, limit: float = 0.60) -> DataFrame:
    """Per puzzle: total, recognised, valid and surely valid cells, true accuracy and coverage in percent."""
    low = (F.col("confidence") < limit) & F.col("number").isNotNull()
    valid = F.col("number").between(1, highest)
    return cells.groupBy("puzzle").agg(F.count(F.lit(1)).alias("total"), F.count("number").alias("recognised"), F.count_if(valid).alias("valid"), F.count_if(F.col("number").isNotNull() & ~valid).alias("invalid"), (F.count_if(valid) - F.count_if(low & valid)).alias("truly_valid")).withColumns({"true_accuracy": F.col("truly_valid") * 100 / F.col("total"), "coverage": F.col("recognised") * 100 / F.col("total")})


def neighbours(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """KEY, value: the known numbers of the eight neighbours of each cell of ``asked``, which is what gets expanded."""
    around = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    places = asked.select(*KEY, F.explode(around).alias("d")).select(*KEY, (F.col("row") + F.col("d.r")).alias("_row"), (F.col("col") + F.col("d.c")).alias("_col"))
    given = cells.where("number is not null").select("puzzle", F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("number").alias("value"))
    return places.join(given, ["puzzle", "_row", "_col"]).select(*KEY, "value")


def drop_outliers(cells: DataFrame, confidence: float = 0.30, least: int = 3, distance: float = 12) -> DataFrame:
    """Unsure cells far from the median of at least ``least`` neighbours lose number and confidence; all read the grid as it was."""
    unsure = cells.where((F.col("confidence") < confidence) & F.col("number").isNotNull()).select(*KEY)
    medians = neighbours(unsure, cells).groupBy(*KEY).agg(F.median("value").alias("_median"), F.count(F.lit(1)).alias("_n"))
    out = F.coalesce((F.col("_n") >= least) & (F.abs(F.col("number") - F.col("_median")) > distance), F.lit(False))
    return cells.join(medians, KEY, "left").withColumn("outlier", out).withColumn("number", F.when(~out, F.col("number"))).withColumn("confidence", F.when(out, F.lit(0.0)).otherwise(F.col("confidence"))).drop("_median", "_n")


def cap_frequencies(cells: DataFrame, share: float = 0.20, confidence: float = 0.60, total: Column | None = None) -> DataFrame:
    """Of a number in more than ``share`` of a puzzle's cells, the surplus with the least confidence is nulled, where below ``confidence``; its confidence becomes 0."""
    puzzle, value = Window.partitionBy("puzzle"), Window.partitionBy("puzzle", "number")
    total = F.count(F.lit(1)).over(puzzle) if total is None else total
    surplus = F.count(F.lit(1)).over(value) - F.floor(share * total)
    place = F.row_number().over(value.orderBy("confidence", "row", "col"))
    capped = F.col("number").isNotNull() & (place <= surplus) & (F.col("confidence") < confidence)
    marked = cells.withColumn("capped", F.coalesce(capped, F.lit(False)))
    return marked.withColumns({"number": F.when(~F.col("capped"), F.col("number")), "confidence": F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("confidence"))})


def frequency(cells: DataFrame) -> DataFrame:
    return cells.where("number is not null").groupBy("puzzle", "number").agg(F.count(F.lit(1)).alias("n"))


def symbol_index(cells: DataFrame) -> DataFrame:
    """Per puzzle and number its places in order, as an array of structs; bounded by the grid."""
    return cells.where("number is not null").groupBy("puzzle", "number").agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("places"))


def symbols_from_numbers(cells: DataFrame) -> DataFrame:
    """Unique symbols of a numeric grid, in numeric order."""
    return symbol_index(cells).select("puzzle", F.format_string("num_%03d", "number").alias("symbol_id"), "number", "places", F.size("places").alias("occurrences"))


def coverage(cells: DataFrame) -> DataFrame:
    return cells.groupBy("puzzle").agg(F.count("number").alias("recognized"), F.count(F.lit(1)).alias("total")).withColumn("coverage", F.col("recognized") / F.col("total"))


def choose_path(cells: DataFrame, limit: float = 0.70) -> DataFrame:
    """'numbers' where enough cells are recognised, else 'visual'."""
    return coverage(cells).withColumn("path", F.when(F.col("recognized") / F.greatest("total", F.lit(1)) >= limit, "numbers").otherwise("visual"))


def early_abort(cells: DataFrame, chunk: int = 16, least: int = 10, share: float = 0.25) -> DataFrame:
    """Per puzzle: cells read until the chunk that stops it, and whether it was stopped.

    Checked after every full chunk, and after the last; cells in order of ``ord`` (0, 1, ...).
    """
    sums = {"read": F.lit(1).cast("long"), "known": F.col("number").isNotNull().cast("long")}
    totals = cells.groupBy("puzzle").agg(F.count(F.lit(1)).alias("total"))
    running = running_sums(cells, "puzzle", ["ord"], sums).join(totals, "puzzle")
    stops = ((F.col("read") % chunk == 0) | (F.col("read") == F.col("total"))) & (F.col("read") >= least) & (F.col("known") / F.col("read") < share)
    return running.groupBy("puzzle").agg(F.max("total").alias("total"), F.min(F.when(stops, F.col("read"))).alias("stopped_at"), F.count("number").alias("recognized")).withColumns({"aborted": F.col("stopped_at").isNotNull()}).withColumn("recognized", F.when(F.col("aborted"), F.lit(0)).otherwise(F.col("recognized")))


def images_at(cells: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``image`` of each cell: of those at its place the first by ``ord``, null without one.  occurrences: KEY, ord, image."""
    first = occurrences.groupBy(*KEY).agg(F.min_by("image", "ord").alias("image"))
    return cells.join(first, KEY, "left")


def status_counts(images: DataFrame, key: str) -> DataFrame:
    """Per batch: images by status and the share that is done, in percent."""
    by = {s: F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "error")}
    return images.groupBy(key).agg(*by.values(), F.count(F.lit(1)).alias("total")).withColumn("percent", F.floor(F.col("done") * 100 / F.col("total") + 0.5).cast("int"))


def least_sure(cells: DataFrame, limit: float = 0.60) -> DataFrame:
    """Recognised cells below ``limit``, the least sure first."""
    return cells.where(F.col("number").isNotNull() & (F.col("confidence") < limit)).orderBy("confidence", *KEY)


def micro_batches(cells: DataFrame, size: int = 16) -> DataFrame:
    """``batch``: the cells of a puzzle in order, ``size`` at a time."""
    return cells.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("puzzle").orderBy("row", "col")) - 1) / size).cast("int"))


def append_chunks(chunks: list[DataFrame]) -> DataFrame:
    """The results of chunks one after the other, all rows."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def with_progress(cells: DataFrame, observation) -> DataFrame:
    """``cells``, whose rows and recognised rows ``observation`` (``pyspark.sql.Observation``) has when an action has run."""
    return cells.observe(observation, F.count(F.lit(1)).alias("processed"), F.count("number").alias("recognized"))


def combine_paths(chosen: DataFrame, numbers: DataFrame, visual: DataFrame) -> DataFrame:
    """Symbols of each puzzle by the path chosen for it: those of ``numbers`` or those of ``visual`` (same columns, puzzle among them)."""
    of = lambda path: chosen.where(F.col("path") == path).select("puzzle")
    return numbers.join(of("numbers"), "puzzle", "left_semi").unionByName(visual.join(of("visual"), "puzzle", "left_semi"))


def words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Letters of upper-cased words as cells: key, place, letter, and a repeatable random number of 1 to 28."""
    letters = texts.select(key, F.posexplode(F.split(F.upper(text), "")).alias("place", "letter")).where("letter <> ''")
    return letters.withColumn("number", (F.pmod(F.xxhash64(key, "place"), F.lit(28)) + 1).cast("int"))


def next_cells(cells: DataFrame) -> DataFrame:
    """The next and previous cell that can be edited, (row, col), along rows and along columns."""
    rows, cols = Window.partitionBy("puzzle").orderBy("row", "col"), Window.partitionBy("puzzle", "col").orderBy("row")
    place = F.when(F.col("editable"), F.struct("row", "col"))
    after = lambda w: F.first(place, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = lambda w: F.last(place, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumns({"next_across": after(rows), "previous_across": before(rows), "next_down": after(cols), "previous_down": before(cols)})


def progress(cells: DataFrame) -> DataFrame:
    """Filled cells in percent, of cells that are no clues."""
    return cells.where("editable").groupBy("puzzle").agg((F.coalesce(F.try_divide(F.count("number").cast("double"), F.count(F.lit(1))), F.lit(0.0)) * 100).alias("progress"))


def update_cells(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Point updates from a log (KEY, at, number): the last one of a cell wins."""
    last = log.groupBy(*KEY).agg(F.max_by("number", "at").alias("_number"), F.lit(True).alias("_set"))
    return cells.join(last, KEY, "left").withColumn("number", F.when(F.col("_set"), F.col("_number")).otherwise(F.col("number"))).drop("_number", "_set")


def upsert(saved: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``saved`` with those of ``changes`` in place of the ones with their key."""
    return saved.join(changes, key, "left_anti").unionByName(changes)


def bounding_box(cells: DataFrame) -> DataFrame:
    return cells.groupBy("puzzle").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))


def word_scores(cells: DataFrame) -> DataFrame:
    """A row is a word: right letters, and whether all are; per puzzle the totals."""
    words = cells.groupBy("puzzle", "row").agg(F.count_if(F.col("number") == F.col("expected")).alias("right"), F.count(F.lit(1)).alias("letters"))
    return words.groupBy("puzzle").agg(F.sum("right").alias("right"), F.sum("letters").alias("letters"), F.count_if(F.col("right") == F.col("letters")).alias("words_done"))
