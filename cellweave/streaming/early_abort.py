"""The stop rule on a stream of recognised cells, which may come in any order.

A puzzle is judged after each full chunk of cells, in the order of its chunks.
The cells of a chunk may be spread over micro-batches and may come before those
of earlier chunks: state holds, for each chunk that is not judged yet, how many of its cells
are there and how many are recognised, and three numbers for the chunks that are.  A
puzzle that falls below the share is reported at once and its later cells are
ignored.  A timer, moved on by each new cell, tells when no more will come: the last
chunk, which need not be full, is judged then, the puzzle reported, and its
state removed.

State is kept for groups of puzzles, dealt by a hash, since each call for state goes from Python to the JVM and back: a group with
new cells is read and written once a micro-batch, ``TOGETHER`` puzzles an entry, and has one timer, for the
puzzle that is due first.  With a puzzle lie the ``SPAN`` chunks around the one to be judged next; chunks further on, which
only long puzzles have, are kept ``SPAN`` at a time in a map and fetched when their turn comes, so no entry grows with a puzzle's length.
A group grows with the number of puzzles that are not over; ``groups`` is for the caller to set.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.folders import fresh_folder

#: What state in a RocksDB store needs, which :class:`StopRule` uses.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RESULT = "puzzle long, stopped_at long, recognized long, aborted boolean"
#: Chunks of a puzzle whose counts are read and written together, and puzzles of an entry.
SPAN, TOGETHER = 64, 256
_result = Row("puzzle", "stopped_at", "recognized", "aborted")


def _added(counts: list[int], more: dict[int, list[int]]) -> list[int]:
    """``counts`` (read, known, read, known, and so on by chunk of a span) with ``more`` (chunk of the span: [read, known])."""
    counts = counts + [0] * (2 * max(more, default=-1) + 2 - len(counts))
    for i, (read, known) in more.items():
        counts[2 * i] += read
        counts[2 * i + 1] += known
    return counts


class StopRule(StatefulProcessor):
    """Cells (group, puzzle, place of the chunk from 0, recognised, ms, at) to (puzzle, stopped_at, recognized, aborted), one row a puzzle."""

    def __init__(self, chunk: int, least: int, share: float, idle_ms: int):
        self.chunk, self.least, self.share, self.idle_ms = chunk, least, share, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # due: when the puzzle is over; last: the furthest span that the map has had; counts: of the span of the chunk to be judged next
        puzzle = "puzzle long, chunks long, read long, known long, stopped boolean, due long, last long, counts array<long>"
        self.judged = handle.getListState("judged", f"puzzles array<struct<{puzzle}>>")
        self.ahead = handle.getMapState("ahead", "puzzle long, span long", "counts array<long>")
        self.timer = handle.getValueState("timer", "at long")

    def _judge(self, puzzle, chunks: int, read: int, known: int, last: int, counts: list[int], end: bool) -> tuple[int, int, int, list[int], bool]:
        """Judges the chunks that are whole, or, at the end, all there are."""
        while 2 * (chunks % SPAN) < len(counts):
            more, hits = counts[2 * (chunks % SPAN) : 2 * (chunks % SPAN) + 2]
            if not more or more < self.chunk and not end:
                break
            chunks, read, known = chunks + 1, read + more, known + hits
            if read >= self.least and known / read < self.share:
                return chunks, read, known, counts, True
            if chunks % SPAN == 0:
                counts = self._held_ahead(puzzle, chunks // SPAN, last)
                if counts:
                    self.ahead.removeKey((puzzle, chunks // SPAN))
        return chunks, read, known, counts, False

    def _held_ahead(self, puzzle, span: int, last: int) -> list[int]:
        return list(self.ahead.getValue((puzzle, span))[0]) if span <= last and self.ahead.containsKey((puzzle, span)) else []

    def _forget_ahead(self, puzzle, chunks: int, last: int) -> None:
        for span in range(chunks // SPAN, last + 1) if last else ():
            if self.ahead.containsKey((puzzle, span)):
                self.ahead.removeKey((puzzle, span))

    def _with_cells(self, puzzle, cells: tuple[int, dict[int, list[int]]], state: tuple) -> tuple:
        """The puzzle's state with new cells: (when the newest came, {place of the chunk: [read, known]})."""
        chunks, read, known, stopped, due, last, counts = state
        newest, places = cells
        if not stopped:
            spans: dict[int, dict[int, list[int]]] = {}
            for place, more in places.items():
                spans.setdefault(place // SPAN, {})[place % SPAN] = more
            counts = _added(list(counts), spans.pop(chunks // SPAN, {}))
            for span, more in spans.items():
                self.ahead.updateValue((puzzle, span), (_added(self._held_ahead(puzzle, span, last), more),))
            last = max([last, *spans])
            chunks, read, known, counts, stopped = self._judge(puzzle, chunks, read, known, last, counts, end=False)
            if stopped:
                self._forget_ahead(puzzle, chunks, last)
                counts, last = [], 0
        return chunks, read, known, stopped, max(due, newest + self.idle_ms), last, counts

    def _keep(self, puzzles: list[tuple], timer: int | None) -> None:
        """Writes the group's puzzles and moves its timer, which was at ``timer`` if it had one."""
        if not puzzles:
            self.judged.clear()
            self.timer.clear()
            return
        self.judged.put([(puzzles[low : low + TOGETHER],) for low in range(0, len(puzzles), TOGETHER)])
        first = min(p[5] for p in puzzles)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int | None, tuple[int, dict[int, list[int]]]] = {}
        for _, puzzle, place, recognised, ms, _ in rows:
            newest, places = new.get(puzzle, (0, {}))
            held = places.setdefault(place, [0, 0])
            held[0] += 1
            held[1] += bool(recognised)
            new[puzzle] = max(newest, ms), places
        puzzles = {p[0]: tuple(p)[1:] for entry in self.judged.get() for p in entry[0]}
        timer = self.timer.get() if puzzles else None
        for puzzle, cells in new.items():
            before = puzzles.get(puzzle, (0, 0, 0, False, 0, 0, []))
            puzzles[puzzle] = after = self._with_cells(puzzle, cells, before)
            if after[3] and not before[3]:
                yield _result(puzzle, after[1], 0, True)
        self._keep([(k, *v) for k, v in puzzles.items()], timer and timer[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, left = expiredTimerInfo.getExpiryTimeInMs(), []
        for entry in self.judged.get():
            for puzzle, chunks, read, known, stopped, due, last, counts in entry[0]:
                if due > now:
                    left.append((puzzle, chunks, read, known, stopped, due, last, counts))
                elif not stopped:
                    chunks, read, known, _, below = self._judge(puzzle, chunks, read, known, last, list(counts), end=True)
                    self._forget_ahead(puzzle, chunks, last)
                    yield _result(puzzle, read, 0, True) if below else _result(puzzle, None, known, False)
        self._keep(left, None)  # the timer that ran out goes by itself

    def close(self) -> None:
        pass


def early_abort_stream(cells: DataFrame, chunk: int = 16, least: int = 10, share: float = 0.25, idle_minutes: int = 30, groups: int = 1024) -> DataFrame:
    """cells: puzzle, nth (from 1, in the puzzle's order), recognised (boolean), at (when it came, with a watermark).  The session needs :data:`STATE_STORE`."""
    rule = StopRule(chunk, least, share, idle_minutes * 60_000)
    group = F.pmod(F.xxhash64("puzzle"), F.lit(groups)).alias("group")
    places = cells.select(group, "puzzle", F.floor((F.col("nth") - 1) / chunk).alias("place"), "recognised", F.unix_millis("at").alias("ms"), "at")
    return places.groupBy("group").transformWithState(statefulProcessor=rule, outputStructType=RESULT, outputMode="append", timeMode="eventtime")


def replayed(cells: DataFrame, files: int = 6, files_a_batch: int = 2, **rule) -> DataFrame:
    """The stop rule over ``cells`` (puzzle, nth, recognised) as a stream: files arrive out of order, a few a micro-batch; the results go to files, and are read back.

    A last row, of no puzzle, comes so late that all timers run out.
    """
    spark: SparkSession = cells.sparkSession
    source, sink, log = (fresh_folder(spark, f"stream-{n}") for n in ("in", "out", "log"))
    idle = rule.pop("idle_minutes", 30)
    # a cell's file is drawn by a hash, so a puzzle's cells, and a chunk's, are spread over files and micro-batches
    dealt = cells.withColumn("file", F.pmod(F.xxhash64("puzzle", "nth"), F.lit(files)).cast("int"))
    begun = F.timestamp_seconds(F.lit(86_400))
    arrivals = dealt.select("puzzle", F.col("nth").cast("long").alias("nth"), "recognised", begun.alias("at"), "file")
    arrivals.repartition(files, "file").write.partitionBy("file").parquet(source)
    end = spark.range(1).select(F.lit(None).cast("long").alias("puzzle"), F.lit(1).cast("long").alias("nth"), F.lit(True).alias("recognised"), (begun + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(2 * idle))).alias("at"), F.lit(files).alias("file"))
    end.coalesce(1).write.mode("append").partitionBy("file").parquet(source)
    held = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        schema = "puzzle long, nth long, recognised boolean, at timestamp, file int"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source).withWatermark("at", "1 minute")  # cells that come as late as the mark itself would be left out
        result = early_abort_stream(stream, idle_minutes=idle, **rule)
        query = result.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(RESULT).parquet(sink).where("puzzle IS NOT NULL")
