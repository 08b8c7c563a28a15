"""Progress of jobs as data: counts of each stage while it is written, and of each micro-batch of a stream."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.folders import fresh_folder

#: The stages of a run, and the progress in percent at which each starts and ends.
STAGE_PROGRESS = {"preprocessing": (10, 25), "gridDetection": (25, 45), "cellExtraction": (45, 70), "classification": (70, 85), "clueOCR": (85, 100)}
EVENT = "stage string, progress int, rows map<string, long>"


class StageFailed(RuntimeError):
    """A stage's error, with its name."""

    def __init__(self, stage: str, cause: Exception):
        super().__init__(f'Pipeline failed at stage "{stage}": {cause}')
        self.stage = stage


def run_stages(rows: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], counts: dict[str, Column], on_progress: Callable[[str, int, dict[str, int]], None], progress: dict[str, tuple[int, int]] = STAGE_PROGRESS) -> DataFrame:
    """Applies the stages in turn, each written as a table that the next reads, and reports (stage, percent, counts) as it starts and ends.

    The counts are aggregates that Spark takes while it writes the stage's table, so they cost no pass of their own.
    """
    spark = rows.sparkSession
    for name, stage in stages.items():
        start, end = progress[name]
        on_progress(name, start, {})
        observation, path = Observation(name), fresh_folder(spark, f"stage-{name}")
        try:
            result = stage(rows)
            result.observe(observation, *[c.alias(n) for n, c in counts.items()]).write.parquet(path)
        except Exception as e:
            raise StageFailed(name, e) from e
        on_progress(name, end, dict(observation.get))
        rows = spark.read.schema(result.schema).parquet(path)
    return rows


class BatchEvents(StreamingQueryListener):
    """What each micro-batch of one query observed, as (batch, rows read, counts); :meth:`wait` returns when the query has ended."""

    def __init__(self, query: str, observation: str):
        self.query, self.observation, self.events, self.error = query, observation, [], None
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.query and self.observation in p.observedMetrics:
            self.events.append((p.batchId, p.numInputRows, p.observedMetrics[self.observation].asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception
        self._ended.set()

    def wait(self, seconds: float = 60) -> list[tuple[int, int, dict]]:
        if not self._ended.wait(seconds):
            raise TimeoutError(f"no end of the stream {self.query} was reported")
        return sorted(self.events, key=lambda e: e[0])


def stream_events(rows: DataFrame, counts: dict[str, Column], name: str, files: int = 6, files_a_batch: int = 2) -> tuple[DataFrame, list[tuple[int, int, dict]]]:
    """``rows`` as a stream of files, a few a micro-batch, to a table: (the table, what each micro-batch reported)."""
    spark: SparkSession = rows.sparkSession
    source, sink, log = (fresh_folder(spark, f"{name}-{n}") for n in ("in", "out", "log"))
    rows.repartition(files).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    listener = BatchEvents(name, "rows")
    spark.streams.addListener(listener)
    try:
        observed = stream.observe("rows", *[c.alias(n) for n, c in counts.items()])
        query = observed.writeStream.queryName(name).format("parquet").option("path", sink).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
        events = listener.wait()
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(rows.schema).parquet(sink), events
