"""What the operators of this subpackage share: shared folders, tables that cut lineage, Arrow helpers."""

from __future__ import annotations

import sys
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import fresh_folder, qualified

# Functions of this subpackage travel to the executors by value, so that an
# executor needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


#: Paths of the tables that :func:`saved` has written in the run at hand, one list for each nested :func:`dropping_tables`.
_runs: ContextVar[tuple[list[str], ...]] = ContextVar("runs", default=())


def giving_back(batches):
    """The ``batches`` of a task; before each, and at the end, what Arrow keeps of earlier ones goes back, since idle workers stay."""
    for b in batches:
        pa.default_memory_pool().release_unused()
        yield b
        del b
    pa.default_memory_pool().release_unused()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return qualified(spark, fresh_folder(spark, name))


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    for run in _runs.get()[-1:]:
        run.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing will read again."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(table, True)
    for run in _runs.get():
        if path in run:
            run.remove(path)


@contextmanager
def dropping_tables(spark: SparkSession, keep: list[str]):
    """Removes, at the end or when a step fails, the tables that were saved within but for those in ``keep``.

    Results that still read them must have been written by then.  The tables of other
    runs, in other threads or around this one, are not touched; those kept belong to the run around.
    """
    outer, own = _runs.get(), []
    token = _runs.set((*outer, own))
    try:
        yield
    finally:
        _runs.reset(token)
        for path in own:
            if path not in keep:
                drop_table(spark, path)
            elif outer:
                outer[-1].append(path)
