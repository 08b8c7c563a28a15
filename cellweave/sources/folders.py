"""A folder that driver and executors share, for files that a query writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, else below the context's checkpoint folder; a local session gets one, a cluster without one raises."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file:///tmp/checkpoints/cellweave")
        named = context.getCheckpointDir()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop's settings give it, so that readers outside Hadoop find the same folder."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm).toString()
    return f"file://{found.removeprefix('file:')}" if found.startswith("file:/") and not found.startswith("file://") else found
