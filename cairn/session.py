"""Shared-folder helpers: cutting lineage and writing intermediate tables."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; the session names it in ``spark.checkpoint.dir``.

    Without it, the context's checkpoint folder or else a folder in the session's
    warehouse.  A warehouse on a local disk is refused unless the master is local:
    executors elsewhere would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    scheme = warehouse.partition(":")[0] if ":" in warehouse else "file"
    master = spark.sparkContext.master
    if scheme == "file" and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{warehouse.rstrip('/')}/cairn-steps"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder.

    Results may still read from there, so it is for the user to clear
    ``<shared folder>/<application id>`` once the job is over.
    """
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now, as a table in the shared folder, and go on from that table.

    A lost executor costs at most the step at hand.  A table read back also
    tells Spark its true size, which decides later joins, and carries nothing of
    the plan that made it.
    """
    path = new_path(df.sparkSession, "step")
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step.__dict__["_cairn_step"] = path
    return step


def forget(*steps: DataFrame | None) -> None:
    """Remove the tables behind steps made by `cut` that nothing will read again.

    Loops call it for the step before the last, once the last is written, so that an
    iteration leaves one copy of its state and not one per round.
    """
    for step in steps:
        path = None if step is None else step.__dict__.pop("_cairn_step", None)
        if path:
            jvm, conf = step.sparkSession._jvm, step.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within it, workers get ``rows`` rows at a time, for jobs run there that hold long rows in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
