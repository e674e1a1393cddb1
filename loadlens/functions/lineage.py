"""Durable cut points: results kept in the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder.  On a cluster a
    machine-local folder would be lost with its machine, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(SETTING, None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loadlens-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Used where a plan would grow without end, or where a value that depends on
    the physical layout must stay the same if a lost executor's work is redone.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder, for one run of one job."""
    return f"{checkpoint_root(spark)}/loadlens/{name}-{uuid.uuid4().hex}"


SPLIT_SETTING, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", 16 << 20


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """While a job runs whose rows are many times its input: tasks read at most ``SPLIT_BYTES`` of files each.

    What a task holds before it writes a shuffle of many partitions follows from what it reads.
    """
    before = spark.conf.get(SPLIT_SETTING)
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", before.strip().lower()).groups()
    spark.conf.set(SPLIT_SETTING, str(min(int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit], SPLIT_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(SPLIT_SETTING, before)


def stored_rows(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut`` for a table of any size: written as Parquet, read back column by column."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
