"""Stored files as a stream, and durable results of a streaming report."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructType

from loadlens.functions.lineage import scratch_folder

BATCH = "batch"
#: Micro-batches after which a result table is merged.
MERGE_EVERY = 16


def replay_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    file_format: str = "parquet",
    files_per_trigger: int | None = None,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """Files below ``path`` as a stream, with an optional rate per trigger.

    A folder gives all its files.  A path with a file ending (``events.parquet``) may be one
    file or a folder of that name: it is looked up by name in the folder above.
    """
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    above, _, name = path.rstrip("/").rpartition("/")
    if "." not in name or _is_folder(spark, path):
        return reader.load(path)
    # Characters that have a meaning in a name pattern stand for themselves.
    plain = re.sub(r"([\\*?\[\]{}])", r"\\\1", name)
    return reader.option("pathGlobFilter", plain).load(above)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder in the file system that Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def in_order(spark: SparkSession, folder: str) -> None:
    """Give the files of a folder rising times in the order they were written in, which is the order a stream reads them in.

    The tasks of one write end in any order; names have the number of the task.  Writes one after the other stay so.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    entries = [e for e in files.listStatus(place) if not e.getPath().getName().startswith(("_", "."))]
    # Names of one write share an id after the number: the oldest file of a write gives its place.
    writes: dict[str, list] = {}
    for entry in entries:
        number, _, write = entry.getPath().getName().removeprefix("part-").partition("-")
        writes.setdefault(write, []).append((int(number), entry))
    ordered = sorted(writes.values(), key=lambda w: min(e.getModificationTime() for _, e in w))
    listed = [e for write in ordered for _, e in sorted(write, key=lambda w: w[0])]
    first = min((e.getModificationTime() for e in entries), default=0) - 1000 * len(entries)
    for n, entry in enumerate(listed):
        files.setTimes(entry.getPath(), first + 1000 * n, -1)


def union_streams(*streams: DataFrame) -> DataFrame:
    """Several input streams as one."""
    return reduce(DataFrame.unionByName, streams)


def with_hook(
    stream: DataFrame,
    hook: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    interval: str | None = None,
) -> StreamingQuery:
    """Start a stream and call ``hook(rows, batch)`` for each micro-batch.

    Without ``interval`` everything available now is processed and the query
    ends; with it (``"1 second"``) the query goes on until it is stopped.
    """
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(hook)
        .start()
    )


def run_to_table(
    report: DataFrame, keys: Sequence[str], folder: str | None = None, mode: str = "update", merge_every: int = MERGE_EVERY
) -> DataFrame:
    """Run a streaming report over all that is available and return its last state.

    Each micro-batch writes only the groups that changed, into a folder of its own
    that a repeated batch replaces, so a failure neither loses nor doubles rows.
    The state of a group is its row of the highest batch.  Nothing passes through
    the driver.  After ``merge_every`` batches they are merged (``merge_batches``).
    """
    spark = report.sparkSession
    folder = folder or scratch_folder(spark, "stream")
    schema = report.schema

    def store(rows: DataFrame, batch: int) -> None:
        store_batch(rows, batch, folder, schema, newest(schema, keys), merge_every)

    with_hook(report, store, f"{folder}/progress", mode).awaitTermination()
    return last_state(spark, folder, schema, keys)


def last_state(
    spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str]
) -> DataFrame:
    """Newest row of each group that ``run_to_table`` has stored so far; no rows before the first batch."""
    return stored_state(spark, folder, schema, newest(schema, keys)).drop(BATCH)


Combine = Callable[[DataFrame], DataFrame]


def newest(schema: StructType, keys: Sequence[str]) -> Combine:
    """Of the rows of a group the one of the highest batch."""
    values = [c for c in schema.names if c not in keys] + [BATCH]

    def combine(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("newest"))
        return found.select(*keys, "newest.*")

    return combine


def added_up(schema: StructType, keys: Sequence[str]) -> Combine:
    """Sums of all other columns."""
    values = [F.sum(c).alias(c) for c in schema.names if c not in keys]

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*values, F.max(BATCH).alias(BATCH))

    return combine


def store_batch(rows: DataFrame, batch: int, folder: str, schema: StructType, combine: Combine, merge_every: int = MERGE_EVERY) -> None:
    """Store one micro-batch of a result table, and merge the batches when there are enough of them."""
    rows.write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}={batch}")
    if (batch + 1) % merge_every == 0:
        merge_batches(rows.sparkSession, folder, schema, combine, batch)


def merge_batches(spark: SparkSession, folder: str, schema: StructType, combine: Combine, upto: int) -> None:
    """Merge the base and all batches after it into a new base.

    A base counts once Spark has put its success marker, the last thing it writes, so
    a crash before leaves the old base and its batches in force, and a crash after it finds the new one.
    A batch that a base has is not read again, so a repeated batch is not counted twice.  The base before and its
    batches stay for readers that have begun on them; older ones are deleted, which bounds the files.
    """
    old = _bases(spark, folder)
    if old and old[-1] >= upto:
        return
    stored_state(spark, folder, schema, combine).write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    if old:
        _drop(spark, [f"{folder}/base/upto={n}" for n in old[:-1]])
        _drop(spark, [f"{folder}/rows/{BATCH}={n}" for n in _numbers(spark, f"{folder}/rows") if n <= old[-1]])


def stored_state(spark: SparkSession, folder: str, schema: StructType, combine: Combine) -> DataFrame:
    """The table: the newest base and the batches after it, combined."""
    fields = StructType(list(schema.fields)).add(BATCH, LongType())
    bases = _bases(spark, folder)
    upto = bases[-1] if bases else -1
    rows = spark.createDataFrame([], fields)
    if bases:
        rows = rows.unionByName(spark.read.schema(fields).parquet(f"{folder}/base/upto={upto}"))
    later = [f"{folder}/rows/{BATCH}={n}" for n in _numbers(spark, f"{folder}/rows") if n > upto]
    if later:
        rows = rows.unionByName(spark.read.option("basePath", f"{folder}/rows").schema(fields).parquet(*later))
    return combine(rows)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers in the names (``batch=3``) of the folders below ``folder``; a result table has few."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(place)]
    return sorted(int(n.split("=")[1]) for n in names if re.fullmatch(r"[a-z]+=\d+", n))


def _bases(spark: SparkSession, folder: str) -> list[int]:
    """Bases that are written to the end, oldest first."""
    found = _numbers(spark, f"{folder}/base")
    return [n for n in found if path_exists(spark, f"{folder}/base/upto={n}/_SUCCESS")]


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _drop(spark: SparkSession, folders: Sequence[str]) -> None:
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
