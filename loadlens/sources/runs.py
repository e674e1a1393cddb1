"""Tables kept between runs: record tables and run folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


# A name that readers of all runs pass over.
POINTER = "_latest"


def create_kv_table(
    df: DataFrame, name: str, buckets: int, key: str = "key", path: str | None = None
) -> DataFrame:
    """Drop and create again a record table, bucketed and sorted by key.

    Later joins and groups on the key read the buckets without a shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_run(df: DataFrame, base: str, run_ts: str) -> None:
    """Write one run into its own folder below ``base``; other runs stay.

    Then a pointer names the run as the latest, if no later one is named already.
    """
    df.write.mode("overwrite").parquet(f"{base}/run_ts={run_ts}")
    named = latest_name(df.sparkSession, base)
    if named is None or run_ts >= named:
        pointer = df.sparkSession.createDataFrame([(run_ts,)], "value string").coalesce(1)
        pointer.write.mode("overwrite").text(f"{base}/{POINTER}")


def latest_name(spark: SparkSession, base: str) -> str | None:
    """The run that the pointer names; None without a pointer."""
    try:
        row = spark.read.text(f"{base}/{POINTER}").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else None


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the run that the pointer names; no other run is listed or read."""
    name = latest_name(spark, base)
    if name is None:
        raise ValueError(f"no run has been written below {base}")
    return spark.read.parquet(f"{base}/run_ts={name}").withColumn("run_ts", F.lit(name))


def read_runs(spark: SparkSession, base: str) -> DataFrame:
    """All runs below ``base``; ``run_ts`` is the folder of a row, kept as text."""
    found = spark.read.parquet(base).schema
    names = StructType(
        [StructField(f.name, StringType()) if f.name == "run_ts" else f for f in found]
    )
    return spark.read.schema(names).parquet(base)


def latest_run(df: DataFrame) -> DataFrame:
    """Rows of the newest run.

    On folders written by ``write_run`` the filter is on the partition column, so
    only the newest folder is read.
    """
    return df.where(F.col("run_ts") == df.select(F.max("run_ts")).scalar())
