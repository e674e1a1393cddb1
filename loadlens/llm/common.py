"""Small helpers of the text operators."""

from __future__ import annotations

import hashlib
import re
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import loadlens
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loadlens.functions.lineage import scratch_folder

#: Words separated by space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: A hash map of words kept by one Python worker is emptied beyond this many entries.
CACHE_ENTRIES = 400_000

#: Texts that one numpy step takes together, in characters.
SLICE_CHARS = 1 << 20

_NORMAL = re.compile(r"[^\W_]+")


_shipped: set[str] = set()


def ship() -> SparkSession:
    """The active session, its Python workers able to import this package.

    Spark hands a zip of the package's sources to every executor, once per
    application, so that jobs also run where the package is not installed.
    """
    spark = SparkSession.active()
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        _shipped.add(application)
        package = Path(loadlens.__file__).parent
        archive = f"{tempfile.mkdtemp(prefix='loadlens-')}/loadlens.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files.

    The files survive a lost executor, and what is read from them later is the
    same rows each time, whatever order a shuffle delivered.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Hand texts to Python in batches of so many rows, for what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spare(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_sha256(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, separator: str) -> DataFrame:
    """SHA-256 in lower-case hex of each key's pieces, in order and joined: the keys and ``joined``.

    A digest has to be made in one pass, so the pieces of a key go to one task, which
    sorts them with spilling and reads them as a stream.
    """
    ship()
    width = len(keys)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, digest, fields = None, None, None

        def told() -> pa.RecordBatch:
            values = [pa.array([v], f.type) for v, f in zip(owner, fields)]
            return pa.RecordBatch.from_arrays([*values, pa.array([digest.hexdigest()])], [*keys, "joined"])

        for batch in batches:
            fields = list(batch.schema)[:width]
            for *key, part in zip(*(c.to_pylist() for c in batch.columns)):
                if key == owner:
                    digest.update(separator.encode())
                else:
                    if digest is not None:
                        yield told()
                    owner, digest = key, hashlib.sha256()
                digest.update(part.encode())
        if digest is not None:
            yield told()

    placed = rows.select(*keys, *order, piece).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([rows.schema[k] for k in keys] + [StructField("joined", StringType())])
    return placed.select(*keys, piece).mapInArrow(digests, schema)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text) % F.lit(parts)


def normal_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _NORMAL.findall(text.lower()) if text else []


def slices(texts: list, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of about ``most`` characters; a long text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Memo(dict):
    """Remembers ``make(key)``; emptied by ``trim`` when it has grown too large."""

    def __init__(self, make, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
