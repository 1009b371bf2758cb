"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import checkpoint_dir

# Lower-cases A-Z and leaves every other byte, so UTF-8 stays valid.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Bytes of text that array code works on at once; bounds the memory of a task, not what is read.
CHUNK_BYTES = 1 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, as their Python workers import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    # Spark's file server hands the archive to every executor, late ones included.
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / f"{package.name}.zip"
    archive.write_bytes(packed.getvalue())
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def batch_bytes(spark: SparkSession, most: int):
    """Rows that are written inside go to Python in batches of about ``most`` bytes: ten thousand whole texts may take hundreds of MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark)}/tidemark-llm/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages restart from the files."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are done.

    It does so when the driver collects its garbage, which a driver with a large heap may put off until the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shelf:
    """Stored tables of one job by name, emptied when nothing reads them any more; a new table takes the place of the old."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self._drop(name)
        self.held[name] = path, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        """Drop the files of tables, and of the shuffles that made them; no plan that is still to run may read them."""
        self._drop(*names)
        release_shuffles(self.spark)

    def _drop(self, *names: str) -> None:
        for name in names:
            if name in self.held:
                path, schema = self.held.pop(name)
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


SAMPLE_RANGE = 1 << 30


def sample_share(wanted, total) -> Column:
    """The part of ``SAMPLE_RANGE`` in which about four times the wanted rows fall; all of it for small tables."""
    return F.least(F.lit(SAMPLE_RANGE), F.ceil(F.lit(4.0 * SAMPLE_RANGE * wanted) / F.greatest(total, F.lit(1)))).cast("long")


def hashed_sample(df: DataFrame, names: list[str], wanted: int, total: int) -> DataFrame:
    """At most ``wanted`` rows of ``df``, by the hash of columns ``names``, to fit something on.

    ``total`` is the number of rows or an upper bound. A first cut by the expected share keeps what tasks
    offer independent of their number; the rows with the smallest hash are then taken.
    """
    place = F.pmod(F.xxhash64(*names), F.lit(SAMPLE_RANGE))
    return df.withColumn("_place", place).filter(F.col("_place") < sample_share(wanted, F.lit(total))).orderBy("_place", *names).limit(wanted).drop("_place")


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    return [x if x is not None else b"" for x in column.cast("binary").to_pylist()]


def by_size(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most ``limit`` bytes in all, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_BLOCK = 4096


def vector_blocks(vector: np.ndarray) -> pa.RecordBatch:
    """A task's partial vector as rows (block, part), for ``vector_sum``."""
    flat = vector.ravel()
    cuts = range(0, len(flat), _BLOCK)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(cuts)), pa.int32()), pa.array([flat[a:a + _BLOCK].tobytes() for a in cuts], pa.binary())], ["block", "part"])


def vector_sum(parts: DataFrame, size: int, dtype) -> np.ndarray:
    """The sum of all partial vectors of a fixed ``size``; executors add them block by block as they stream in."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(part, dtype)
                sums[block] = sums[block] + v if block in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         ["block", "part"])

    total = np.zeros(size, dtype)
    for row in parts.repartition("block").mapInArrow(run, "block int, part binary").collect():
        v = np.frombuffer(row["part"], dtype)
        total[row["block"] * _BLOCK:row["block"] * _BLOCK + len(v)] = v
    return total
