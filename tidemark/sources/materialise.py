"""Stored intermediate tables, rebuilt only when inputs, configuration or code changed."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.config import config_tag
from tidemark.session import checkpoint_dir


@lru_cache(maxsize=1)
def _code_version() -> str:
    digest = hashlib.sha256()
    for source in sorted(Path(__file__).resolve().parents[1].rglob("*.py")):
        digest.update(source.read_bytes())
    return digest.hexdigest()


def fingerprint(spark: SparkSession, inputs: Sequence[str], *configs) -> str:
    """Changes with the set, size or time of the input files, any config field, or the code.

    Files are listed and hashed by Spark (content is not read) and arrive as one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    mark = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(mark.cast("decimal(20,0)")).alias("mix"),
                    F.bit_xor(mark).alias("fold")).first()
    parts = [str(row["n"]), str(row["mix"]), str(row["fold"]), config_tag(*configs), _code_version()]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to the folder has been committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _newest_complete(spark: SparkSession, path: str) -> str | None:
    """The latest committed copy below a fingerprint folder, if any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    copies = sorted((entry.getPath().getName() for entry in system.listStatus(folder)), reverse=True)
    return next((f"{path}/{c}" for c in copies if is_complete(spark, f"{path}/{c}")), None)


# Row groups of tables whose rows take MB each: a reader holds a whole group, and by default 128 MB or 100 rows make one.
LARGE_ROWS = {"parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1"}


def keep(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = f"{checkpoint_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(spark: SparkSession, name: str, build: Callable[[], DataFrame], inputs: Sequence[str],
                *configs, root: str | None = None, rebuild: bool = False, mark: str | None = None) -> DataFrame:
    """The table ``name``: read back when its fingerprint is stored completely, else built and written.

    Every write goes to a folder of its own, whose commit marker makes it visible. Two jobs that
    build the same table at once both succeed, nothing is renamed or overwritten, and the stored
    table is what later stages restart from when executors are lost. ``mark`` is the fingerprint,
    where the caller has it already.
    """
    root = root or f"{checkpoint_dir(spark)}/tidemark"
    path = f"{root}/{name}/{mark or fingerprint(spark, inputs, *configs)}"
    found = None if rebuild else _newest_complete(spark, path)
    if found is None:
        found = f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        build().write.option("compression", "zstd").parquet(found)
    return spark.read.parquet(found)
