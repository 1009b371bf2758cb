"""Session settings the operators rely on."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A subject holding a large share of all events is split at the join even when the
    # aggregate behind it then needs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stored tables take 20 to 70 times their size on disk once they are rows; by the size on disk Spark would send
    # hundreds of MB through the driver as broadcasts.
    "spark.sql.sources.fileCompressionFactor": "64.0",
}
# Spark takes exploded rows to be as large as what they were exploded from, so what it may broadcast is kept well below
# what a driver can hold.
_BROADCAST = 1 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > _BROADCAST:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(_BROADCAST))
    return spark


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table whose size Spark knows, so that joins on it need not shuffle the other side.

    ``createDataFrame`` of a list gives a table of unknown size, which Spark takes to be larger than any other.
    """
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds), schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names.

    Only a session on this machine alone may do without one and gets a fresh folder; on a cluster
    each executor would write to its own disk, so there a missing name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, for the fits whose tasks run Python."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    # Spark's file server hands the archive to every executor, late ones included.
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / f"{package.name}_core.zip"
    archive.write_bytes(packed.getvalue())
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in _RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
