"""Readers for event tables, subjects, splits, targets, supplied anchors and text answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.config import TableSpec
from tidemark.functions import scalars as S
from tidemark.functions.time import to_ts
from tidemark.operators.distributed import range_rank
from tidemark.session import small_table

# The only subject columns that may be used, and those that must never be.
ALLOWED_SUBJECT_COLUMNS = ("Id", "BIRTHDATE", "MARITAL", "RACE", "ETHNICITY", "GENDER")
FORBIDDEN_SUBJECT_COLUMNS = (
    "DEATHDATE", "HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE", "SSN", "DRIVERS", "PASSPORT",
    "PREFIX", "FIRST", "LAST", "SUFFIX", "MAIDEN", "BIRTHPLACE", "ADDRESS", "CITY", "STATE",
    "COUNTY", "ZIP", "LAT", "LON",
)

# The ten declared event tables.
EVENT_TABLES = {
    spec.name: spec
    for spec in (
        TableSpec("encounters", "ENC", "START", "CODE", stop="STOP", reason="REASONCODE",
                  costs=("TOTAL_CLAIM_COST",)),
        TableSpec("conditions", "COND", "START", "CODE"),
        TableSpec("medications", "MED", "START", "CODE", reason="REASONCODE", costs=("BASE_COST",)),
        TableSpec("procedures", "PROC", "DATE", "CODE", reason="REASONCODE", costs=("BASE_COST",)),
        TableSpec("observations", "OBS", "DATE", "CODE", value="VALUE", value_type="TYPE"),
        TableSpec("immunizations", "IMM", "DATE", "CODE", costs=("BASE_COST",)),
        TableSpec("careplans", "CP", "START", "CODE", reason="REASONCODE"),
        TableSpec("allergies", "ALG", "START", "CODE"),
        TableSpec("devices", "DEV", "START", "CODE"),
        TableSpec("imaging_studies", "IMG", "DATE", "MODALITY_CODE"),
    )
}
KIND_ORDER = ("ENC", "COND", "PROC", "MED", "OBS", "IMM", "CP", "ALG", "DEV", "IMG")
DATE_ONLY_KINDS = ("COND", "CP", "ALG")


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV or Parquet, every wanted column as text, nothing inferred and nothing else read."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select(*[F.col(c).cast("string").alias(c) for c in columns])
    header = spark.read.option("header", True).csv(path)
    missing = [c for c in columns if c not in header.columns]
    if missing:
        raise ValueError(f"{path}: columns missing: {missing}")
    # The header read gives the file's own column order; all columns stay text.
    return (spark.read.option("header", True).option("enforceSchema", False)
            .schema(text_schema(header.columns)).csv(path).select(*columns))


def _stamp(df: DataFrame, column: str):
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    return to_ts(F.col(column)) if is_text else F.col(column).cast("timestamp_ntz")


def _reason(spec: TableSpec):
    """Numeric reason codes are normalised; reasons declared as plain text are taken as they are."""
    if spec.reason is None:
        return F.lit(None).cast("string")
    return S.normalise_reason(spec.reason) if spec.reason_is_code else F.col(spec.reason).cast("string")


def scan_event_table(raw: DataFrame, spec: TableSpec, kind_column: str | None = None) -> DataFrame:
    """One raw table in the common event layout; ``kind_column`` names the kind where a table holds several."""
    raw = raw.select(*dict.fromkeys([*spec.columns(), *([kind_column] if kind_column else [])]))
    kind = F.col(kind_column) if kind_column else F.lit(spec.kind)
    numeric = F.col(spec.value_type) == "numeric" if spec.value_type else F.lit(False)
    null = F.lit(None)
    return raw.select(
        F.col(spec.subject).alias("subject_id"),
        _stamp(raw, spec.time).alias("ts"),
        (_stamp(raw, spec.stop) if spec.stop else null.cast("timestamp_ntz")).alias("stop"),
        kind.alias("kind"),
        F.col(spec.code).cast("string").alias("code"),
        S.event_token(kind, spec.code).alias("token"),
        (S.numeric_value(spec.value, spec.value_type) if spec.value else null.cast("double")).alias("value"),
        F.coalesce(numeric, F.lit(False)).alias("is_numeric"),
        _reason(spec).alias("reason"),
        S.first_cost(*spec.costs).alias("cost"),
    )


def scan_subjects(raw: DataFrame, allowed: Sequence[str] = ALLOWED_SUBJECT_COLUMNS,
                  forbidden: Sequence[str] = FORBIDDEN_SUBJECT_COLUMNS) -> DataFrame:
    """The allow-listed subject columns as text; a list that lets a forbidden one through is refused."""
    leaked = sorted(set(allowed) & set(forbidden))
    if leaked:
        raise ValueError(f"forbidden subject columns are allowed: {leaked}")
    missing = [c for c in allowed if c not in raw.columns]
    if missing:
        raise ValueError(f"subject columns missing: {missing}")
    return raw.select(*[F.col(c).cast("string").alias(c) for c in allowed])


def scan_splits(raw: DataFrame, expected: dict[str, int] | None = None,
                subject: str = "Id", split: str = "split") -> DataFrame:
    """Subject to split; sizes are checked when given, by a join of the counts (an action)."""
    out = raw.select(F.col(subject).alias("subject_id"), F.col(split).alias("split"))
    if expected is not None:
        wrong = split_differences(out, expected).orderBy("split").take(5)
        if wrong:
            raise ValueError(f"split sizes differ: {[tuple(r) for r in wrong]}")
    return out


def split_differences(splits: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(split, n, expected) of every split whose size is not the expected one."""
    wanted = splits.sparkSession.createDataFrame(list(expected.items()), "split string, expected bigint")
    sizes = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    both = sizes.join(wanted, sizes["split"].eqNullSafe(wanted["split"]), "full").select(
        F.coalesce(sizes["split"], wanted["split"]).alias("split"), "n", "expected")
    return both.filter(~F.col("n").eqNullSafe(F.col("expected")))


def scan_targets(spark: SparkSession, codes: Sequence[str], descriptions: Sequence[str] | None = None) -> DataFrame:
    """The declared target codes, unique, in order."""
    codes = [str(c) for c in codes]
    if len(set(codes)) != len(codes):
        raise ValueError("target codes repeat")
    if not codes:
        raise ValueError("no target codes")
    texts = list(descriptions) if descriptions else [None] * len(codes)
    rows = [(i, c, t) for i, (c, t) in enumerate(zip(codes, texts, strict=True))]
    return small_table(spark, rows, "position bigint, code string, description string")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets from a CSV file or a folder of them (CODE, DESCRIPTION), codes as text in file order; they stay a table.

    ``position`` (long) counts the rows of the files by name. A row's place is its file, the start of its block and its order
    in that block; ranges of places are counted one by one, so files of any size and number are numbered without one sort of all.
    """
    rows = read_text_table(spark, path, ["CODE", "DESCRIPTION"]).select(
        "CODE", "DESCRIPTION", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))
    out = range_rank(rows, [], ["_file", "_block", "_at"], "position").select(
        "position", F.col("CODE").alias("code"), F.col("DESCRIPTION").alias("description"))
    if not out.take(1):
        raise ValueError("no target codes")
    if out.groupBy("code").count().filter("count > 1").take(1):
        raise ValueError("target codes repeat")
    return out


def scan_anchors(raw: DataFrame, subject: str = "Id", anchor: str = "anchor_date") -> DataFrame:
    return raw.select(F.col(subject).alias("subject_id"), _stamp(raw, anchor).alias("given_anchor"))


def scan_text_answers(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Trimmed answers of rows that are not numeric, one per (subject, ts, token).

    Of several answers at one instant the lowest by text is kept.
    """
    raw = raw.select(*spec.columns())
    rows = raw.filter(F.col(spec.value_type).isNull() | (F.col(spec.value_type) != "numeric"))
    rows = rows.filter(F.col(spec.value).isNotNull()).select(
        F.col(spec.subject).alias("subject_id"),
        _stamp(raw, spec.time).alias("ts"),
        S.event_token(F.lit(spec.kind), spec.code).alias("token"),
        F.trim(F.col(spec.value).cast("string")).alias("answer"),
    )
    return rows.groupBy("subject_id", "ts", "token").agg(F.min("answer").alias("answer"))
