"""Exports, the append-only ledger and the stored vocabulary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.scalars import clip_prob
from tidemark.operators.checks import output_contract
from tidemark.operators.sequences import Vocabulary
from tidemark.sources.materialise import keep


def scores_wide(scores: DataFrame, order: DataFrame, codes: Sequence[str]) -> DataFrame:
    """One clipped column per code, with the ordinal of the supplied subject order."""
    wide = scores.groupBy("subject_id").pivot("code", list(codes)).agg(F.first(clip_prob("p")))
    return order.select("subject_id", "ordinal").join(wide, "subject_id", "left")


def write_scores_csv(scores: DataFrame, order: DataFrame, codes: Sequence[str], path: str,
                     meta: Mapping[str, str] | None = None) -> None:
    """Check the contract, then write ordered CSV parts and a JSON record beside them.

    Parts are range-sorted by ordinal, so reading them by name gives the supplied order.
    """
    wide = keep(scores_wide(scores, order, codes), "export")  # what is checked is what is written
    broken = [r.asDict() for r in output_contract(wide, order, codes).filter("n > 0").collect()]
    if broken:
        raise ValueError(f"export refused: {broken}")
    columns = ["subject_id", *[f"`{c}`" for c in codes]]
    wide.orderBy("ordinal").select(*columns).write.mode("overwrite").option("header", True).csv(f"{path}/scores")
    spark = scores.sparkSession
    record = {k: str(v) for k, v in (meta or {}).items()}
    info = spark.range(1).select(F.to_json(F.create_map(*[F.lit(x) for kv in {"n_codes": str(len(codes)), **record}.items() for x in kv])).alias("value"))
    info.write.mode("overwrite").text(f"{path}/meta")


def write_table_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def ledger_append(records: DataFrame, path: str, run: str, revision: str) -> None:
    """Append records as JSON lines, each with its run, time and code revision."""
    stamped = records.select(F.lit(run).alias("run"), F.current_timestamp().cast("string").alias("t"),
                             F.lit(revision).alias("revision"), "*")
    stamped.write.mode("append").json(path)


def ledger_scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines as ``value``; records have no common schema, so each is parsed as a map where it is used."""
    return spark.read.text(path)


def write_vocabulary(vocab: Vocabulary, path: str) -> None:
    for name in ("tokens", "edges", "reasons"):
        getattr(vocab, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary(*[spark.read.parquet(f"{path}/{name}") for name in ("tokens", "edges", "reasons")])
