"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by digest. New data is
reduced to one row per digest before it is shuffled, compared with the index by a sort-merge
anti-join whose sides are already co-located, and what is new is appended. The index holds no
text, and no group of copies is ever gathered: a text that makes up a third of all rows is one
row per task when it reaches the shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import stored

# White space other than a single space; that one needs no replacement.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with every run of white space as one space; null is empty."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), _RUNS, " ")
    return docs.select("doc_id", F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A growing index of digests, each with the doc_id that was first kept for it."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        """(digest, keep_id), bucketed and sorted by digest."""
        if not self.spark.catalog.tableExists(self.name):
            return self.spark.createDataFrame([], "digest binary, keep_id long")
        return self.spark.table(self.name)

    def _append(self, new: DataFrame) -> None:
        (new.select("digest", F.col("keep_id").cast("long").alias("keep_id"))
         .write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Add the texts of ``docs`` and return one row per document with its decision.

        Columns: doc_id, keep_id, group_size (rows of ``docs`` with that text), kept, text_sha256.
        Of equal texts the smallest doc_id stays, unless an earlier ingest already kept one. A null
        text equals the empty one; a null doc_id never stays beside a number; of rows that repeat
        both doc_id and text exactly one is kept. Other columns of ``docs`` are not read.
        """
        batch = stored(self.spark, digests(docs).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")), "digests")
        groups = (batch.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("copies").alias("group_size"))
                  .repartition(self.buckets, "digest"))
        groups = stored(self.spark, groups, "groups")
        known = self.rows()
        spread = groups.repartition(self.buckets, "digest")
        new = spread.hint("merge").join(known, "digest", "left_anti")
        before = spread.hint("merge").join(known, "digest").select("digest", "keep_id", "group_size", F.lit(True).alias("seen"))
        fresh = new.select("digest", F.col("first_id").alias("keep_id"), "group_size", F.lit(False).alias("seen"))
        # Stored before the append, so that the decisions do not read the index they change.
        decided = stored(self.spark, before.unionByName(fresh), "decided")
        self._append(decided.filter(~F.col("seen")).repartition(self.buckets, "digest"))
        return (
            batch.join(decided, "digest")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id", "keep_id", "group_size",
                    (~F.col("seen") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"))
        )
