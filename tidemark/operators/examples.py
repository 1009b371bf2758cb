"""(subject, cutoff) examples: real ones at the anchor, rolling ones before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.config import ExampleConfig
from tidemark.functions.time import midnight, span_of
from tidemark.operators.distributed import beside, hash_rank
from tidemark.operators.segments import boundaries, place_cutoffs


def real_examples(cohort: DataFrame, cfg: ExampleConfig) -> DataFrame:
    return cohort.select(
        "subject_id", F.col("anchor").alias("cutoff"),
        (F.col("anchor") + span_of(cfg.window)).alias("window_end"),
        "split", F.lit(True).alias("is_real"), F.lit(0).alias("k"),
    )


def rolling_cutoffs(cohort: DataFrame, events: DataFrame, cfg: ExampleConfig) -> DataFrame:
    """Candidate cutoffs ``anchor - k * stride`` for k = 1, 2, ... down to the first event.

    A cutoff at or before the first event has no history, so none is lost by stopping there.
    """
    first = events.groupBy("subject_id").agg(F.min("ts").alias("_first"))
    base = cohort.select("subject_id", "anchor", "split").join(first, "subject_id")
    if cfg.stride.unit == "year":
        steps = F.floor(F.months_between("anchor", "_first") / F.lit(12.0 * cfg.stride.n)) + 1
    else:
        steps = F.floor(F.datediff("anchor", "_first") / F.lit(float(cfg.stride.n))) + 1
    ks = base.filter(steps >= 1).withColumn("k", F.explode(F.sequence(F.lit(1), steps.cast("int"))))
    cutoff = midnight(F.col("anchor") - span_of(cfg.stride, F.col("k")))
    return (ks.withColumn("cutoff", cutoff).filter(F.col("_first") < F.col("cutoff"))
            .select("subject_id", "cutoff", "split", "k"))


def history_counts(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Events strictly before each candidate cutoff with any, from one count per (subject, stretch)."""
    placed = (events.select("subject_id", "ts").join(boundaries(candidates), "subject_id")
              .filter(F.col("ts") < F.element_at("_bounds", -1))
              .withColumn("seg", F.size(F.filter("_bounds", lambda b: b <= F.col("ts")))))
    cells = placed.groupBy("subject_id", "seg").agg(F.count(F.lit(1)).alias("n"))
    # Cutoffs and stretches share one order, so a running sum serves all cutoffs of a subject in one sweep.
    cutoffs = place_cutoffs(candidates).select("subject_id", F.col("hi").alias("seg"), F.lit(0).cast("bigint").alias("n"),
                                               F.lit(0).alias("_cell"), "cutoff", "split", "k")
    both = cells.withColumn("_cell", F.lit(1)).unionByName(cutoffs, allowMissingColumns=True)
    sweep = W.partitionBy("subject_id").orderBy("seg", "_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = both.withColumn("n_before", F.sum("n").over(sweep))
    return counted.filter("_cell = 0 and n_before > 0").select("subject_id", "cutoff", "split", "k", "n_before")


def build_examples(cohort: DataFrame, events: DataFrame, cfg: ExampleConfig) -> DataFrame:
    """Real examples of every subject plus, for the chosen splits, rolling ones with enough history."""
    real = real_examples(cohort, cfg)
    if not cfg.augment_splits:
        return real
    chosen = cohort.filter(F.col("split").isin(*cfg.augment_splits))
    kept = history_counts(rolling_cutoffs(chosen, events, cfg), events).filter(F.col("n_before") >= cfg.min_events)
    if cfg.max_extra is not None:
        kept = kept.filter(F.col("k") <= cfg.max_extra)
    extra = kept.select("subject_id", "cutoff", (F.col("cutoff") + span_of(cfg.window)).alias("window_end"),
                        "split", F.lit(False).alias("is_real"), "k")
    return real.unionByName(extra)


def example_key(examples: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``eid``: 0, 1, 2, ... over all examples, real ones first.

    Inside a block the order is the md5 permutation of (subject, cutoff), so no block is sorted by one task.
    """
    named = examples.withColumn("_key", F.concat_ws("|", "subject_id", F.col("cutoff").cast("string")))
    ranked = hash_rank(named, "_key", seed, ["is_real"], "_rank")
    real = ranked.agg(F.coalesce(F.max(F.when(F.col("is_real"), F.col("_rank_n"))), F.lit(0)).alias("_real"))
    eid = F.col("_rank") + F.when(F.col("is_real"), F.lit(0)).otherwise(F.col("_real"))
    return beside(ranked, real).withColumn("eid", eid.cast("bigint")).drop("_key", "_rank", "_rank_n", "_real")


def example_invariants(examples: DataFrame, cohort: DataFrame, cfg: ExampleConfig) -> DataFrame:
    """Violation counts; ``n_synthetic`` shows the check is not empty."""
    joined = examples.join(cohort.select("subject_id", "anchor"), "subject_id")
    by_row = joined.agg(
        F.count_if(F.col("is_real") & (F.col("cutoff") != F.col("anchor"))).alias("real_off_anchor"),
        F.count_if(~F.col("is_real") & (F.col("cutoff") >= F.col("anchor"))).alias("synthetic_not_earlier"),
        F.count_if(~F.col("is_real")).alias("n_synthetic"),
    )
    fixed = examples.filter(~F.col("split").isin(*cfg.augment_splits)) if cfg.augment_splits else examples
    repeats = fixed.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_n"))
    by_subject = repeats.agg(F.count_if(F.col("_n") > 1).alias("repeated_outside_augmented"))
    return beside(by_row, by_subject)


def anchor_relabel(examples: DataFrame, labels: DataFrame) -> DataFrame:
    """Rolling rows take label and at-risk flag of their subject's real row; real rows keep theirs."""
    keyed = labels.join(examples.select("subject_id", "cutoff", "is_real"), ["subject_id", "cutoff"])
    parent = (keyed.filter("is_real").groupBy("subject_id", "code")
              .agg(F.max("y").alias("y"), F.max("at_risk").alias("at_risk")))
    return (keyed.select("subject_id", "cutoff", "code", "is_real")
            .join(parent, ["subject_id", "code"]))
