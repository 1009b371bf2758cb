"""First-ever outcome labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.config import TimelineSpec
from tidemark.operators.distributed import beside


def first_ever(events: DataFrame, targets: DataFrame, spec: TimelineSpec) -> DataFrame:
    """Earliest occurrence of each target over the whole record, by raw time."""
    hits = events.filter(F.col("kind") == spec.target_kind).select("subject_id", "code", "ts")
    return (hits.join(targets.select("code"), "code", "left_semi")
            .groupBy("subject_id", "code").agg(F.min("ts").alias("first")))


def incident_label(examples: DataFrame, first: DataFrame) -> DataFrame:
    """Label the (example, target) pairs that occur at all; both window edges are closed."""
    return examples.join(first, "subject_id").select(
        "subject_id", "cutoff", "window_end", "split", "is_real", "code", "first",
        F.col("first").between(F.col("cutoff"), F.col("window_end")).cast("int").alias("y"),
        (F.col("first") < F.col("cutoff")).cast("int").alias("prevalent"),
    )


def with_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row with every declared target code; the list itself is a one-row lookup."""
    codes = targets.agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return df.withColumn("code", F.explode(codes.scalar()))


def label_pairs(examples: DataFrame, first: DataFrame, targets: DataFrame) -> DataFrame:
    """All (example, target) pairs: y, prevalent, at_risk; pairs that never occur are zeros.

    Where the window end is withheld (null) y is zero and only prevalence is known. A subject's first dates travel as one map of
    at most as many entries as there are targets, so rows are multiplied by the targets only after the last shuffle.
    """
    dates = first.groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "first"))).alias("_dates"))
    met = examples.select("subject_id", "cutoff", "window_end", "split", "is_real").join(dates, "subject_id", "left")
    seen = with_targets(met, targets).withColumn("first", F.col("_dates")[F.col("code")])
    prevalent = F.coalesce(F.col("first") < F.col("cutoff"), F.lit(False))
    y = F.coalesce(F.col("first").between(F.col("cutoff"), F.col("window_end")), F.lit(False))
    return seen.select("subject_id", "cutoff", "split", "is_real", "code", y.cast("int").alias("y"),
                       prevalent.cast("int").alias("prevalent"), (~prevalent).cast("int").alias("at_risk"))


def label_invariants(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Violation counts. ``past_edge`` is reported, not forbidden: 29 February anchors lose a day."""
    dense = pairs.agg(
        F.count_if((F.col("y") == 1) & (F.col("prevalent") == 1)).alias("n_both"),
        F.count_if((F.col("split") == "test") & (F.col("y") == 1)).alias("held_out_positive"),
        F.count_if(F.col("y") == 1).alias("n_incident"),
        F.count_if(F.col("prevalent") == 1).alias("n_prevalent"),
    )
    edges = labelled.filter("is_real").agg(
        F.count_if(F.col("first") > F.col("window_end")).alias("past_edge"),
        F.count_if(F.col("first") == F.col("window_end")).alias("on_edge"),
    )
    return beside(dense, edges)


def recurrence_trap(events: DataFrame, cohort: DataFrame, targets: DataFrame, spec: TimelineSpec) -> DataFrame:
    """(subject, target) pairs seen before the anchor and again inside the window.

    Each must be prevalent and none incident, however often it recurs.
    """
    hits = (events.filter(F.col("kind") == spec.target_kind)
            .join(targets.select("code"), "code", "left_semi")
            .join(cohort.select("subject_id", "anchor", "window_end"), "subject_id"))
    again = F.col("ts").between(F.col("anchor"), F.col("window_end"))
    return (hits.groupBy("subject_id", "code")
            .agg(F.count_if(F.col("ts") < F.col("anchor")).alias("n_before"),
                 F.count_if(again).alias("n_recur"))
            .filter((F.col("n_before") > 0) & (F.col("n_recur") > 0)))


def label_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split", "code").agg(
        F.sum("y").alias("n_incident"), F.sum("prevalent").alias("n_prevalent"),
        F.sum("at_risk").alias("n_at_risk"), F.count(F.lit(1)).alias("n_rows"))
