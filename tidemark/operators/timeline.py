"""Cohort and timeline assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.config import TimelineSpec
from tidemark.functions import scalars as S
from tidemark.functions.time import midnight, span_of, years_between


def anchor_from_visits(visits: DataFrame, spec: TimelineSpec) -> DataFrame:
    """Midnight of (last visit end or start, minus the window) per subject."""
    last = visits.groupBy("subject_id").agg(F.max(F.coalesce("stop", "ts")).alias("last_visit"))
    return last.select("subject_id", "last_visit",
                       midnight(F.col("last_visit") - span_of(spec.window)).alias("derived_anchor"))


def anchor_override(derived: DataFrame, splits: DataFrame, given: DataFrame, held_out: str = "test") -> DataFrame:
    """Held-out subjects take the supplied anchor, all others the derived one; a gap is an error."""
    joined = splits.join(derived, "subject_id", "left").join(given, "subject_id", "left")
    held = F.col("split") == held_out
    anchor = F.when(held, F.col("given_anchor")).otherwise(F.col("derived_anchor"))
    gap = F.raise_error(F.concat(F.lit("no anchor for subject "), F.col("subject_id").cast("string")))
    return joined.select(
        "subject_id", "split",
        F.coalesce(anchor, gap.cast("timestamp_ntz")).alias("anchor"),
        F.when(held, F.lit("provided")).otherwise(F.lit("derived")).alias("anchor_source"),
    )


def window_end(anchored: DataFrame, spec: TimelineSpec, held_out: str = "test") -> DataFrame:
    """Close the window one span after the anchor; null where outcomes are withheld."""
    end = F.col("anchor") + span_of(spec.window)
    return anchored.withColumn("window_end", F.when(F.col("split") != held_out, end))


def build_cohort(subjects: DataFrame, visits: DataFrame, splits: DataFrame, given: DataFrame,
                 spec: TimelineSpec) -> DataFrame:
    """One row per subject. ``subjects`` carries subject_id, birthdate and the demographic columns."""
    anchored = anchor_override(anchor_from_visits(visits, spec), splits, given)
    full = window_end(anchored, spec).join(subjects, "subject_id")
    age = F.datediff(F.col("anchor"), F.col("birthdate")) / F.lit(365.25)
    return full.select("subject_id", "split", "birthdate", "anchor", "window_end", "anchor_source",
                       age.alias("age_at_anchor"), *spec.demographics)


def union_timeline(tables: Sequence[DataFrame], cohort: DataFrame, spec: TimelineSpec) -> DataFrame:
    """All event tables as one long table, restricted to cohort subjects.

    The cohort join splits a subject with a large share of all events at run time (see
    ``session.configure``); nothing behind it groups raw events by subject alone.
    """
    events = reduce(DataFrame.unionByName, tables)
    known = cohort.select("subject_id", "anchor")
    return events.join(known, "subject_id").select(
        "subject_id", "ts", "kind", "code", "token", "value", "is_numeric", "reason", "cost",
        (F.col("ts") < F.col("anchor")).alias("is_pre_anchor"),
        S.kind_rank("kind", spec.kind_order).alias("kind_rank"),
    )


def snap_date_only(events: DataFrame, spec: TimelineSpec) -> DataFrame:
    """Add ``ts_seq``: date-only kinds move to the subject's first visit of that day, others stay.

    ``ts_seq`` orders events; labels and windows read ``ts``.
    """
    if not spec.date_only:
        return events.withColumn("ts_seq", F.col("ts"))
    first = (events.filter(F.col("kind") == spec.visit_kind)
             .groupBy("subject_id", F.col("ts").cast("date").alias("_day"))
             .agg(F.min("ts").alias("_visit")))
    movable = F.col("kind").isin(*spec.date_only)
    moved = (events.filter(movable).withColumn("_day", F.col("ts").cast("date"))
             .join(first, ["subject_id", "_day"], "left")
             .withColumn("ts_seq", F.coalesce("_visit", "ts")).drop("_day", "_visit"))
    return moved.unionByName(events.filter(~movable).withColumn("ts_seq", F.col("ts")))


def timeline_order(events: DataFrame) -> DataFrame:
    """Position of every run of equal (ts_seq, kind, token) in its subject's timeline.

    Rows equal in all order columns are interchangeable and collapse to one row with a count
    before the shuffle. Day totals per subject are prefix-summed, so a sort never sees more
    than the distinct entries of one subject's day.
    """
    runs = (events.groupBy("subject_id", "ts_seq", "kind_rank", "token")
            .agg(F.count(F.lit(1)).alias("n")).withColumn("_day", F.col("ts_seq").cast("date")))
    days = runs.groupBy("subject_id", "_day").agg(F.sum("n").alias("_size"))
    before = W.partitionBy("subject_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("subject_id", "_day", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = (W.partitionBy("subject_id", "_day").orderBy("ts_seq", "kind_rank", "token")
              .rowsBetween(W.unboundedPreceding, -1))
    position = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return (runs.join(days, ["subject_id", "_day"])
            .select("subject_id", "ts_seq", "kind_rank", "token", position.alias("position"), "n"))


def timeline_layout(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Physical layout for writing: range partitions in timeline order; a large subject spans several."""
    keys = ["subject_id", "ts_seq", "kind_rank", "token"]
    ranged = events.repartitionByRange(partitions, *keys) if partitions else events.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def snap_invariants(events: DataFrame, cohort: DataFrame, spec: TimelineSpec) -> DataFrame:
    """Violation counts of the snapping rules; ``n_snapped`` shows the check is not empty."""
    joined = events.join(cohort.select("subject_id", "anchor"), "subject_id")
    date_only = F.col("kind").isin(*spec.date_only) if spec.date_only else F.lit(False)
    return joined.agg(
        F.count_if(F.col("ts_seq") < F.col("ts")).alias("moved_back"),
        F.count_if(F.col("ts_seq").cast("date") != F.col("ts").cast("date")).alias("left_day"),
        F.count_if((F.col("ts_seq") < F.col("anchor")) != F.col("is_pre_anchor")).alias("crossed_anchor"),
        F.count_if(date_only & (F.col("ts") != midnight("ts"))).alias("not_midnight"),
        F.count_if(F.col("ts_seq") > F.col("ts")).alias("n_snapped"),
    )


def age_at(cohort_rows: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """Fractional years from birth to a cutoff."""
    return cohort_rows.withColumn("age", years_between("birthdate", cutoff))
