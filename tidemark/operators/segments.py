"""Point-in-time aggregation without pairing events with cutoffs.

Every question "how much happened before cutoff c, or in the w days before c" is a sum over
the stretches of time between the subject's boundaries: the cutoffs and the starts of their
look-back windows. Events are reduced to one mergeable row per (subject, key, stretch)
first, which combines map-side; only those rows meet the cutoffs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.time import minus_days


def _starts(windows: Sequence[float]) -> list[Column]:
    return [F.col("cutoff") if w == 0 else minus_days("cutoff", w) for w in windows]


def boundaries(examples: DataFrame, windows: Sequence[float] = ()) -> DataFrame:
    """Per subject, the sorted boundary instants. Its length is bounded by cutoffs x windows."""
    points = F.array(*_starts([0, *windows]))
    return (examples.select("subject_id", F.explode(points).alias("_point"))
            .groupBy("subject_id").agg(F.array_sort(F.collect_set("_point")).alias("_bounds")))


def place_events(events: DataFrame, examples: DataFrame, windows: Sequence[float] = ()) -> DataFrame:
    """Add ``seg``, the number of boundaries at or before the event; drop events after every cutoff."""
    bounds = boundaries(examples, windows)
    placed = events.join(bounds, "subject_id").filter(F.col("ts") < F.element_at("_bounds", -1))
    return placed.withColumn("seg", F.size(F.filter("_bounds", lambda b: b <= F.col("ts")))).drop("_bounds")


def place_cutoffs(examples: DataFrame, windows: Sequence[float] = ()) -> DataFrame:
    """Add ``hi`` and ``lo_<i>``: events with seg < hi precede the cutoff, with seg >= lo_i lie in window i."""
    bounds = boundaries(examples, windows)
    out = examples.join(bounds, "subject_id")
    out = out.withColumn("hi", F.array_position("_bounds", F.col("cutoff")).cast("int"))
    for i, start in enumerate(_starts(windows)):
        out = out.withColumn(f"lo_{i}", F.array_position("_bounds", start).cast("int"))
    return out.drop("_bounds")


def roll_up(cells: DataFrame, examples: DataFrame, keys: Sequence[str], aggregates: Sequence[Column],
            windows: Sequence[float] = ()) -> DataFrame:
    """Combine the cells that precede each cutoff into one row per (subject, cutoff, keys).

    ``windows`` must be those the cells were placed with.
    """
    placed = place_cutoffs(examples.select("subject_id", "cutoff").distinct(), windows)
    met = cells.join(placed, "subject_id").filter(F.col("seg") < F.col("hi"))
    return met.groupBy("subject_id", "cutoff", *keys).agg(*aggregates)


def in_window(i: int) -> Column:
    return F.col("seg") >= F.col(f"lo_{i}")
