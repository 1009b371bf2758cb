"""Ranks, prefix sums and exact quantiles that never put one group into one task.

Each helper works on two levels. Rows are given a bucket that is monotone in the sort
order, bucket totals are prefix-summed (a table of bounded width), and only the inside of
one bucket is ever sorted by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.hashing import digest
from tidemark.session import ship
from tidemark.sources.materialise import keep

# Hash buckets per group: four hex digits, so at most 65,536 bucket totals a group.
HASH_DIGITS = 4
# Distinct rows a value bucket of a prefix sum should hold, and the finest cut of a group.
ROWS_PER_BUCKET = 100_000
FINEST_CUT = 2_048
_SKETCH_ACCURACY = 4 * FINEST_CUT


def _over(by: Sequence[str]):
    return W.partitionBy(*by) if by else W.partitionBy(F.lit(0))


def _preceding(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def single_group(df: DataFrame, column: str, out: str = "_all") -> DataFrame:
    """Add a group column of one value, for the helpers that need a group.

    A literal would be folded out of the joins on it and leave a product behind.
    """
    return df.withColumn(out, F.pmod(F.xxhash64(column), F.lit(1)))


def hash_rank(df: DataFrame, key: str, seed, within: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """0-based rank of ``key`` in the md5 permutation of ``seed``, plus the group size ``<out>_n``.

    ``key`` must be unique inside each ``within`` group. md5 spreads keys evenly over the
    buckets, so a bucket holds about 1/65,536 of its group.
    """
    within = list(within)
    tagged = df.withColumn("_hash", digest(seed, F.col(key)))
    tagged = tagged.withColumn("_bucket", F.substring("_hash", 1, HASH_DIGITS))
    sizes = tagged.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *within, "_bucket",
        F.coalesce(F.sum("_size").over(_preceding(_over(within).orderBy("_bucket"))), F.lit(0)).alias("_offset"),
        F.sum("_size").over(_over(within)).alias(f"{out}_n"),
    )
    inside = F.row_number().over(W.partitionBy(*within, "_bucket").orderBy("_hash", key))
    ranked = tagged.join(offsets, within + ["_bucket"])
    return ranked.withColumn(out, (F.col("_offset") + inside - 1).cast("bigint")).drop("_hash", "_bucket", "_offset")


def value_bucket(df: DataFrame, by: Sequence[str], order: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``_bucket``: equal-depth over the distinct rows, monotone in ``order``.

    A group gets as many buckets as its rows call for. The cut points come from a mergeable quantile
    sketch, of which a small group takes every so many. They only balance the work; the results
    built on the buckets are exact whatever the cut points are.
    """
    grid = F.array(*[F.lit(i / FINEST_CUT) for i in range(1, FINEST_CUT)])
    stride = F.greatest(F.lit(1), F.floor(F.lit(float(FINEST_CUT) * rows_per_bucket) / F.col("_n"))).cast("int")
    cuts = (df.groupBy(*by).agg(F.percentile_approx(order, grid, _SKETCH_ACCURACY).alias("_grid"), F.count(order).alias("_n"))
            .withColumn("_stride", stride))
    cuts = cuts.select(*by, F.array_distinct(F.filter("_grid", lambda c, i: (i + 1) % F.col("_stride") == 0)).alias("_cuts"))
    joined = df.join(cuts, list(by))
    position = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return joined.withColumn("_bucket", position).drop("_cuts")


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
                bucketed: bool = False) -> DataFrame:
    """For one row per (by, order): ``<s>_before`` (strictly lower rows) and ``<s>_total``.

    ``by`` names at least one column, none of them null.
    Pass ``bucketed=True`` when the frame already carries ``_bucket`` from ``value_bucket``.
    """
    by = list(by)
    tagged = df if bucketed else value_bucket(df, by, order)
    totals = tagged.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    order_buckets = _preceding(_over(by).orderBy("_bucket"))
    offsets = totals.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_{s}").over(order_buckets), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(f"_{s}").over(_over(by)).alias(f"{s}_total") for s in sums],
    )
    inner = _preceding(W.partitionBy(*by, "_bucket").orderBy(order))
    out = tagged.join(offsets, by + ["_bucket"])
    for s in sums:
        out = out.withColumn(f"{s}_before", F.coalesce(F.sum(s).over(inner), F.lit(0)) + F.col(f"_{s}_off"))
    return out.drop("_bucket", *[f"_{s}_off" for s in sums])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    out: str = "quantiles") -> DataFrame:
    """Linearly interpolated quantiles per group as one array, exact for any group size.

    Rows first collapse to distinct values with counts, combined before the shuffle.
    """
    by = list(by)
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
               .agg(F.count(F.lit(1)).alias("_n")))
    return counted_quantiles(counted, by, value, "_n", probs, out)


def counted_quantiles(counted: DataFrame, by: Sequence[str], value: str, count: str, probs: Sequence[float],
                      out: str = "quantiles") -> DataFrame:
    """``exact_quantiles`` of a table of distinct values with counts."""
    by = list(by)
    ranked = prefix_sums(counted, by, value, [count])
    total, first = F.col(f"{count}_total"), F.col(f"{count}_before")
    last = first + F.col(count)
    picks = []
    for i, q in enumerate(probs):
        at = (total - 1) * F.lit(float(q))
        for name, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= pos) & (pos < last), F.col(value))).alias(f"_{name}{i}"))
    groups = ranked.groupBy(*by).agg(F.max(total).alias("_size"), *picks)
    values = []
    for i, q in enumerate(probs):
        at = (F.col("_size") - 1) * F.lit(float(q))
        values.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at)))
    return groups.select(*by, F.array(*values).alias(out), F.col("_size").alias("n"))


def range_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """0-based place of every row in its group by ``order``, plus the group size ``<out>_n``, from one order for all groups.

    Rows are dealt in ranges of (by, order) and stored; places inside a range are counted as the sorted rows stream by, and
    only the rows of each group in each range are summed up, of which there are as many as groups and ranges together.
    Rows that are equal in all of ``order`` get different places. No column of ``by`` is null; with none, all rows are one group.
    """
    by = list(by)
    ship(df.sparkSession)
    at = [df.columns.index(c) for c in by]

    def number(batches):
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            first = tuple(k[0] for k in keys)
            rows = np.arange(batch.num_rows)
            place = rows - np.maximum.accumulate(np.where(new, rows, 0))
            if first == last:
                place[:int(np.argmax(new)) if new.any() else len(new)] += n
            last, n = tuple(k[-1] for k in keys), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "_place"])

    schema = StructType([*df.schema.fields, StructField("_place", LongType())])
    ranges = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(number, schema)
    ranges = keep(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    counted = ranges.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counted.select(*by, "_range", F.coalesce(F.sum("_n").over(_preceding(_over(by).orderBy("_range"))), F.lit(0)).alias("_start"),
                            F.sum("_n").over(_over(by)).alias(f"{out}_n"))
    return ranges.join(starts, [*by, "_range"]).withColumn(out, F.col("_place") + F.col("_start")).drop("_place", "_range", "_start")


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row, as a scalar lookup."""
    names = one_row.columns
    value = one_row.select(F.struct(*names).alias("_row")).scalar()
    return df.withColumn("_row", value).select("*", *[F.col(f"_row.{n}").alias(n) for n in names]).drop("_row")
