"""Statistics fitted on a declared scope of subjects.

``scope`` (subject_id) is always an argument: there is no default universe to leak from.
Only events before the subject's anchor are read, once each, whatever the cutoffs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.config import FeatureConfig
from tidemark.operators.distributed import exact_quantiles, range_rank


def scope_violations(scope: DataFrame, cohort: DataFrame, split: str = "train") -> DataFrame:
    """Scope subjects that are not in the given split. Must be empty."""
    allowed = cohort.filter(F.col("split") == split).select("subject_id")
    return scope.select("subject_id").distinct().join(allowed, "subject_id", "left_anti")


def check_scope(scope: DataFrame, cohort: DataFrame, split: str = "train") -> DataFrame:
    """The scope itself; refuses one that holds any subject outside the split, or none at all."""
    if scope.limit(1).count() == 0:
        raise ValueError("empty fit scope")
    bad = scope_violations(scope, cohort, split).limit(1).collect()
    if bad:
        raise ValueError(f"fit scope holds subjects outside {split!r}, for one {bad[0]['subject_id']}")
    return scope


def base_events(events: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    pre = events.filter("is_pre_anchor")
    return pre.filter(F.col("kind").isin(*kinds)) if kinds else pre


def scope_events(events: DataFrame, scope: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    return base_events(events, kinds).join(scope, "subject_id", "left_semi")


def fit_vocabulary(events: DataFrame, scope: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Tokens seen in at least ``min_subjects`` scope subjects: (token, n_subjects)."""
    seen = scope_events(events, scope, cfg.kinds)
    return (seen.groupBy("token").agg(F.countDistinct("subject_id").alias("n_subjects"))
            .filter(F.col("n_subjects") >= cfg.min_subjects))


def numeric_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("is_numeric") & F.col("value").isNotNull())


def fit_value_edges(events: DataFrame, scope: DataFrame, cfg: FeatureConfig, min_edges: int = 2) -> DataFrame:
    """Distinct interior quantiles of a token's values, for tokens with enough of them: (token, edges, n)."""
    values = numeric_events(scope_events(events, scope, cfg.kinds)).select("token", "value")
    probs = [i / cfg.n_bins for i in range(1, cfg.n_bins)]
    cuts = exact_quantiles(values, ["token"], "value", probs)
    # Nine decimals fold cut points that differ by interpolation noise alone.
    edges = F.array_sort(F.array_distinct(F.transform("quantiles", lambda q: F.round(q, 9))))
    return cuts.select("token", edges.alias("edges"), "n").filter(F.size("edges") >= min_edges)


def lab_coverage(events: DataFrame, scope: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Tokens with a numeric value in a large enough share of scope subjects: (token, n_subjects, coverage)."""
    values = numeric_events(scope_events(events, scope, cfg.kinds))
    size = scope.agg(F.greatest(F.countDistinct("subject_id"), F.lit(1)).alias("n")).scalar()
    covered = values.groupBy("token").agg(F.countDistinct("subject_id").alias("n_subjects"))
    return (covered.withColumn("coverage", F.col("n_subjects") / size)
            .filter(F.col("coverage") >= cfg.lab_min_coverage))


def fit_reasons(events: DataFrame, scope: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Every reason seen at all in the scope."""
    return scope_events(events, scope, cfg.kinds).filter(F.col("reason").isNotNull()).select("reason").distinct()


def common_tokens(vocabulary: DataFrame, n: int) -> DataFrame:
    return vocabulary.orderBy(F.desc("n_subjects"), "token").limit(n).select("token")


def fit_age(examples: DataFrame, scope: DataFrame) -> DataFrame:
    """Mean and population sd of age over the scope's examples, as one row."""
    rows = examples.join(scope, "subject_id", "left_semi")
    return rows.agg(F.avg("age").alias("age_mean"), (F.stddev_pop("age") + F.lit(1e-9)).alias("age_sd"))


def fit_quadratic(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares of y on (1, x, x*x) per group, from one pass of power sums.

    ``x`` should be centred. Where x takes fewer than three values only the mean is fitted.
    """
    one, xc, yc = F.lit(1.0), F.col(x), F.col(y)
    powers = [F.sum(one).alias("s0")] + [F.sum(F.pow(xc, k)).alias(f"s{k}") for k in (1, 2, 3, 4)]
    cross = [F.sum(yc).alias("t0"), F.sum(yc * xc).alias("t1"), F.sum(yc * xc * xc).alias("t2")]
    sums = rows.groupBy(*by).agg(*powers, *cross)
    det = _det3("s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
    c0 = _det3("t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4")
    c1 = _det3("s0", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4")
    c2 = _det3("s0", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2")
    scale = F.col("s0") * F.col("s2") * F.col("s4")
    ok = F.abs(det) > scale * F.lit(1e-12)
    solved = [F.when(ok, F.try_divide(c, det)).otherwise(fallback) for c, fallback in
              ((c0, F.col("t0") / F.col("s0")), (c1, F.lit(0.0)), (c2, F.lit(0.0)))]
    return sums.select(*by, *[v.alias(n) for v, n in zip(solved, ("c0", "c1", "c2"), strict=True)])


def _det3(a, b, c, d, e, f, g, h, i):
    a, b, c, d, e, f, g, h, i = (F.col(n) for n in (a, b, c, d, e, f, g, h, i))
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def fit_scaling(features: DataFrame, examples: DataFrame, scope: DataFrame, log1p: bool = True) -> DataFrame:
    """Per feature, the scope median (fill for nulls) and largest absolute scaled value.

    A value that is absent from the long table is a zero and leaves the maximum as it is;
    the median is over the values present and only ever fills features that hold nulls.
    """
    rows = features.join(scope, "subject_id", "left_semi")
    has_null = features.groupBy("feature").agg(F.max(F.col("value").isNull().cast("int")).alias("_null"))
    nullable = has_null.filter("_null = 1").select("feature")
    medians = exact_quantiles(rows.join(nullable, "feature", "left_semi"), ["feature"], "value", [0.5])
    filled = rows.join(medians.select("feature", F.col("quantiles")[0].alias("median")), "feature", "left")
    scaled = F.abs(scale_value(F.coalesce("value", "median", F.lit(0.0)), log1p))
    peaks = filled.groupBy("feature").agg(F.coalesce(F.max("median"), F.lit(0.0)).alias("median"),
                                          F.max(scaled).alias("peak"))
    return peaks.withColumn("peak", F.when(F.col("peak") > 0, F.col("peak")).otherwise(F.lit(1.0)))


def scale_value(value, log1p: bool = True):
    return F.log1p(F.greatest(value, F.lit(0.0))) if log1p else value


def apply_scaling(features: DataFrame, scaling: DataFrame, log1p: bool = True) -> DataFrame:
    """Fill, log and scale; features never seen in the scope carry no information and are dropped."""
    joined = features.join(scaling, "feature")
    value = scale_value(F.coalesce("value", "median"), log1p) / F.col("peak")
    return joined.select("subject_id", "cutoff", "block", "feature", value.alias("value"))


def rank_features(features: DataFrame) -> DataFrame:
    """Dense 0-based index of the distinct features in (block, feature) order, numbered over ranges of names."""
    names = features.select("block", "feature").distinct()
    return range_rank(names, [], ["block", "feature"]).select("block", "feature", F.col("rank").cast("int").alias("index"))
