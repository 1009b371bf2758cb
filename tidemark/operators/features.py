"""Point-in-time feature blocks in long form: subject_id, cutoff, block, feature, value.

A pair that is absent is a zero; lab slopes are null where undefined. All blocks are built
from a few tables of mergeable cells (see ``segments``), so raw events are shuffled once
per cell table and never paired with cutoffs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import YEAR_DAYS, FeatureConfig
from tidemark.functions.scalars import bin_of
from tidemark.functions.time import days_between
from tidemark.operators import stats
from tidemark.operators.distributed import beside
from tidemark.operators.segments import in_window, place_events, roll_up

KEY = ("subject_id", "cutoff")
_ORIGIN = "timestamp_ntz'2000-01-01 00:00:00'"


def _windows(cfg: FeatureConfig) -> tuple[float, ...]:
    return (*cfg.windows, cfg.rate_window)


def window_name(days: float | None) -> str:
    return "ever" if days is None else f"{days:g}d"


def _named_windows(cfg: FeatureConfig) -> list[tuple[str, Column]]:
    named = [(window_name(w), in_window(i)) for i, w in enumerate(cfg.windows)]
    return [*named, ("ever", F.lit(True))]


def _long(df: DataFrame, parts: list[tuple[str, Column, Column]]) -> DataFrame:
    """Unfold (block, feature, value) triples of each row."""
    rows = F.array(*[F.struct(F.lit(b).alias("block"), n.alias("feature"), v.cast("double").alias("value"))
                     for b, n, v in parts])
    return df.select(*KEY, F.inline(rows))


def _name(prefix: str, column: str | None = None) -> Column:
    return F.concat(F.lit(prefix), F.col(column)) if column else F.lit(prefix)


def usable_events(events: DataFrame, vocabulary: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Pre-anchor events of the configured kinds whose token is in the vocabulary."""
    return stats.base_events(events, cfg.kinds).join(vocabulary.select("token"), "token", "left_semi")


def event_cells(usable: DataFrame, examples: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Mergeable aggregates per (subject, kind, token, stretch): counts, times, costs, values, moments."""
    placed = place_events(usable, examples, _windows(cfg))
    value = F.when(F.col("is_numeric"), F.col("value"))
    t = F.when(value.isNotNull(), days_between(F.expr(_ORIGIN), F.col("ts")) / F.lit(YEAR_DAYS))
    return placed.groupBy("subject_id", "kind", "token", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum("cost").alias("cost"), F.count("cost").alias("n_cost"),
        F.count(value).alias("nv"), F.avg(t).alias("mt"), F.avg(value).alias("mv"),
        (F.var_pop(t) * F.count(t)).alias("ctt"), (F.covar_pop(t, value) * F.count(t)).alias("ctv"), F.min(F.when(value.isNotNull(), F.col("ts"))).alias("first_v"),
        F.max(F.when(value.isNotNull(), F.struct(F.col("ts").alias("ts"), value.alias("value")))).alias("last_v"),
    )


def nested_counts(cells: DataFrame, examples: DataFrame, cfg: FeatureConfig, more: list[Column] = []) -> DataFrame:
    """Counts per (example, token) for every look-back window and for all history: n_<window>; ``more`` aggregates of the cells go along."""
    totals = [F.sum(F.when(inside, F.col("n")).otherwise(0)).alias(f"n_{name}") for name, inside in _named_windows(cfg)]
    return roll_up(cells, examples, ["token"], [*totals, *more], _windows(cfg))


def counts_block(counts: DataFrame, cfg: FeatureConfig) -> DataFrame:
    names = [n for n, _ in _named_windows(cfg)]
    parts = [(f"A{i}_counts_{n}", _name(f"cnt[{n}]:", "token"), F.col(f"n_{n}")) for i, n in enumerate(names)]
    return _long(counts, parts).filter(F.col("value") != 0)


def value_decile_counts(usable: DataFrame, examples: DataFrame, edges: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Events per (example, token, value bin) over all history."""
    binned = stats.numeric_events(usable).join(edges.select("token", "edges"), "token")
    binned = binned.withColumn("bin", F.least(bin_of("edges", "value"), F.lit(cfg.n_bins - 1)))
    placed = place_events(binned, examples)
    cells = placed.groupBy("subject_id", "token", "bin", "seg").agg(F.count(F.lit(1)).alias("n"))
    return roll_up(cells, examples, ["token", "bin"], [F.sum("n").alias("n")])


def decile_block(counts: DataFrame) -> DataFrame:
    name = F.concat(F.lit("dec:"), "token", F.lit(":Q"), F.col("bin").cast("string"))
    return _long(counts, [("B_value_deciles", name, F.col("n"))])


def prevalent_block(labels: DataFrame) -> DataFrame:
    return _long(labels.filter("prevalent = 1"), [("C_prevalent", _name("prev:", "code"), F.col("prevalent"))])


def example_ages(examples: DataFrame, cohort: DataFrame) -> DataFrame:
    rows = examples.select(*KEY).join(cohort.select("subject_id", "birthdate"), "subject_id")
    return rows.select(*KEY, (days_between(F.col("birthdate"), F.col("cutoff")) / F.lit(YEAR_DAYS)).alias("age"))


def demographics_block(examples: DataFrame, cohort: DataFrame, scope: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One-hot categories seen in the scope (others count as OTHER, nulls as MISSING), z-scored age and its square."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit("MISSING")).alias("val"))
                                for c in columns])).alias("p")
    owned = cohort.select("subject_id", pairs).select("subject_id", "p.col", "p.val")
    known = owned.join(scope, "subject_id", "left_semi").select("col", "val").distinct().withColumn("_known", F.lit(True))
    value = F.when(F.col("_known"), F.col("val")).otherwise(F.lit("OTHER"))
    named = owned.join(known, ["col", "val"], "left").select(
        "subject_id", F.concat_ws("_", "col", value).alias("name"))
    hot = _long(examples.select(*KEY).join(named, "subject_id"), [("D_demographics", F.col("name"), F.lit(1.0))])
    ages = example_ages(examples, cohort)
    z = (F.col("age") - F.col("age_mean")) / F.col("age_sd")
    scored = beside(ages, stats.fit_age(ages, scope)).withColumn("z", z)
    return hot.unionByName(_long(scored, [("D_demographics", F.lit("age_z"), F.col("z")),
                                          ("D_demographics", F.lit("age_z_sq"), F.col("z") * F.col("z"))]))


def active_days(usable: DataFrame, examples: DataFrame) -> DataFrame:
    """Distinct event instants before each cutoff; an instant lies in one stretch, so the counts add up."""
    cells = place_events(usable, examples).groupBy("subject_id", "seg").agg(F.countDistinct("ts").alias("n"))
    return roll_up(cells, examples, [], [F.sum("n").alias("n_days")])


def history_shape(usable: DataFrame, cells: DataFrame, examples: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One row per example with the size, length, recency and mix of its history."""
    rate = in_window(len(cfg.windows))
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k_{k}") for k in cfg.shape_kinds]
    sizes = roll_up(cells, examples, ["token"], [
        F.sum("n").alias("n"), F.sum(F.when(rate, F.col("n")).otherwise(0)).alias("recent"),
        F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi_ts"), *kinds], _windows(cfg))
    whole = sizes.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_tokens"), F.sum("recent").alias("recent"),
        F.min("lo").alias("lo"), F.max("hi_ts").alias("hi_ts"), *[F.sum(f"k_{k}").alias(f"k_{k}") for k in cfg.shape_kinds])
    full = examples.select(*KEY).join(whole, list(KEY), "left").join(active_days(usable, examples), list(KEY), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    n, days = zero("n"), zero("n_days")
    span = F.coalesce(days_between(F.col("lo"), F.col("hi_ts")), F.lit(0.0))
    recency = F.coalesce(days_between(F.col("hi_ts"), F.col("cutoff")), F.lit(cfg.cap_days))
    shares = [(zero(f"k_{k}") / F.greatest(n, F.lit(1.0))).alias(f"frac_{k}") for k in cfg.shape_kinds]
    return full.select(
        *KEY, F.log1p(n).alias("log_n_events"), F.log1p(days).alias("log_n_days"),
        F.log1p(zero("n_tokens")).alias("log_n_distinct_tokens"), (span / F.lit(YEAR_DAYS)).alias("history_span_years"),
        F.log1p(recency).alias("log_days_since_last"), F.log1p(zero("recent") / 2.0).alias("log_rate_recent"),
        (n / F.greatest(days, F.lit(1.0))).alias("events_per_active_day"), *shares)


def shape_block(shape: DataFrame, block: str = "E_history_shape", prefix: str = "") -> DataFrame:
    names = [c for c in shape.columns if c not in KEY]
    return _long(shape, [(block, F.lit(prefix + c), F.col(c)) for c in names])


def lab_last(cells: DataFrame, examples: DataFrame, labs: DataFrame, scope: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Latest numeric value per (example, lab), z-scored on the scope's examples.

    Of several values at the same instant the largest is taken.
    """
    mine = cells.filter("nv > 0").join(labs.select("token"), "token", "left_semi")
    last = roll_up(mine, examples, ["token"], [F.max("last_v").alias("v")], _windows(cfg)).select(*KEY, "token", F.col("v.value").alias("last"))
    fitted = last.join(scope, "subject_id", "left_semi").groupBy("token").agg(
        F.avg("last").alias("mu"), (F.stddev_pop("last") + F.lit(1e-9)).alias("sd"))
    scored = last.join(fitted, "token", "left")
    return scored.select(*KEY, "token", "last", F.coalesce((F.col("last") - F.col("mu")) / F.col("sd"), F.lit(0.0)).alias("z"))


def lab_last_block(last: DataFrame) -> DataFrame:
    return _long(last, [("F_lab_last", _name("lab_last_z:", "token"), F.col("z")),
                        ("F_lab_last", _name("lab_seen:", "token"), F.lit(1.0))])


def reason_counts(events: DataFrame, examples: DataFrame, reasons: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Nested window counts per (example, reason); reasons the scope never saw are dropped."""
    coded = stats.base_events(events, cfg.kinds).join(reasons, "reason", "left_semi")
    placed = place_events(coded, examples, _windows(cfg))
    cells = placed.groupBy("subject_id", "reason", "seg").agg(F.count(F.lit(1)).alias("n"))
    totals = [F.sum(F.when(inside, F.col("n")).otherwise(0)).alias(f"n_{name}") for name, inside in _named_windows(cfg)]
    return roll_up(cells, examples, ["reason"], totals, _windows(cfg))


def reason_block(counts: DataFrame, cfg: FeatureConfig) -> DataFrame:
    names = [n for n, _ in _named_windows(cfg)]
    parts = [(f"G{i}_reason_{n}", _name(f"rsn[{n}]:", "reason"), F.col(f"n_{n}")) for i, n in enumerate(names)]
    return _long(counts, parts).filter(F.col("value") != 0)


def lab_slope(cells: DataFrame, examples: DataFrame, labs: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Least-squares slope of value on time in units per year; null below two distinct instants."""
    mine = cells.filter("nv > 0").join(labs.select("token"), "token", "left_semi")
    # Centred moments, at most one entry per stretch; combining them this way keeps the
    # digits that plain power sums lose when readings lie close together.
    parts = F.collect_list(F.struct("nv", "mt", "mv", "ctt", "ctv"))
    sums = roll_up(mine, examples, ["token"], [
        parts.alias("parts"), F.min("first_v").alias("lo"), F.max("last_v.ts").alias("hi_ts")], _windows(cfg))
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + f(p))
    means = sums.withColumn("n", total(lambda p: p["nv"].cast("double")))
    means = means.withColumn("tm", total(lambda p: p["nv"] * p["mt"]) / F.col("n"))
    means = means.withColumn("vm", total(lambda p: p["nv"] * p["mv"]) / F.col("n"))
    tm, vm = F.col("tm"), F.col("vm")
    spread = total(lambda p: p["ctt"] + p["nv"] * (p["mt"] - tm) * (p["mt"] - tm))
    cross = total(lambda p: p["ctv"] + p["nv"] * (p["mt"] - tm) * (p["mv"] - vm))
    slope = F.when(F.col("lo") < F.col("hi_ts"), F.try_divide(cross, spread))
    return means.select(*KEY, "token", slope.alias("slope"))


def slope_block(slopes: DataFrame, examples: DataFrame, labs: DataFrame) -> DataFrame:
    """Every (example, lab) pair: an unknown slope is null, not zero."""
    names = labs.agg(F.array_sort(F.collect_list("token")).alias("t")).scalar()
    dense = examples.select(*KEY, F.explode(names).alias("token")).join(slopes, [*KEY, "token"], "left")
    return _long(dense, [("H_lab_slope", _name("lab_slope:", "token"), F.col("slope"))])


def tracked_tokens(vocabulary: DataFrame, target_tokens: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Target tokens in the vocabulary plus the commonest tokens."""
    mine = vocabulary.select("token").join(target_tokens, "token", "left_semi")
    return mine.union(stats.common_tokens(vocabulary, cfg.n_common)).distinct()


def time_since_last(cells: DataFrame, examples: DataFrame, tracked: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Years since the last occurrence for every (example, tracked token), capped; never is the cap."""
    mine = cells.join(tracked, "token", "left_semi")
    last = roll_up(mine, examples, ["token"], [F.max("last_ts").alias("last")], _windows(cfg))
    names = tracked.agg(F.array_sort(F.collect_list("token")).alias("t")).scalar()
    dense = examples.select(*KEY, F.explode(names).alias("token")).join(last, [*KEY, "token"], "left")
    days = F.least(F.coalesce(days_between(F.col("last"), F.col("cutoff")), F.lit(cfg.cap_days)), F.lit(cfg.cap_days))
    return dense.select(*KEY, "token", (days / F.lit(YEAR_DAYS)).alias("years"))


def time_since_block(since: DataFrame) -> DataFrame:
    return _long(since, [("I_time_since", _name("time_since_y:", "token"), F.col("years"))])


def cost_windows(cells: DataFrame, examples: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Per example and window: log of the total cost and the mean cost."""
    sums = []
    for name, inside in _named_windows(cfg):
        sums += [F.sum(F.when(inside, F.col("cost"))).alias(f"c_{name}"),
                 F.sum(F.when(inside, F.col("n_cost"))).alias(f"m_{name}")]
    totals = roll_up(cells, examples, [], sums, _windows(cfg))
    full = examples.select(*KEY).join(totals, list(KEY), "left")
    out = []
    for name, _ in _named_windows(cfg):
        total = F.coalesce(F.col(f"c_{name}"), F.lit(0.0))
        count = F.greatest(F.coalesce(F.col(f"m_{name}"), F.lit(0)), F.lit(1))
        out += [F.log1p(total).alias(f"cost_log_total[{name}]"), (total / count).alias(f"cost_mean[{name}]")]
    return full.select(*KEY, *out)


def age_residual(shape: DataFrame, ages: DataFrame, scope: DataFrame) -> DataFrame:
    """What is left of each history-shape feature after a scope-fitted quadratic in age."""
    rows = _as_rows(shape).join(ages, list(KEY))
    rows = beside(rows, stats.fit_age(ages, scope)).withColumn("x", F.col("age") - F.col("age_mean"))
    fitted = stats.fit_quadratic(rows.join(scope, "subject_id", "left_semi"), ["feature"], "x", "value")
    x = F.col("x")
    line = F.col("c0") + F.col("c1") * x + F.col("c2") * x * x
    joined = rows.join(fitted, "feature")
    return joined.select(*KEY, F.lit("K_age_residual").alias("block"), _name("resid_age:", "feature").alias("feature"),
                         (F.col("value") - line).alias("value"))


def _as_rows(shape: DataFrame) -> DataFrame:
    return shape_block(shape).drop("block")


def assemble(blocks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, blocks)


@dataclass(frozen=True)
class Fitted:
    """The small tables fitted on a scope. Several blocks look each up, so keep them stored."""

    vocabulary: DataFrame
    edges: DataFrame
    labs: DataFrame
    reasons: DataFrame

    @classmethod
    def on(cls, events: DataFrame, scope: DataFrame, cfg: FeatureConfig) -> Fitted:
        return cls(stats.fit_vocabulary(events, scope, cfg), stats.fit_value_edges(events, scope, cfg),
                   stats.lab_coverage(events, scope, cfg), stats.fit_reasons(events, scope, cfg))


def build_features(events: DataFrame, examples: DataFrame, labels: DataFrame, cohort: DataFrame, scope: DataFrame,
                   target_tokens: DataFrame, cfg: FeatureConfig, demographics: tuple[str, ...],
                   fitted: Fitted | None = None, cells: DataFrame | None = None,
                   shape: DataFrame | None = None) -> DataFrame:
    """All eleven blocks for the given examples, every statistic fitted on the scope.

    Fitted tables, cells and history shape feed several blocks each; pass them stored, so that
    raw events are read once for each and not once per block.
    """
    fitted = fitted or Fitted.on(events, scope, cfg)
    usable = usable_events(events, fitted.vocabulary, cfg)
    cells = event_cells(usable, examples, cfg) if cells is None else cells
    shape = history_shape(usable, cells, examples, cfg) if shape is None else shape
    tracked = tracked_tokens(fitted.vocabulary, target_tokens, cfg)
    return assemble([
        counts_block(nested_counts(cells, examples, cfg), cfg),
        decile_block(value_decile_counts(usable, examples, fitted.edges, cfg)),
        prevalent_block(labels),
        demographics_block(examples, cohort, scope, demographics),
        shape_block(shape),
        lab_last_block(lab_last(cells, examples, fitted.labs, scope, cfg)),
        reason_block(reason_counts(events, examples, fitted.reasons, cfg), cfg),
        slope_block(lab_slope(cells, examples, fitted.labs, cfg), examples, fitted.labs),
        time_since_block(time_since_last(cells, examples, tracked, cfg)),
        shape_block(cost_windows(cells, examples, cfg), "J_cost"),
        age_residual(shape, example_ages(examples, cohort), scope),
    ])


def feature_signatures(features: DataFrame) -> DataFrame:
    """Order-free fingerprint of every feature column over all examples, combined map-side.

    Zeros are left out, so a stored zero equals an absent row; nulls are hashed as such.
    """
    shown = features.filter(F.col("value").isNull() | (F.col("value") != 0))
    cell = F.xxhash64("subject_id", "cutoff", F.coalesce(F.col("value"), F.lit(-123456.0)))
    other = F.xxhash64(F.lit(7), F.coalesce(F.col("value"), F.lit(-123456.0)), "cutoff", "subject_id")
    return shown.groupBy("block", "feature").agg(
        F.count(F.lit(1)).alias("sig_n"), F.bit_xor(cell).alias("sig_a"),
        F.sum(other.cast("decimal(20,0)")).alias("sig_b"))


def scope_constants(features: DataFrame, examples: DataFrame, scope: DataFrame) -> DataFrame:
    """Features that take one value over all scope examples, counting absent pairs as zero."""
    rows = features.join(scope, "subject_id", "left_semi")
    n = examples.join(scope, "subject_id", "left_semi").select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    seen = rows.groupBy("block", "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo = F.when(F.col("rows") < n, F.least(F.col("lo"), F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(F.col("rows") < n, F.greatest(F.col("hi"), F.lit(0.0))).otherwise(F.col("hi"))
    varied = seen.filter(lo < hi).select("block", "feature")
    return features.select("block", "feature").distinct().join(varied, ["block", "feature"], "left_anti")


def dedupe_features(features: DataFrame, examples: DataFrame, scope: DataFrame) -> DataFrame:
    """Names of the features to keep: not constant on the scope, first of its duplicates by (block, feature)."""
    signed = feature_signatures(features).join(scope_constants(features, examples, scope), ["block", "feature"], "left_anti")
    first = signed.groupBy("sig_n", "sig_a", "sig_b").agg(F.min(F.struct("block", "feature")).alias("_kept"))
    return first.select("_kept.block", "_kept.feature")


def feature_subset(features: DataFrame, names: list[str]) -> DataFrame:
    return features.filter(F.col("feature").isin(*names))


def to_vectors(features: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """One compressed vector per example, for Spark ML. ``size`` is the number of indexed features."""
    indexed = features.join(index.select("block", "feature", "index"), ["block", "feature"])
    gathered = indexed.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("_pairs"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))

    def stretch(pair, i):
        before = F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at("_pairs", i)["index"])
        return F.concat(zeros(pair["index"] - before - 1), F.array(pair["value"]))

    tail = zeros(F.lit(size - 1) - F.element_at("_pairs", -1)["index"])
    dense = F.concat(F.flatten(F.transform("_pairs", stretch)), tail)
    vectors = gathered.select(*KEY, array_to_vector(dense).alias("_dense"))
    return VectorAssembler(inputCols=["_dense"], outputCol="features").transform(vectors).drop("_dense")
