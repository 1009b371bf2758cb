"""Analytics on experiment results, many experiments at once.

Inputs are long tables: ``by`` columns name the experiment, numeric factor columns give the
configuration, ``fold`` and a metric the result. Long per-subject results are reduced by
``cell_means`` first; what follows has one row per configuration or contrast, so its size is
set by the designs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.tdist import t_quantile, t_tail


def cell_means(results: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(metric).alias(metric))


def _twins(cells: DataFrame, by: Sequence[str], factors: Sequence[str], metric: str) -> DataFrame:
    """hi minus lo of every pair of cells that differ in one factor only, for all factors."""
    views = [F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("level"),
                      F.to_json(F.struct(*[g for g in factors if g != f], F.lit(0).alias("_"))).alias("others"))
             for f in factors]
    rows = cells.select(*by, metric, F.inline(F.array(*views)))
    levels = rows.groupBy(*by, "factor").agg(F.min("level").alias("lo"), F.max("level").alias("hi"),
                                             F.countDistinct("level").alias("n_levels")).filter("n_levels = 2")
    paired = rows.join(levels, [*by, "factor"]).groupBy(*by, "factor", "others").agg(
        F.avg(F.when(F.col("level") == F.col("hi"), F.col(metric))).alias("y_hi"),
        F.avg(F.when(F.col("level") == F.col("lo"), F.col(metric))).alias("y_lo"))
    return paired.select(*by, "factor", "others", (F.col("y_hi") - F.col("y_lo")).alias("d")).filter("d is not null")


def paired_effects(cells: DataFrame, factors: Sequence[str], metric: str, by: Sequence[str] = ("experiment",),
                   fold: str = "fold", q: float = 0.15) -> DataFrame:
    """Main effects of two-level factors by matched pairs, one row per experiment and factor.

    ``cells`` has one row per (experiment, configuration, fold). The standard error is the
    larger of that across pairs and the fold one with the Nadeau-Bengio correction.
    """
    by = list(by)
    overall = _twins(cell_means(cells, [*by, *factors], metric), by, factors, metric)
    pairs = overall.groupBy(*by, "factor").agg(
        F.avg("d").alias("effect"), F.stddev_samp("d").alias("sd"), F.count(F.lit(1)).alias("n_pairs"))
    pairs = pairs.filter("n_pairs >= 2").withColumn("se_config", F.col("sd") / F.sqrt("n_pairs"))
    each = _twins(cells, [*by, fold], factors, metric).groupBy(*by, fold, "factor").agg(F.avg("d").alias("d"))
    folds = each.groupBy(*by, "factor").agg(F.stddev_samp("d").alias("fold_spread"), F.count(F.lit(1)).alias("k"))
    k = F.col("k").cast("double")
    correction = F.sqrt((1 / k + 1 / (k - 1)) * k)
    folds = folds.withColumn("se_fold", F.when(F.col("k") > 1, F.col("fold_spread") / F.sqrt(k) * correction))
    both = pairs.join(folds, [*by, "factor"])
    se = F.greatest("se_config", F.coalesce("se_fold", "se_config"))
    t = F.try_divide("effect", "se")
    out = both.withColumn("se", se).withColumn("t", t)
    out = out.withColumn("p_onesided", t_tail(F.col("t"), F.greatest(F.col("k") - 1, F.lit(1))))
    out = bh_adjust(out, by, "p_onesided", q)
    out = shrink(out, by, "effect", "se")
    return out.select(*by, "factor", "effect", "se", "se_config", "se_fold", "t", "p_onesided", "n_pairs", "fold_spread",
                      "q_bh", "passes_bh", (F.col("effect") - 1.96 * F.col("se")).alias("ci_lo"),
                      (F.col("effect") + 1.96 * F.col("se")).alias("ci_hi"), "shrunken")


def orthogonal_contrasts(runs: DataFrame, coded: Sequence[str], metric: str,
                         by: Sequence[str] = ("experiment",)) -> DataFrame:
    """mean(hi) - mean(lo) of each factor and each product of two, for runs coded -1 / +1."""
    parts = [(f, F.col(f).cast("double"), "main") for f in coded]
    parts += [(f"{a}:{b}", (F.col(a) * F.col(b)).cast("double"), "interaction")
              for a, b in itertools.combinations(coded, 2)]
    rows = F.array(*[F.struct(F.lit(n).alias("factor"), s.alias("sign"), F.lit(kind).alias("kind")) for n, s, kind in parts])
    y = F.col(metric)
    up, down = F.when(F.col("sign") > 0, y), F.when(F.col("sign") < 0, y)
    out = runs.select(*by, metric, F.inline(rows)).groupBy(*by, "factor", "kind").agg(
        (F.avg(up) - F.avg(down)).alias("effect"), F.count(up).alias("n_hi"), F.count(down).alias("n_lo"))
    return out.filter("n_hi > 0 and n_lo > 0")


def lenth(contrasts: DataFrame, by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Lenth's pseudo standard error per experiment: lenth_pse, lenth_n, lenth_df."""
    by = list(by)
    sized = contrasts.withColumn("_a", F.abs("effect"))
    start = sized.groupBy(*by).agg((1.5 * F.median("_a")).alias("_s0"), F.count(F.lit(1)).alias("lenth_n"))
    trimmed = sized.join(start, by).filter((F.col("_s0") <= 0) | (F.col("_a") < 2.5 * F.col("_s0")))
    return trimmed.groupBy(*by).agg(
        (1.5 * F.median("_a")).alias("lenth_pse"), F.max("lenth_n").alias("lenth_n")).withColumn(
        "lenth_df", F.greatest(F.lit(1), F.floor(F.col("lenth_n") / 3)).cast("int"))


def orthogonal_effects(runs: DataFrame, coded: Sequence[str], metric: str, by: Sequence[str] = ("experiment",),
                       sigma_pure: DataFrame | None = None, interactions: bool = True, q: float = 0.15) -> DataFrame:
    """Contrasts with Lenth's error and, given ``sigma_pure`` (by, sigma, n_pure), the pure-error one as well."""
    by = list(by)
    pool = orthogonal_contrasts(runs, coded, metric, by)
    shown = pool if interactions else pool.filter("kind = 'main'")
    out = shown.join(lenth(pool, by), by)
    tail2 = lambda t, df: 2.0 * t_tail(F.abs(t), df)
    out = out.withColumn("t_lenth", F.try_divide("effect", "lenth_pse"))
    out = out.withColumn("p_lenth", tail2(F.col("t_lenth"), F.col("lenth_df")))
    out = out.withColumn("margin_of_error", t_quantile(0.975, F.col("lenth_df")) * F.col("lenth_pse"))
    if sigma_pure is None:
        out = out.withColumn("_se", F.when(F.col("lenth_pse") > 0, F.col("lenth_pse")).otherwise(F.lit(1.0)))
        return bh_adjust(shrink(out, by, "effect", "_se").drop("_se"), by, "p_lenth", q)
    n_runs = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("_runs"))
    out = out.join(sigma_pure, by).join(n_runs, by)
    df = F.col("n_pure") - 1
    out = out.withColumn("se_pure", 2.0 * F.col("sigma") / F.sqrt("_runs"))
    out = out.withColumn("t_pure", F.try_divide("effect", "se_pure")).withColumn("p_pure", tail2(F.col("t_pure"), df))
    half = t_quantile(0.975, df) * F.col("se_pure")
    out = out.withColumn("ci_lo", F.col("effect") - half).withColumn("ci_hi", F.col("effect") + half)
    return bh_adjust(shrink(out, by, "effect", "se_pure").drop("_runs", "sigma", "n_pure"), by, "p_pure", q)


def bh_adjust(rows: DataFrame, by: Sequence[str], p: str, q: float = 0.15) -> DataFrame:
    """Benjamini-Hochberg: q_bh and passes_bh inside each family of contrasts."""
    up = W.partitionBy(*by).orderBy(F.col(p))
    raw = rows.withColumn("_raw", F.col(p) * F.count(F.col(p)).over(W.partitionBy(*by)) / F.row_number().over(up))
    down = W.partitionBy(*by).orderBy(F.col(p).desc(), F.col("_raw").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = raw.withColumn("q_bh", F.least(F.min("_raw").over(down), F.lit(1.0)))
    return out.withColumn("passes_bh", F.col("q_bh") <= q).drop("_raw")


def shrink(rows: DataFrame, by: Sequence[str], effect: str, se: str) -> DataFrame:
    """Empirical-Bayes shrinkage: zero for all where the spread is no larger than the noise."""
    family = W.partitionBy(*by)
    tau2 = F.greatest(F.lit(0.0), F.coalesce(F.var_samp(effect).over(family), F.lit(0.0)) - F.avg(F.col(se) * F.col(se)).over(family))
    out = rows.withColumn("_tau2", tau2)
    weight = F.coalesce(F.try_divide(F.col("_tau2"), F.col("_tau2") + F.col(se) * F.col(se)), F.lit(0.0))
    return out.withColumn("shrunken", F.col(effect) * weight).drop("_tau2")


def replicate_sigma(runs: DataFrame, by: Sequence[str], metric: str, sizes: Sequence[int] = (16, 20, 32)) -> DataFrame:
    """Noise of replicated runs: sd, its relative error, smallest detectable effect at each design size."""
    out = runs.groupBy(*by).agg(F.count(metric).alias("n_runs"), F.avg(metric).alias("mean"),
                                F.stddev_samp(metric).alias("sigma")).filter("n_runs > 1")
    rel = F.lit(1.0) / F.sqrt(2.0 * (F.col("n_runs") - 1))
    return out.select("*", rel.alias("sigma_rel_se"),
                      *[(F.lit(2.8 * 2 / math.sqrt(n)) * F.col("sigma")).alias(f"mde_{n}") for n in sizes])


def curvature_check(runs: DataFrame, by: Sequence[str], metric: str, centre: Column) -> DataFrame:
    """Corner mean minus centre mean against the centre runs' own scatter."""
    y = F.col(metric)
    mid, corner = F.when(centre, y), F.when(~centre, y)
    out = runs.groupBy(*by).agg(
        (F.avg(corner) - F.avg(mid)).alias("d"), F.stddev_samp(mid).alias("s_centre"),
        F.count(corner).alias("n_corner"), F.count(mid).alias("n_centre")).filter("n_centre >= 2")
    se = F.col("s_centre") * F.sqrt(1.0 / F.col("n_corner") + 1.0 / F.col("n_centre"))
    out = out.withColumn("z", F.try_divide(F.col("d"), se))
    return out.withColumn("curved", F.abs("z") >= 2)


def arm_contrast(arms: DataFrame, contrasts: Sequence[tuple[str, str]], metric: str, sigma: DataFrame,
                 by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Named differences between arms over sigma * sqrt(2); two of these are needed to resolve one."""
    by = list(by)
    listed = F.array(*[F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b")) for a, b in contrasts])
    wanted = arms.select(*by).distinct().select(*by, F.inline(listed))
    side = lambda s: arms.select(*by, F.col("arm").alias(f"arm_{s}"), F.col(metric).alias(f"y_{s}"))
    out = wanted.join(side("a"), [*by, "arm_a"]).join(side("b"), [*by, "arm_b"]).join(sigma, by)
    out = out.withColumn("d", F.col("y_a") - F.col("y_b"))
    out = out.withColumn("z", F.try_divide(F.col("d"), F.col("sigma") * math.sqrt(2.0)))
    return out.select(*by, "arm_a", "arm_b", "d", "z", (F.abs("z") >= 2).alias("resolvable"))
