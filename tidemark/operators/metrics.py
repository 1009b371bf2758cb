"""Exact ranking metrics, resampling intervals and calibration measures over long score tables.

A score table has one row per (subject, code[, model, fold]) with probability ``p``, label
``y`` and flag ``at_risk``. Rows collapse to distinct scores with counts before anything is
sorted, and the sweep over scores is a two-level prefix sum (see ``distributed``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.config import EPS
from tidemark.functions.hashing import digest
from tidemark.functions.scalars import clip_prob
from tidemark.operators.bootstrap import bootstrap_by_label
from tidemark.operators.distributed import beside, exact_quantiles, prefix_sums, range_rank


def label_metrics(rows: DataFrame, by: Sequence[str], p: str = "p", y: str = "y", weight: str | None = None,
                  bucketed: bool = False) -> DataFrame:
    """Per group: n_pos, n_neg, auroc (ties half) and ap (step function, ties collapsed).

    Groups without a positive or without a negative get null metrics.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    extra = ["_bucket"] if bucketed else []
    points = rows.groupBy(*by, *extra, p).agg(
        F.sum(w * F.col(y)).alias("pos"), F.sum(w * (F.lit(1) - F.col(y))).alias("neg"))
    swept = prefix_sums(points, by, p, ["pos", "neg"], bucketed)
    dbl = lambda c: F.col(c).cast("double")
    tp, fp = dbl("pos_total") - dbl("pos_before"), dbl("neg_total") - dbl("neg_before")
    pairs = F.sum(dbl("pos") * (dbl("neg_before") + dbl("neg") / 2.0))
    precision = F.sum(dbl("pos") * F.try_divide(tp, tp + fp))
    out = swept.groupBy(*by).agg(F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"),
                                 pairs.alias("_pairs"), precision.alias("_precision"))
    scorable = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(
        *by, "n_pos", "n_neg",
        F.when(scorable, F.try_divide(F.col("_pairs"), dbl("n_pos") * dbl("n_neg"))).alias("auroc"),
        F.when(scorable, F.try_divide(F.col("_precision"), dbl("n_pos"))).alias("ap"))


def populations(rows: DataFrame) -> DataFrame:
    """Each row once in ``all`` and, where at risk, once more in ``at_risk``."""
    both = F.when(F.col("at_risk") == 1, F.array(F.lit("all"), F.lit("at_risk"))).otherwise(F.array(F.lit("all")))
    return rows.withColumn("population", F.explode(both))


def macro(per_label: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unweighted means over the scorable labels, with their number and that of the others."""
    return per_label.groupBy(*by).agg(
        F.avg("auroc").alias("macro_auroc"), F.avg("ap").alias("macro_ap"),
        F.count("auroc").alias("n_labels"), F.count_if(F.col("auroc").isNull()).alias("n_unscorable"))


def hanley_mcneil_se(auc, n_pos, n_neg) -> Column:
    """Analytic standard error of an AUROC (Hanley and McNeil, 1982)."""
    a, m, n = (F.col(c) if isinstance(c, str) else c for c in (auc, n_pos, n_neg))
    sq = a * a
    q1, q2 = a / (F.lit(2.0) - a), F.lit(2.0) * sq / (F.lit(1.0) + a)
    var = F.try_divide(a * (F.lit(1.0) - a) + (m - 1) * (q1 - sq) + (n - 1) * (q2 - sq), m.cast("double") * n)
    return F.when((m > 0) & (n > 0), F.sqrt(F.greatest(var, F.lit(0.0))))


def per_code_table(rows: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """One row per code with both denominators side by side."""
    metrics = label_metrics(populations(rows), ["code", "population"])
    whole = metrics.filter("population = 'all'").select("code", "n_pos", "n_neg", F.col("auroc").alias("auroc_all"), "ap")
    risk = metrics.filter("population = 'at_risk'").select("code", F.col("auroc").alias("auroc_at_risk"))
    counts = rows.groupBy("code").agg(F.sum(F.lit(1) - F.col("at_risk")).alias("n_prevalent"),
                                      F.sum("at_risk").alias("n_at_risk"), F.avg("y").alias("prevalence"))
    out = counts.join(whole, "code").join(risk, "code", "left")
    if descriptions is not None:
        out = out.join(descriptions.select("code", "description"), "code", "left")
    return out.withColumn("lift", F.try_divide("ap", "prevalence")).withColumn(
        "se_hanley", hanley_mcneil_se("auroc_all", "n_pos", "n_neg"))


# ---------------------------------------------------------------- resampling


def bootstrap_metrics(rows: DataFrame, n_boot: int, seed) -> DataFrame:
    """Macro metrics per (model, replicate); labels a replicate cannot score are left out and counted."""
    return macro(bootstrap_by_label(rows, n_boot, seed), ["model", "replicate"])


def _interval(name: str) -> list[Column]:
    # One value per replicate, so the group is as small as the declared number of replicates.
    bounds = F.percentile(name, F.array(F.lit(0.025), F.lit(0.975)))
    return [bounds[0].alias(f"{name}_lo"), bounds[1].alias(f"{name}_hi")]


def bootstrap_macro(rows: DataFrame, n_boot: int, seed) -> DataFrame:
    """Point estimates and percentile intervals per model, resampling subjects."""
    spread = bootstrap_metrics(rows, n_boot, seed).groupBy("model").agg(
        *_interval("macro_auroc"), *_interval("macro_ap"), F.sum("n_unscorable").alias("n_label_drops"))
    point = macro(label_metrics(rows, ["model", "code"]), ["model"]).select("model", "macro_auroc", "macro_ap")
    return point.join(spread, "model")


def paired_bootstrap(rows: DataFrame, a: str, b: str, n_boot: int, seed) -> DataFrame:
    """A minus B on the same resamples: delta, interval, sd and P(A > B) with ties counted half."""
    mine = rows.filter(F.col("model").isin(a, b))
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    # Sums arrive in any order; twelve decimals keep equal models equal.
    gap = lambda c: (F.round(pick(a, c) - pick(b, c), 12) + F.lit(0.0)).alias(f"d_{c}")
    deltas = bootstrap_metrics(mine, n_boot, seed).groupBy("replicate").agg(gap("macro_auroc"), gap("macro_ap"))
    wins = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).when(F.col(c) == 0, 0.5).otherwise(0.0))
    spread = deltas.filter("d_macro_auroc is not null").agg(
        *[x for c in ("d_macro_auroc", "d_macro_ap")
          for x in (*_interval(c), F.stddev_pop(c).alias(f"{c}_sd"), wins(c).alias(f"{c}_win"))],
        F.count(F.lit(1)).alias("n_resamples"))
    point = macro(label_metrics(mine, ["model", "code"]), ["model"]).agg(gap("macro_auroc"), gap("macro_ap"))
    return beside(point, spread)


def resolvable(paired: DataFrame, metric: str = "d_macro_ap", other: str = "d_macro_auroc") -> DataFrame:
    """Flags on a paired comparison: the interval excludes zero; A is a candidate to replace B.

    A candidate wins at least three quarters of the resamples on either metric while the
    other metric does not fall.
    """
    clear = lambda c: (F.col(f"{c}_lo") > 0) | (F.col(f"{c}_hi") < 0)
    better = lambda c, o: (F.col(f"{c}_win") >= 0.75) & (F.col(o) >= 0)
    return paired.select("*", clear(metric).alias("resolvable_ap"), clear(other).alias("resolvable_auroc"),
                         (better(metric, other) | better(other, metric)).alias("candidate"))


# ---------------------------------------------------------------- folds


def within_fold_rank(rows: DataFrame, seed="tie") -> DataFrame:
    """Rank of each score inside its (model, fold, code), scaled to [0, 1]: ``p_rank``.

    Equal scores are ordered by the md5 of the subject. All groups share one range-partitioned order, so no fold or
    score sits in one task.
    """
    by = ["model", "fold", "code"]
    ranked = range_rank(rows.withColumn("_tie", digest(seed, F.col("subject_id"))), by, ["p", "_tie", "subject_id"], "_at")
    return ranked.withColumn("p_rank", F.col("_at") / F.greatest(F.col("_at_n") - 1, F.lit(1))).drop("_tie", "_at", "_at_n")


def fold_summary(rows: DataFrame) -> DataFrame:
    """Per model: fold mean and sample sd of the at-risk macros, and pooled raw against rank-normalised."""
    risk = rows.filter("at_risk = 1")
    folds = macro(label_metrics(risk, ["model", "fold", "code"]), ["model", "fold"]).groupBy("model").agg(
        F.avg("macro_auroc").alias("auroc_mean"), F.stddev_samp("macro_auroc").alias("auroc_sd"),
        F.avg("macro_ap").alias("ap_mean"), F.stddev_samp("macro_ap").alias("ap_sd"))
    raw = macro(label_metrics(risk, ["model", "code"]), ["model"]).select(
        "model", F.col("macro_auroc").alias("auroc_pooled"), F.col("macro_ap").alias("ap_pooled"))
    ranked = within_fold_rank(rows).filter("at_risk = 1")
    norm = macro(label_metrics(ranked, ["model", "code"], p="p_rank"), ["model"]).select(
        "model", F.col("macro_auroc").alias("auroc_rank"), F.col("macro_ap").alias("ap_rank"))
    return folds.join(raw, "model").join(norm, "model")


# ---------------------------------------------------------------- calibration measures


def murphy(rows: DataFrame, by: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Brier score and its reliability, resolution and uncertainty parts over at-risk pairs."""
    by = list(by)
    binned = rows.filter("at_risk = 1").withColumn("bin", F.least(F.floor(F.col("p") * n_bins), F.lit(n_bins - 1)))
    err = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    cells = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("pk"), F.avg("y").alias("ok"),
                                           F.sum("y").alias("pos"), F.sum(err).alias("err"))
    # At most n_bins rows a group meet in this window.
    group = W.partitionBy(*by)
    based = cells.withColumn("base", F.sum("pos").over(group) / F.sum("n").over(group))
    gap = lambda x, y: F.sum(F.col("n") * (F.col(x) - F.col(y)) * (F.col(x) - F.col(y))) / F.sum("n")
    parts = based.groupBy(*by).agg(
        (F.sum("err") / F.sum("n")).alias("brier"), gap("pk", "ok").alias("rel"), gap("ok", "base").alias("res"),
        F.max(F.col("base") * (F.lit(1.0) - F.col("base"))).alias("unc"))
    return parts.select("*", (F.lit(1.0) - F.try_divide("brier", "unc")).alias("bss"),
                        F.when(F.col("res") > 0, F.try_divide("rel", "res")).alias("rel_over_res"))


def calibration_ratio(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean prediction against observed rate, score range, and floored against not-at-risk pairs."""
    floored = F.when(F.col("at_risk") == 1, F.col("p")).otherwise(F.lit(EPS))
    out = rows.groupBy(*by).agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg(floored).alias("mean_p"), F.avg("y").alias("mean_y"),
        F.count_if(floored <= 1.5 * EPS).alias("n_floored"), F.count_if(F.col("at_risk") == 0).alias("n_expected"))
    return out.withColumn("ratio", F.col("mean_p") / F.greatest(F.col("mean_y"), F.lit(1e-9)))


def masked_log_loss(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean binary cross-entropy over at-risk pairs."""
    q = clip_prob("p")
    loss = -(F.col("y") * F.log(q) + (F.lit(1) - F.col("y")) * F.log(F.lit(1.0) - q))
    return rows.groupBy(*by).agg(
        (F.sum(loss * F.col("at_risk")) / F.greatest(F.sum("at_risk"), F.lit(1))).alias("log_loss"))


def best_epoch_replay(log: DataFrame, min_delta: float = 0.002) -> DataFrame:
    """The epoch a run would keep: scanned in order, better only by more than ``min_delta``.

    ``log`` holds (run, t, epoch, ap) rows; the latest row of a (run, epoch) counts. The
    scanned list has one entry per epoch of one run.
    """
    latest = log.groupBy("run", "epoch").agg(F.max_by("ap", F.struct("t", "ap")).alias("ap"))
    steps = latest.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "ap"))).alias("steps"))
    start = F.struct(F.lit(0).cast("int").alias("epoch"), F.lit(-1.0).alias("ap"))
    better = lambda best, s: F.when(s["ap"] > best["ap"] + min_delta,
                                    F.struct(s["epoch"].cast("int").alias("epoch"), s["ap"].alias("ap"))).otherwise(best)
    best = F.aggregate("steps", start, better)
    return steps.select("run", best["epoch"].alias("best_epoch"), best["ap"].alias("best_ap"),
                        F.size("steps").alias("n_epochs"))


def length_stats(lengths: DataFrame, by: Sequence[str], cap: int) -> DataFrame:
    """Median and p90 of sequence length, share at the cap, share of unknown tokens."""
    spread = exact_quantiles(lengths, by, "length", [0.5, 0.9])
    shares = lengths.groupBy(*by).agg(
        F.avg((F.col("length") >= cap).cast("int")).alias("at_cap"),
        F.try_divide(F.sum("n_unknown"), F.sum("length")).alias("unknown_share"))
    return spread.join(shares, list(by)).select(
        *by, F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("p90"), "at_cap", "unknown_share")
