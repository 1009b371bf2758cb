"""Splits and folds grouped by subject, all from one seeded md5 permutation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.distributed import hash_rank
from tidemark.sources.materialise import keep

SPLIT_SEED = 12345


def grouped_folds(subjects: DataFrame, n_splits: int = 5, seed: int = SPLIT_SEED, contiguous: bool = True) -> DataFrame:
    """(subject_id, fold): blocks of the permutation with edges round(i * n / K), or dealt round-robin."""
    ranked = hash_rank(subjects.select("subject_id").distinct(), "subject_id", seed)
    if contiguous:
        edges = F.array(*[F.bround(F.lit(float(i)) * F.col("rank_n") / n_splits) for i in range(n_splits)])
        fold = F.size(F.filter(edges, lambda e: e <= F.col("rank"))) - 1
    else:
        fold = F.col("rank") % n_splits
    return ranked.select("subject_id", fold.cast("int").alias("fold"))


def fold_roles(examples: DataFrame, folds: DataFrame, n_splits: int = 5) -> DataFrame:
    """Each pooled example once per fold k, as ``fit`` or, where real and held out, as ``oof``."""
    pooled = examples.join(folds, "subject_id")
    each = pooled.withColumn("k_fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    held = F.col("fold") == F.col("k_fold")
    role = F.when(~held, F.lit("fit")).when(F.col("is_real"), F.lit("oof"))
    return each.withColumn("role", role).filter(F.col("role").isNotNull())


def repeat_seed(repeat: int) -> int:
    return SPLIT_SEED + 1000 * repeat


def holdout_carve(subjects: DataFrame, n: int, seed: int = SPLIT_SEED) -> DataFrame:
    """(subject_id, part): the last n of the permutation are ``locked``, the rest ``pool``; n may be 0."""
    ranked = hash_rank(subjects.select("subject_id").distinct(), "subject_id", seed)
    locked = F.col("rank") >= F.col("rank_n") - F.lit(n)
    return ranked.select("subject_id", F.when(locked, F.lit("locked")).otherwise(F.lit("pool")).alias("part"))


def inner_split(subjects: DataFrame, dev: float, holdout: float, seed: int = SPLIT_SEED) -> DataFrame:
    """(subject_id, part): the first fractions of the permutation are ``dev`` and ``holdout``."""
    ranked = hash_rank(subjects.select("subject_id").distinct(), "subject_id", seed)
    n_dev = F.bround(F.lit(dev) * F.col("rank_n"))
    n_hold = F.bround(F.lit(holdout) * F.col("rank_n"))
    part = F.when(F.col("rank") < n_dev, "dev").when(F.col("rank") < n_dev + n_hold, "holdout").otherwise("fit")
    return ranked.select("subject_id", part.alias("part"))


def stratified_folds(labels: DataFrame, n_splits: int = 5, seed: int = SPLIT_SEED) -> DataFrame:
    """(subject_id, stratum, fold): subjects dealt stratum by stratum, the stratum being their rarest positive code.

    Strata follow one another from the rarest on (subjects without positives last) and the
    deal runs on across them, so fold sizes differ by at most one, as do those of any stratum.
    """
    positives = labels.filter("y = 1").select("subject_id", "code").distinct()
    totals = positives.groupBy("code").agg(F.count(F.lit(1)).alias("total"))
    rarest = positives.join(totals, "code").groupBy("subject_id").agg(F.min(F.struct("total", "code")).alias("r"))
    everyone = labels.select("subject_id").distinct().join(rarest, "subject_id", "left").select(
        "subject_id", F.coalesce(F.col("r.total"), F.lit(2**62)).alias("total"),
        F.coalesce(F.col("r.code"), F.lit("~none")).alias("stratum"))
    ranked = hash_rank(everyone, "subject_id", seed, ["total", "stratum"])
    sizes = everyone.groupBy("total", "stratum").agg(F.count(F.lit(1)).alias("_n"))
    # One row per declared code.
    order = W.partitionBy(F.lit(0)).orderBy("total", "stratum").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("total", "stratum", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    dealt = ranked.join(starts, ["total", "stratum"])
    return dealt.select("subject_id", "stratum", ((F.col("_start") + F.col("rank")) % n_splits).cast("int").alias("fold"))


def fold_shares(n: int, need: Sequence[float], size: Sequence[int]) -> list[int]:
    """How many of ``n`` subjects each fold gets if every one goes to the fold in most need, ties to the emptiest, then the first.

    A fold's need falls by one with each subject, so all places above a level of need are given at once; the level is
    searched, and only the last few places are dealt one by one.
    """
    above = lambda level: [max(0, math.ceil(x - level)) for x in need]
    low, high = min(need) - n - 1.0, max(need)
    while high - low > 1e-6:  # closer, rounding would tell equal needs apart
        middle = (low + high) / 2
        low, high = (middle, high) if sum(above(middle)) > n else (low, middle)
    taken = above(high)
    while sum(taken) < n:
        f = min(range(len(need)), key=lambda f: (-round(need[f] - taken[f], 9), size[f] + taken[f], f))
        taken[f] += 1
    return taken


def iterative_folds(labels: DataFrame, n_splits: int = 5, seed: int = SPLIT_SEED) -> DataFrame:
    """(subject_id, fold): iterative stratification over all codes at once (Sechidis and others, 2011).

    A table (fold, code) holds how many positives each fold still needs. From the rarest code on, the subjects of that code
    that have no fold yet go to the folds in most need of it, and count for all their codes; those without a positive
    go to the emptiest. A code is one round: its subjects are dealt in one job, in the order of their md5, and only
    (fold, code) counts reach the driver. Equal codes go by name.
    """
    positives = keep(labels.filter("y = 1").select("subject_id", "code").distinct(), "positives")
    open_ = keep(labels.select("subject_id").distinct(), "open")
    totals = sorted((r["n"], r["code"]) for r in positives.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect())
    need = {code: [n / n_splits] * n_splits for n, code in totals}
    size, parts = [0] * n_splits, []

    def deal(subjects: DataFrame, wanted: Sequence[float]) -> DataFrame | None:
        ranked = keep(hash_rank(subjects, "subject_id", seed), "ranked")
        n = ranked.count()
        if not n:
            return None
        ends = list(accumulate(fold_shares(n, wanted, size)))
        fold = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("rank"))).cast("int")
        parts.append(ranked.select("subject_id", fold.alias("fold")))
        for r in parts[-1].groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect():
            size[r["fold"]] += r["n"]
        return parts[-1]

    for _, code in totals:
        dealt = deal(open_.join(positives.filter(F.col("code") == code), "subject_id", "left_semi"), need[code])
        if dealt is None:
            continue
        for r in positives.join(dealt, "subject_id").groupBy("fold", "code").agg(F.count(F.lit(1)).alias("n")).collect():
            need[r["code"]][r["fold"]] -= r["n"]
        open_ = keep(open_.join(dealt, "subject_id", "left_anti"), "open")
    deal(open_, [-s for s in size])
    return reduce(DataFrame.unionByName, parts) if parts else open_.withColumn("fold", F.lit(0))


def fold_diagnostics(folds: DataFrame, labels: DataFrame) -> DataFrame:
    """Per fold: subjects, and the positives of its scarcest and of all codes."""
    joined = labels.join(folds.select("subject_id", "fold"), "subject_id")
    per_code = joined.groupBy("fold", "code").agg(F.sum("y").alias("pos"))
    spread = per_code.groupBy("fold").agg(F.min("pos").alias("min_positives"), F.sum("pos").alias("n_positives"),
                                          F.count_if(F.col("pos") == 0).alias("n_empty_codes"))
    return folds.groupBy("fold").agg(F.countDistinct("subject_id").alias("n_subjects")).join(spread, "fold")


def fold_overlap(assigned: DataFrame, column: str = "fold") -> DataFrame:
    """Subjects that occur under more than one fold (or split). Must be empty."""
    seen = assigned.select("subject_id", column).distinct().groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_parts"))
    return seen.filter("n_parts > 1")


def split_disjointness(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(subject_id, side) of every subject on only one of two lists, or on two splits of the first."""
    ids = lambda df: df.select("subject_id").distinct()
    return (ids(listed).join(ids(found), "subject_id", "left_anti").withColumn("side", F.lit("listed only"))
            .unionByName(ids(found).join(ids(listed), "subject_id", "left_anti").withColumn("side", F.lit("found only")))
            .unionByName(fold_overlap(listed, "split").select("subject_id").withColumn("side", F.lit("two splits"))))
