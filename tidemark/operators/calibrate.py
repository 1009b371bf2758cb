"""Per-code logistic calibration in logit space, all codes at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidemark.config import EPS
from tidemark.functions.scalars import logit, sigmoid
from tidemark.operators.metrics import label_metrics, macro
from tidemark.sources.materialise import keep

# Fixed value: inverse penalty on the slope.
_C = 1e6


def platt_points(rows: DataFrame, min_pos: int = 5) -> DataFrame:
    """Distinct (code, x) with total weight and smoothed target mass, for codes with enough of both classes."""
    risk = rows.filter("at_risk = 1").select("code", logit("p").alias("x"), "y")
    points = risk.groupBy("code", "x").agg(F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg"))
    sizes = points.groupBy("code").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    enough = sizes.filter((F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_pos))
    high = (F.col("n_pos") + 1.0) / (F.col("n_pos") + 2.0)
    low = F.lit(1.0) / (F.col("n_neg") + 2.0)
    return points.join(enough, "code").select(
        "code", "x", (F.col("pos") + F.col("neg")).alias("w"), (F.col("pos") * high + F.col("neg") * low).alias("t"))


def fit_platt(rows: DataFrame, min_pos: int = 5, allow_negative: bool = True, max_steps: int = 60,
              tol: float = 1e-9) -> DataFrame:
    """(code, a, b, ok) of ``sigmoid(a * logit(p) + b)`` by safeguarded Newton steps.

    Scores collapse to distinct points once. The search of every code is a row of a table; a step is one
    aggregate over the points and one join, stored before the next, and only whether any code
    still moves reaches the driver. Codes with too few positives or negatives, or with a slope of
    the unwanted sign, get a = 1, b = 0, ok = false and pass through.
    """
    points = keep(platt_points(rows, min_pos), "platt_points")
    zero, far = F.lit(0.0), F.lit(math.inf)
    state = points.select("code").distinct().select(
        "code", F.lit(1.0).alias("a"), zero.alias("b"), F.lit(1.0).alias("best_a"), zero.alias("best_b"), far.alias("loss"),
        zero.alias("step_a"), zero.alias("step_b"), far.alias("moved"))
    for _ in range(max_steps):
        state = keep(_advance(points, state, tol), "platt_state")
        if not state.filter(F.col("moved") > tol).take(1):
            break
    finite = lambda c: F.abs(F.col(c)) < math.inf
    fitted = state.select("code", "best_a", "best_b", (
        finite("best_a") & finite("best_b") & (F.lit(allow_negative) | (F.col("best_a") > 0))).alias("fine"))
    ok = F.coalesce("fine", F.lit(False))
    return rows.select("code").distinct().join(fitted, "code", "left").select(
        "code", F.when(ok, F.col("best_a")).otherwise(F.lit(1.0)).alias("a"),
        F.when(ok, F.col("best_b")).otherwise(zero).alias("b"), ok.alias("ok"))


def _advance(points: DataFrame, state: DataFrame, tol: float) -> DataFrame:
    """One Newton step on the two parameters of every code that still moves; a step that raised the loss is halved."""
    moving = state.filter(F.col("moved") > tol)
    seen = moving.join(_sums(points, moving), "code")
    a, best = F.col("a"), F.col("loss")
    loss = F.col("s.loss") + a * a / (2.0 * _C)
    better = loss <= best + F.when(best < math.inf, 1e-12 * F.abs(best)).otherwise(F.lit(0.0))
    ga, haa = F.col("s.rx") + a / _C, F.col("s.hxx") + 1.0 / _C
    det = haa * F.col("s.h") - F.col("s.hx") * F.col("s.hx")
    solvable = (det > 0.0) & (det < math.inf)
    newton = (F.when(solvable, F.try_divide(F.col("s.h") * ga - F.col("s.hx") * F.col("s.r"), det)).otherwise(ga),
              F.when(solvable, F.try_divide(haa * F.col("s.r") - F.col("s.hx") * ga, det)).otherwise(F.col("s.r")))
    pick = lambda yes, no: F.when(better, yes).otherwise(no)
    out = seen.select("code", pick(a, F.col("best_a")).alias("best_a"), pick(F.col("b"), F.col("best_b")).alias("best_b"),
                      pick(loss, best).alias("loss"), pick(newton[0], F.col("step_a") / 2.0).alias("_sa"),
                      pick(newton[1], F.col("step_b") / 2.0).alias("_sb"))
    size = F.greatest(F.abs("_sa"), F.abs("_sb"))
    still = size < math.inf  # false for infinite and undefined steps, which end the search
    step = lambda c: F.when(still, F.col(c)).otherwise(F.lit(0.0))
    out = out.select("code", (F.col("best_a") - step("_sa")).alias("a"), (F.col("best_b") - step("_sb")).alias("b"), "best_a", "best_b", "loss",
                     step("_sa").alias("step_a"), step("_sb").alias("step_b"), F.when(still, size).otherwise(F.lit(0.0)).alias("moved"))
    return out.unionByName(state.filter(F.col("moved") <= tol))


def _sums(points: DataFrame, trial: DataFrame) -> DataFrame:
    """(code, s): loss, gradient and curvature sums of every code at its trial parameters."""
    z = F.col("a") * F.col("x") + F.col("b")
    joined = points.join(trial.select("code", "a", "b"), "code").withColumn("z", z).withColumn("q", sigmoid("z"))
    # log(1 + exp(z)) without overflow on either side.
    soft = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
    r, h = F.col("w") * F.col("q") - F.col("t"), F.col("w") * F.col("q") * (F.lit(1.0) - F.col("q"))
    x = F.col("x")
    return joined.groupBy("code").agg(
        F.sum(F.col("w") * soft - F.col("t") * F.col("z")).alias("loss"), F.sum(r).alias("r"), F.sum(r * x).alias("rx"),
        F.sum(h).alias("h"), F.sum(h * x).alias("hx"), F.sum(h * x * x).alias("hxx")).select(
        "code", F.struct("loss", "r", "rx", "h", "hx", "hxx").alias("s"))


def apply_platt(rows: DataFrame, params: DataFrame, floor: float = EPS) -> DataFrame:
    """Map ``p``; codes without a fit pass through, pairs not at risk return to the floor."""
    mapped = sigmoid(F.col("a") * logit("p") + F.col("b"))
    p = F.when(F.col("at_risk") == 0, F.lit(floor)).when(F.col("ok"), mapped).otherwise(F.col("p"))
    return rows.join(params, "code", "left").withColumn("p", p).drop("a", "b", "ok")


def noop_check(before: DataFrame, after: DataFrame, params: DataFrame) -> DataFrame:
    """Macro metrics before and after over the codes whose map increases, and their difference."""
    rising = params.filter("a > 0").select("code")
    tagged = before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))
    mine = tagged.filter("at_risk = 1").join(rising, "code", "left_semi")
    rows = macro(label_metrics(mine, ["stage", "code"]), ["stage"])
    pick = lambda s, c: F.max(F.when(F.col("stage") == s, F.col(c)))
    return rows.agg(*[e for c in ("macro_ap", "macro_auroc") for e in (
        pick("before", c).alias(c), F.abs(pick("after", c) - pick("before", c)).alias(f"d_{c}"))])
