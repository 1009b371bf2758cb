"""Where records end relative to the outcome window, and how often a held-out set was looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.config import Span
from tidemark.operators.distributed import beside, exact_quantiles, single_group

# Fixed value: macro AUROC noise of one evaluation.
SIGMA_MACRO_AUROC = 0.0104


def censoring_report(cohort: DataFrame, events: DataFrame, window: Span) -> DataFrame:
    """Follow-up from anchor to the last event by split; short means under 99.8 % of the window."""
    last = events.groupBy("subject_id").agg(F.max("ts").alias("last"))
    if window.unit == "year":
        follow, least = F.datediff("last", "anchor") / F.lit(365.25), window.n - 0.01
    else:
        follow, least = F.datediff("last", "anchor").cast("double"), float(window.n)
    rows = cohort.join(last, "subject_id").select("split", follow.alias("follow_up"))
    spread = exact_quantiles(rows, ["split"], "follow_up", [0.0, 0.5, 1.0])
    counts = rows.groupBy("split").agg(F.count_if(F.col("follow_up") < least).alias("n_short"))
    return spread.join(counts, "split").select(
        "split", "n", "n_short", F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("med"),
        F.col("quantiles")[2].alias("hi"))


def anchor_selection_report(cohort: DataFrame, terminal: DataFrame, held_out: str = "test") -> DataFrame:
    """How close the terminal event (subject_id, terminal) lies to the end of the window."""
    seen = cohort.filter(F.col("split") != held_out).join(terminal, "subject_id", "left")
    gap = F.datediff("terminal", "window_end")
    rows = single_group(seen.withColumn("gap", gap), "subject_id")
    near = lambda days: F.avg((F.abs("gap") <= days).cast("int"))
    shares = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count("terminal").alias("n_terminal"),
        near(30).alias("within_30"), near(365).alias("within_365"),
        F.count_if(F.col("terminal").between(F.col("anchor"), F.col("window_end"))).alias("n_inside"))
    middle = exact_quantiles(rows, ["_all"], "gap", [0.5]).select(F.col("quantiles")[0].alias("median_gap"))
    return beside(shares, middle)


def selection_ledger(ledger: DataFrame, metric: str = "macro_auroc", sigma: float = SIGMA_MACRO_AUROC,
                     text: str = "value") -> DataFrame:
    """Evaluations and distinct candidates in a JSON-lines ledger, with the bound sigma*sqrt(2 ln M).

    A key counts when its part after the last slash is the metric; the part before it, or else
    the run, names the candidate.
    """
    parsed = ledger.select(F.from_json(text, "map<string,string>").alias("_map"))
    keys = parsed.select(F.col("_map")["run"].alias("run"), F.explode(F.map_keys("_map")).alias("key"))
    looks = keys.filter(F.substring_index("key", "/", -1) == metric)
    model = F.when(F.col("key").contains("/"), F.regexp_replace("key", "/[^/]*$", "")).otherwise(F.col("run"))
    candidates = looks.groupBy("run", model.alias("model")).agg(F.count(F.lit(1)).alias("n"))
    counts = candidates.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_evaluations"),
                            F.count(F.lit(1)).alias("n_candidates"))
    bound = lambda m: F.when(F.col(m) > 1, F.lit(sigma) * F.sqrt(F.lit(2.0) * F.log(F.col(m)))).otherwise(F.lit(0.0))
    return counts.select("*", bound("n_candidates").alias("bound_candidates"),
                         bound("n_evaluations").alias("bound_evaluations"))
