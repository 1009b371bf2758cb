"""The score table comes from one pass over the events, shuffled once a subject."""

from tidemark.operators import models
from tidemark.sources.demo import Purchases

FOLDER = "/root/testdata/sf0.001"


def test_scores_place_events_once(spark):
    a = Purchases(spark, FOLDER)
    plan = a._scores()._jdf.queryExecution().optimizedPlan().toString()
    # Boundaries are gathered once to place the events and once to place the cutoffs.
    assert plan.count("collect_set(") <= 2, plan


def test_scores_have_one_row_a_subject_brand_and_model(spark):
    a = Purchases(spark, FOLDER)
    rows = a.scores.select("subject_id", "code", "model")
    assert rows.count() == rows.distinct().count() == a.cohort.count() * 25 * 2


def test_oof_counts_show_repeats_and_missing_subjects(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", None, "x"), ("b", 1, "y")]
    got = {r["model"]: tuple(r)[2:] for r in models.oof_counts(spark.createDataFrame(rows, "model string, subject_id long, code string")).collect()}
    assert got == {"a": (4, 2, 1), "b": (1, 1, 0)}
