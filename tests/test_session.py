"""What Spark may broadcast, by sizes it takes for granted."""

from pyspark.sql import functions as F

from tidemark.config import Span, TimelineSpec
from tidemark.operators import labels as L
from tidemark.session import configure, small_table
from tidemark.sources.materialise import keep
from tidemark.sources.tables import scan_targets


def _size(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_rows_of_the_driver_have_a_known_size(spark):
    rows = [(1, "a", None), (2, "b", 0.5)]
    found = small_table(spark, rows, "n bigint, code string, w double")
    assert sorted(map(tuple, found.collect())) == rows and found.dtypes == [("n", "bigint"), ("code", "string"), ("w", "double")]
    assert _size(found) < 1_000
    assert small_table(spark, [], "n bigint, code string").count() == 0


def test_events_are_not_shuffled_to_look_up_targets(spark):
    configure(spark)
    events = keep(spark.range(1_000).selectExpr("id subject_id", "'T' kind", "cast(id % 50 as string) code", "timestamp_ntz'2020-01-01' ts"), "events")
    spec = TimelineSpec(Span(1), "V", ("V", "T"), target_kind="T")
    first = L.first_ever(events, scan_targets(spark, [str(i) for i in range(25)]), spec)
    assert first.count() == 500
    assert "SortMergeJoin" not in first._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_when_read_are_not_broadcast(spark):
    """Rows that pack well on disk, and rows made by explode, are far larger than the file they come from."""
    configure(spark)
    flat = keep(spark.range(200_000).selectExpr("id", "id % 7 as a", "repeat('x', 100) as b"), "flat")
    assert _size(flat) > 10 << 20
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) <= 1 << 20
    exploded = flat.select("a", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("k"))
    joined = exploded.join(flat.groupBy("a").count(), "a")
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_a_lower_limit_stays(spark):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit, held in (("-1", "-1"), ("1000", "1000"), ("100m", str(1 << 20))):
            spark.conf.set(key, limit)
            configure(spark)
            assert spark.conf.get(key) == held
    finally:
        spark.conf.set(key, before)
