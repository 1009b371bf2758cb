"""Planted frames for calendar edges, snapping, labels and point-in-time aggregation."""

from datetime import datetime as dt, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import ExampleConfig, FeatureConfig, Span, TableSpec, TimelineSpec, config_tag
from tidemark.functions import scalars as S
from tidemark.functions.time import to_ts
from tidemark.operators import examples as E, features as FE, labels as L, stats as ST, timeline as TL
from tidemark.operators.distributed import range_rank
from tidemark.sources.materialise import materialise
from tidemark.sources.tables import read_targets, scan_event_table, scan_subjects, scan_targets

SPEC = TimelineSpec(Span(5), "ENC", ("ENC", "COND"), ("COND",), "COND")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_parse_stamps(spark):
    df = frame(spark, [("2020-02-29",), ("2020-02-29T10:11:12Z",), ("2020-02-29T10:11:12+02:00",), (None,)], "s string")
    got = [r[0] for r in df.select(to_ts("s")).collect()]
    assert got == [dt(2020, 2, 29), dt(2020, 2, 29, 10, 11, 12), dt(2020, 2, 29, 8, 11, 12), None]
    with pytest.raises(Exception, match="unparsable"):
        frame(spark, [("yesterday",)], "s string").select(to_ts("s")).collect()


def test_scalar_edges(spark):
    df = frame(spark, [("444814009.0", "numeric", "1.5"), ("n/a", "text", "2"), (None, "numeric", "x")], "r string, t string, v string")
    got = df.select(S.normalise_reason("r").alias("r"), S.numeric_value("v", "t").alias("v")).collect()
    assert [(r.r, r.v) for r in got] == [("444814009", 1.5), (None, None), (None, None)]


def test_leap_day_anchor_and_closed_edges(spark):
    visits = frame(spark, [(1, dt(2016, 2, 29, 13), None), (2, dt(2015, 6, 1, 9), dt(2015, 6, 2, 9))],
                   "subject_id int, ts timestamp_ntz, stop timestamp_ntz")
    anchors = {r.subject_id: r.derived_anchor for r in TL.anchor_from_visits(visits, SPEC).collect()}
    assert anchors == {1: dt(2011, 2, 28), 2: dt(2010, 6, 2)}
    ex = frame(spark, [(2, dt(2010, 6, 2), dt(2015, 6, 2), "train", True)],
               "subject_id int, cutoff timestamp_ntz, window_end timestamp_ntz, split string, is_real boolean")
    first = frame(spark, [(2, "left", dt(2010, 6, 2)), (2, "right", dt(2015, 6, 2)), (2, "past", dt(2015, 6, 2, 0, 0, 1)),
                          (2, "before", dt(2010, 6, 1, 23, 59, 59))], "subject_id int, code string, first timestamp_ntz")
    got = {r.code: (r.y, r.prevalent) for r in L.label_pairs(ex, first, scan_targets(spark, ["left", "right", "past", "before", "never"])).collect()}
    assert got == {"left": (1, 0), "right": (1, 0), "past": (0, 0), "before": (0, 1), "never": (0, 0)}


def test_recurrence_is_prevalent_not_incident(spark):
    events = frame(spark, [(1, "COND", "a", dt(2000, 1, 1)), (1, "COND", "a", dt(2011, 1, 1))],
                   "subject_id int, kind string, code string, ts timestamp_ntz")
    cohort = frame(spark, [(1, dt(2010, 1, 1), dt(2015, 1, 1))], "subject_id int, anchor timestamp_ntz, window_end timestamp_ntz")
    targets = scan_targets(spark, ["a"])
    assert [(r.n_before, r.n_recur) for r in L.recurrence_trap(events, cohort, targets, SPEC).collect()] == [(1, 1)]


def test_snap_with_and_without_visit(spark):
    events = frame(spark, [(1, "COND", dt(2020, 1, 1)), (1, "ENC", dt(2020, 1, 1, 15)), (1, "ENC", dt(2020, 1, 1, 9)),
                           (1, "COND", dt(2020, 1, 2)), (2, "COND", dt(2020, 1, 1))], "subject_id int, kind string, ts timestamp_ntz")
    got = {(r.subject_id, r.ts): r.ts_seq for r in TL.snap_date_only(events, SPEC).filter("kind = 'COND'").collect()}
    assert got == {(1, dt(2020, 1, 1)): dt(2020, 1, 1, 9), (1, dt(2020, 1, 2)): dt(2020, 1, 2), (2, dt(2020, 1, 1)): dt(2020, 1, 1)}


def test_subject_allow_list(spark):
    raw = frame(spark, [("a", "b", "c")], "Id string, SSN string, RACE string")
    assert scan_subjects(raw, ["Id", "RACE"]).columns == ["Id", "RACE"]
    with pytest.raises(ValueError, match="SSN"):
        scan_subjects(raw, ["Id", "SSN"])


def test_text_source_codes_stay_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("DATE,PATIENT,CODE,VALUE,TYPE,DESCRIPTION\n2020-01-01,p1,0012,3.5,numeric,x\n2020-01-02,p1,0012,bad,numeric,x\n")
    from tidemark.sources.tables import read_text_table

    spec = TableSpec("obs", "OBS", "DATE", "CODE", value="VALUE", value_type="TYPE")
    rows = scan_event_table(read_text_table(spark, str(tmp_path / "t.csv"), spec.columns()), spec).orderBy("ts").collect()
    assert [(r.subject_id, r.token, r.value, r.is_numeric) for r in rows] == [("p1", "OBS_0012", 3.5, True), ("p1", "OBS_0012", None, True)]


def _hot_timeline(spark):
    """One subject holds most events; another has no history before its cutoff."""
    rows = []
    for i in range(2000):
        rows.append((1, dt(2000, 1, 1) + timedelta(days=i * 3 % 4000, hours=i % 24), f"T{i % 4}", float(i % 17)))
    for s in range(2, 8):
        for i in range(30):
            rows.append((s, dt(2001, 1, 1) + timedelta(days=i * 97 + s), f"T{i % 3}", float(i)))
    rows.append((9, dt(2012, 1, 1), "T0", 1.0))
    events = frame(spark, rows, "subject_id int, ts timestamp_ntz, token string, value double").withColumn("kind", F.lit("OBS"))
    events = events.withColumn("is_numeric", F.lit(True)).withColumn("cost", F.col("value")).withColumn("is_pre_anchor", F.lit(True))
    cut = [(s, dt(2010 - k, 6, 1)) for s in (1, 2, 3, 9) for k in range(6)]
    return rows, events, cut, frame(spark, cut, "subject_id int, cutoff timestamp_ntz")


def test_nested_counts_match_brute_force(spark):
    rows, events, cut, examples = _hot_timeline(spark)
    cfg = FeatureConfig(windows=(365.0, 1825.0), shape_kinds=("OBS",))
    got = {(r.subject_id, r.cutoff, r.token): (r.n_365d, r.n_1825d, r.n_ever)
           for r in FE.nested_counts(FE.event_cells(events, examples, cfg), examples, cfg).collect()}
    want = {}
    for s, c in cut:
        for sid, ts, token, _ in rows:
            if sid == s and ts < c:
                age = (c - ts).total_seconds() / 86400
                n = want.setdefault((s, c, token), [0, 0, 0])
                n[0] += age <= 365
                n[1] += age <= 1825
                n[2] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_slope_edges(spark):
    day = dt(2009, 1, 1)
    rows = [(1, day, "one", 5.0), (1, day, "same", 1.0), (1, day, "same", 9.0), (1, day, "two", 1.0), (1, day + timedelta(days=1), "two", 3.0)]
    events = frame(spark, rows, "subject_id int, ts timestamp_ntz, token string, value double").withColumn("kind", F.lit("OBS"))
    events = events.withColumn("is_numeric", F.lit(True)).withColumn("cost", F.lit(None).cast("double"))
    examples = frame(spark, [(1, dt(2010, 1, 1))], "subject_id int, cutoff timestamp_ntz")
    cfg = FeatureConfig()
    labs = frame(spark, [("one",), ("same",), ("two",)], "token string")
    got = {r.token: r.slope for r in FE.lab_slope(FE.event_cells(events, examples, cfg), examples, labs, cfg).collect()}
    assert got["one"] is None and got["same"] is None
    assert got["two"] == pytest.approx(2 * 365.25)


def test_edges_of_constant_and_binary_tokens(spark):
    rows = [(1, "const", 2.0)] * 30 + [(1, "binary", float(i % 2)) for i in range(30)] + [(1, "wide", float(i)) for i in range(30)]
    events = frame(spark, rows, "subject_id int, token string, value double").withColumn("is_numeric", F.lit(True))
    events = events.withColumn("is_pre_anchor", F.lit(True)).withColumn("kind", F.lit("OBS"))
    got = {r.token: r.edges for r in ST.fit_value_edges(events, frame(spark, [(1,)], "subject_id int"), FeatureConfig()).collect()}
    assert "const" not in got and len(got["wide"]) == 9
    assert got["binary"] == [0.0, 0.5, 1.0]


def test_scope_refuses_other_splits(spark):
    cohort = frame(spark, [(1, "train"), (2, "val")], "subject_id int, split string")
    with pytest.raises(ValueError, match="outside"):
        ST.check_scope(frame(spark, [(1,), (2,)], "subject_id int"), cohort)
    with pytest.raises(ValueError, match="empty"):
        ST.check_scope(frame(spark, [], "subject_id int"), cohort)


def test_rolling_examples_need_history(spark):
    cohort = frame(spark, [(1, dt(2020, 1, 1), "train"), (2, dt(2020, 1, 1), "val")], "subject_id int, anchor timestamp_ntz, split string")
    events = frame(spark, [(s, dt(2010, 1, 1) + timedelta(days=200 * i)) for s in (1, 2) for i in range(20)], "subject_id int, ts timestamp_ntz")
    cfg = ExampleConfig(Span(2), Span(2), 3, ("train",))
    got = sorted((r.subject_id, r.k) for r in E.build_examples(cohort, events, cfg).collect())
    want = [(1, 0)] + [(1, k) for k in range(1, 6) if sum(dt(2010, 1, 1) + timedelta(days=200 * i) < dt(2020 - 2 * k, 1, 1) for i in range(20)) >= 3]
    assert got == sorted([*want, (2, 0)])


def test_stored_table_rebuilds_only_when_stale(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(source).selectExpr("id + 1 as id")

    root = str(tmp_path / "store")
    for _ in range(2):
        assert materialise(spark, "t", build, [source], ExampleConfig(), root=root).count() == 3
    assert len(calls) == 1
    materialise(spark, "t", build, [source], ExampleConfig(min_events=11), root=root)
    assert len(calls) == 2
    spark.range(2).write.mode("append").parquet(source)
    assert materialise(spark, "t", build, [source], ExampleConfig(), root=root).count() == 5
    assert len(calls) == 3


def test_config_tag_covers_every_field():
    assert config_tag(ExampleConfig()) != config_tag(ExampleConfig(max_extra=3))
    assert config_tag(ExampleConfig()) != config_tag(ExampleConfig(augment_splits=("train",)))


def test_layout_spreads_a_hot_subject_in_order(spark):
    rows = [(1 if i % 3 else 2 + i % 5, dt(2020, 1, 1) + timedelta(minutes=i * 7919 % 5000), 0, f"T{i % 4}") for i in range(3000)]
    events = frame(spark, rows, "subject_id int, ts_seq timestamp_ntz, kind_rank int, token string")
    out = TL.timeline_layout(events, 8).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in out if r.subject_id == 1}) > 1
    for part in {r.part for r in out}:
        mine = [(r.subject_id, r.ts_seq, r.kind_rank, r.token) for r in out if r.part == part]
        assert mine == sorted(mine)


def test_positions_match_a_full_sort(spark):
    rows = [(1 if i % 3 else 2, dt(2020, 1, 1) + timedelta(hours=i * 37 % 200), i % 2, f"T{i % 4}") for i in range(600)]
    events = frame(spark, rows, "subject_id int, ts_seq timestamp_ntz, kind_rank int, token string")
    got = {(r.subject_id, r.ts_seq, r.kind_rank, r.token): r.position for r in TL.timeline_order(events).collect()}
    for s in (1, 2):
        ordered = sorted(r for r in rows if r[0] == s)
        for key in set(ordered):
            assert got[key] == ordered.index(key)


def test_changed_configuration_or_subjects_refit_a_fold(spark):
    from tidemark.operators.models import fold_key

    few, more = spark.range(10).withColumnRenamed("id", "subject_id"), spark.range(11).withColumnRenamed("id", "subject_id")
    assert fold_key(few, "a") == fold_key(few.repartition(3), "a")
    assert len({fold_key(few, "a"), fold_key(few, "b"), fold_key(more, "a")}) == 3


def test_targets_of_many_files_keep_file_order(spark, tmp_path):
    """Several files and blocks: positions follow the files by name and their lines, whatever task reads them."""
    lines = [f"c{(i * 7919) % 10_007}" for i in range(900)]
    for i in range(3):
        (tmp_path / f"part-{i}.csv").write_text("CODE,DESCRIPTION\n" + "".join(f"{c},d\n" for c in lines[i * 300:(i + 1) * 300]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = read_targets(spark, str(tmp_path)).orderBy("position")
        assert [r["code"] for r in got.collect()] == lines
        assert dict(got.dtypes)["position"] == "bigint"
        assert [r["position"] for r in got.select("position").collect()] == list(range(900))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "part-2.csv").write_text("CODE,DESCRIPTION\nc0,d\n")
    with pytest.raises(ValueError, match="repeat"):
        read_targets(spark, str(tmp_path))


def test_rank_of_all_rows_without_a_group(spark):
    rows = spark.range(1_000, numPartitions=7).withColumn("k", F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.hash("id").cast("string"))))
    got = {r["id"]: r["rank"] for r in range_rank(rows, [], ["k", "id"]).collect()}
    expected = [r["id"] for r in sorted(rows.collect(), key=lambda r: (r["k"] is not None, r["k"] or "", r["id"]))]
    assert [got[i] for i in expected] == list(range(1_000))
    assert range_rank(rows.limit(0), [], ["k", "id"]).collect() == []


def test_labels_are_multiplied_by_the_targets_after_the_last_join(spark):
    day = lambda n: dt(2020, 1, 1) + timedelta(days=n)
    examples = frame(spark, [(1, day(10), day(20), "train", True), (1, day(5), day(9), "train", False), (2, day(10), None, "test", True),
                             (3, day(10), day(20), "train", True)], "subject_id long, cutoff timestamp_ntz, window_end timestamp_ntz, split string, is_real boolean")
    first = frame(spark, [(1, "a", day(9)), (1, "b", day(20)), (2, "a", day(11)), (2, "b", day(1)), (9, "a", day(1))],
                  "subject_id long, code string, first timestamp_ntz")
    pairs = L.label_pairs(examples, first, frame(spark, [("a",), ("b",), ("c",)], "code string"))
    got = {(r["subject_id"], r["cutoff"], r["code"]): (r["y"], r["prevalent"], r["at_risk"]) for r in pairs.collect()}
    none, incident, prevalent = (0, 0, 1), (1, 0, 1), (0, 1, 0)
    assert got == {(1, day(10), "a"): prevalent, (1, day(10), "b"): incident, (1, day(10), "c"): none,
                   (1, day(5), "a"): incident, (1, day(5), "b"): none, (1, day(5), "c"): none,
                   (2, day(10), "a"): none, (2, day(10), "b"): prevalent, (2, day(10), "c"): none,
                   (3, day(10), "a"): none, (3, day(10), "b"): none, (3, day(10), "c"): none}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
