"""Sources, scalar derivations, cohort, examples and labels as runnable queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.config import FeatureConfig, Span
from tidemark.functions import scalars as S, time as TM
from tidemark.functions.scalars import as_day, tidy
from tidemark.operators import diagnostics as D, examples as E, labels as L, timeline as TL
from tidemark.plans.catalog import draw_sql, fragment, query, with_fragments as wf
from tidemark.session import checkpoint_dir
from tidemark.sources.demo import Activity, Driver, Purchases
from tidemark.sources.materialise import materialise
from tidemark.sources.tables import (
    EVENT_TABLES, read_targets, scan_anchors, scan_event_table, scan_splits, scan_subjects, scan_text_answers, split_differences)

SPLIT_SQL = ("case {h} % 10 when 0 then 'test' when 1 then 'val' else 'train' end"
             .format(h=draw_sql("'split'", "subject_id")))

# ---------------------------------------------------------------- fixtures in SQL
fragment("a_visits", """
    select o_custkey subject_id, o_orderdate ts, case when o_orderstatus <> 'F' then o_orderdate end stop,
           'ORD' kind, o_orderpriority code, 'ORD_' || o_orderpriority token, null::double as value,
           false is_numeric, null::varchar reason, o_totalprice cost from orders""")
fragment("a_items", """
    select o_custkey subject_id, o_orderdate ts, null::timestamp stop, 'ITEM' kind, p_brand code,
           'ITEM_' || p_brand token, l_quantity as value, true is_numeric, p_type reason, l_extendedprice cost
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""")
fragment("a_derived", """
    select subject_id, max(coalesce(stop, ts)) last_visit,
           date_trunc('day', max(coalesce(stop, ts)) - interval 2 year)::timestamp derived_anchor
    from a_visits group by subject_id""")
fragment("a_splits", f"select distinct subject_id, {SPLIT_SQL} split from a_visits")
fragment("a_cohort", """
    select subject_id, split, birthdate, anchor,
           case when split <> 'test' then anchor + interval 2 year end window_end,
           case when split = 'test' then 'provided' else 'derived' end anchor_source,
           date_diff('day', birthdate, anchor) / 365.25::double age_at_anchor, segment, nation, region
    from (select s.subject_id, split,
                 case when split = 'test' then derived_anchor + interval 30 day else derived_anchor end anchor,
                 make_date(1930 + c_custkey % 60, 1 + c_custkey % 12, 1)::timestamp birthdate,
                 c_mktsegment segment, n_name nation, r_name region
          from a_splits s join a_derived d using (subject_id) join customer on c_custkey = s.subject_id
          join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""")
fragment("a_events", """
    select e.*, e.ts < c.anchor is_pre_anchor, case kind when 'ORD' then 0 else 1 end kind_rank, ts ts_seq
    from (select * from a_visits union all select * from a_items) e join a_cohort c using (subject_id)""")
fragment("a_examples", """
    select subject_id, anchor cutoff, anchor + interval 2 year window_end, split, true is_real, 0 k from a_cohort""")
fragment("a_rolling", """
    select * from a_examples union all
    select subject_id, cutoff, cutoff + interval 2 year, split, false, k from (
      select c.subject_id, split, k, date_trunc('day', anchor - to_years(k))::timestamp cutoff
      from a_cohort c, (select unnest(range(1, 40))::int k) where split = 'train') c
    where (select count(*) from a_events e where e.subject_id = c.subject_id and e.ts < c.cutoff) >= 10""")
fragment("a_targets", "select 'Brand#' || i code, i - 1 as position from (select unnest(range(1, 26)) i)")
fragment("a_first", "select subject_id, code, min(ts) as first from a_items group by all")
fragment("a_labels", """
    select subject_id, cutoff, split, is_real, t.code,
           case when first between cutoff and window_end then 1 else 0 end y,
           case when first < cutoff then 1 else 0 end prevalent,
           case when first < cutoff then 0 else 1 end at_risk
    from a_examples e cross join a_targets t left join a_first f using (subject_id, code)""")
fragment("a_rolling_labels", """
    select subject_id, cutoff, split, is_real, t.code,
           case when first between cutoff and window_end then 1 else 0 end y,
           case when first < cutoff then 1 else 0 end prevalent,
           case when first < cutoff then 0 else 1 end at_risk
    from a_rolling e cross join a_targets t left join a_first f using (subject_id, code)""")
fragment("a_scope", "select subject_id from a_cohort where split = 'train'")

fragment("b_raw", """
    select user_id subject_id, case event_type when 'signup' then date_trunc('day', ts)::timestamp else ts end ts,
           event_type kind, (json_extract_string(props, '$.k')::int) k, value v from events""")
fragment("b_derived", """
    select subject_id, max(ts) last_visit, date_trunc('day', max(ts) - interval 7 day)::timestamp derived_anchor
    from b_raw group by subject_id""")
fragment("b_cohort", f"""
    select subject_id, split, birthdate, anchor,
           case when split <> 'test' then anchor + interval 7 day end window_end,
           case when split = 'test' then 'provided' else 'derived' end anchor_source,
           date_diff('day', birthdate, anchor) / 365.25::double age_at_anchor, device
    from (select subject_id, split,
                 case when split = 'test' then derived_anchor + interval 30 day else derived_anchor end anchor,
                 make_date(1950 + subject_id % 50, 1 + subject_id % 12, 1)::timestamp birthdate,
                 case when subject_id % 7 = 0 then null else 'd' || (subject_id % 3) end device
          from (select *, {SPLIT_SQL} split from b_derived))""")
fragment("b_first_visit", """
    select subject_id, ts::date d, min(ts) first_visit from b_raw where kind = 'view' group by all""")
fragment("b_events", """
    select r.subject_id, r.ts, kind, (k % 10)::varchar code, kind || '_' || (k % 10) token,
           case when kind <> 'error' then v end as value, kind <> 'error' is_numeric,
           case when kind <> 'click' then (k // 10)::varchar end reason, v * 2 cost,
           r.ts < anchor is_pre_anchor,
           list_position(['view', 'signup', 'click', 'purchase', 'error'], kind) - 1 kind_rank,
           case when kind = 'signup' then coalesce(first_visit, r.ts) else r.ts end ts_seq
    from b_raw r join b_cohort c on c.subject_id = r.subject_id
    left join b_first_visit f on f.subject_id = r.subject_id and f.d = r.ts::date""")
fragment("b_examples", """
    select subject_id, anchor cutoff, anchor + interval 7 day window_end, split, true is_real, 0 k from b_cohort""")
fragment("b_rolling", """
    select * from b_examples union all
    select subject_id, cutoff, cutoff + interval 7 day, split, false, k from (
      select c.subject_id, split, k, date_trunc('day', anchor - to_days(7 * k))::timestamp cutoff
      from b_cohort c, (select unnest(range(1, 60))::int k) where split = 'train') c
    where (select count(*) from b_events e where e.subject_id = c.subject_id and e.ts < c.cutoff) >= 10""")
fragment("b_scope", "select subject_id from b_cohort where split = 'train'")

# ---------------------------------------------------------------- sources


@query("S1_scan_event_table", wf("""
    select kind, code, count(*) n, cast(min(ts) as varchar) first_ts, cast(max(ts) as varchar) last_ts,
           count(value)::bigint n_value, count(reason)::bigint n_reason, round(sum(cost), 2) + 0.0 cost,
           count(stop)::bigint n_stop
    from (select * from a_visits union all select * from a_items) group by kind, code"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    both = a.tables[0].unionByName(a.tables[1])
    return both.groupBy("kind", "code").agg(
        F.count("*").alias("n"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"),
        F.count("value").alias("n_value"), F.count("reason").alias("n_reason"),
        tidy(F.sum("cost"), 2).alias("cost"), F.count("stop").alias("n_stop"))


@query("S3_scan_subjects_allowlist", """
    select c_mktsegment "MARITAL", count(*) n, count(distinct c_custkey) n_id from customer group by 1""")
def _(spark, folder):
    raw = Driver(spark, folder).table("customer").select(
        F.col("c_custkey").alias("Id"), F.lit("1970-01-01").alias("BIRTHDATE"), F.col("c_mktsegment").alias("MARITAL"),
        F.lit("r").alias("RACE"), F.lit("e").alias("ETHNICITY"), F.lit("F").alias("GENDER"),
        F.col("c_name").alias("FIRST"), F.col("c_acctbal").alias("HEALTHCARE_EXPENSES"))
    kept = scan_subjects(raw)
    return kept.groupBy("MARITAL").agg(F.count("*").alias("n"), F.countDistinct("Id").alias("n_id"))


@query("S7_scan_text_answers", wf("""
    select distinct subject_id, cast(ts as varchar) ts, 'error_' || (k % 10) token,
           min('code-' || (k // 25)) over (partition by subject_id, ts, k % 10) answer
    from b_raw where kind = 'error'"""))
def _(spark, folder):
    return Activity(spark, folder).answers.withColumn("ts", F.col("ts").cast("string"))


@query("S2_table_registry", """
    select 'OBS' kind, 'OBS_' || event_type token, count(*) n, round(sum(value), 4) + 0.0 total, 0.0::double cost from events group by event_type
    union all select 'ENC', 'ENC_' || o_orderstatus, count(*), 0.0, round(sum(o_totalprice), 4) + 0.0 from orders group by o_orderstatus""")
def _(spark, folder):
    """Two of the declared tables, filled from events and orders under their declared column names."""
    d = Driver(spark, folder)
    seen = d.table("events").select(F.col("user_id").alias("PATIENT"), F.col("ts").alias("DATE"), F.col("event_type").alias("CODE"),
                                    F.col("value").cast("string").alias("VALUE"), F.lit("numeric").alias("TYPE"))
    met = d.table("orders").select(F.col("o_custkey").alias("PATIENT"), F.col("o_orderdate").alias("START"), F.col("o_orderdate").alias("STOP"),
                                   F.col("o_orderstatus").alias("CODE"), F.lit("1.0").alias("REASONCODE"),
                                   F.col("o_totalprice").alias("TOTAL_CLAIM_COST"))
    both = scan_event_table(seen, EVENT_TABLES["observations"]).unionByName(scan_event_table(met, EVENT_TABLES["encounters"]))
    total = lambda c: tidy(F.coalesce(F.sum(c), F.lit(0.0)), 4)
    return both.groupBy("kind", "token").agg(F.count("*").alias("n"), total("value").alias("total"), total("cost").alias("cost"))


@query("S4_scan_splits", """
    select 's100' split, count(*) n, count(*) + 1 expected from customer where c_custkey % 101 = 100
    union all select 'unseen', null, 3""")
def _(spark, folder):
    """A list of 101 splits passes with its own sizes; of sizes that are wrong in two places those two are reported."""
    raw = Driver(spark, folder).table("customer").select(
        F.col("c_custkey").alias("Id"), F.concat(F.lit("s"), (F.col("c_custkey") % 101).cast("string")).alias("split"))
    sizes = {r["split"]: r["count"] for r in raw.groupBy("split").count().collect()}  # 101 rows at most
    splits = scan_splits(raw, sizes)
    return split_differences(splits, {**sizes, "s100": sizes["s100"] + 1, "unseen": 3})


@query("S5_read_targets", """
    select (row_number() over (order by p_partkey) - 1)::bigint as position, p_partkey::varchar code, p_brand description from part""")
def _(spark, folder):
    """Every part as a target code, written to CSV files in key order, a range each, and read in file order."""
    path = f"{checkpoint_dir(spark)}/tidemark/targets-{uuid.uuid4().hex}"
    part = Driver(spark, folder).table("part").select(F.col("p_partkey").alias("CODE"), F.col("p_brand").alias("DESCRIPTION"))
    part.repartitionByRange(8, "CODE").sortWithinPartitions("CODE").write.option("header", True).csv(path)
    return read_targets(spark, path)


@query("S6_scan_provided_anchors", """
    select o_custkey subject_id, cast(max(o_orderdate) as varchar) given_anchor from orders group by 1""")
def _(spark, folder):
    orders = Driver(spark, folder).table("orders")
    raw = orders.groupBy(F.col("o_custkey").alias("Id")).agg(F.max("o_orderdate").cast("string").alias("anchor_date"))
    return scan_anchors(raw).withColumn("given_anchor", F.col("given_anchor").cast("string"))


@query("S9_load_cohort", wf("""
    select 'cohort' part, count(*) n, count(distinct subject_id) n_subjects, true same_rows, true same_files from a_cohort
    union all select 'events', count(*), count(distinct subject_id), true, true from a_events
    union all select 'examples', count(*), count(distinct subject_id), true, true from a_rolling
    union all select 'labels', count(*), count(distinct subject_id), true, true from a_rolling_labels"""))
def _(spark, folder):
    """The four entry points, and again from a session that shares nothing but the stored tables: the same rows from the same files."""

    def facts(timeline):
        rows = []
        for part in timeline.ENTRY_POINTS:
            df = timeline.load(part)
            mix = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("mix")
            files = F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("_metadata.file_path"))), " "), 256).alias("files")
            rows.append(df.select("*", "_metadata").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"),
                                                         F.countDistinct("subject_id").alias("n_subjects"), mix, files))
        return reduce(DataFrame.unionByName, rows)

    found = facts(Purchases(spark, folder))
    seen = facts(Purchases(spark.newSession(), folder)).collect()  # a row for each of the four
    seen = spark.createDataFrame([(r["part"], r["mix"], r["files"]) for r in seen], "part string, mix2 string, files2 string")
    return found.join(seen, "part").select("part", "n", "n_subjects", F.col("mix").eqNullSafe(F.col("mix2")).alias("same_rows"),
                                           (F.col("files") == F.col("files2")).alias("same_files"))


@query("S10_config_tag", wf("""
    select 'one' config, count(*) n from b_raw where kind = 'click' union all
    select 'two', count(*) from b_raw where kind in ('click', 'view') union all
    select 'one again', count(*) from b_raw where kind = 'click'"""))
def _(spark, folder):
    """One stored name under two configurations: each finds its own table, and an equal one finds it again."""
    raw = Activity(spark, folder).raw
    out = []
    for label, kinds in (("one", ("click",)), ("two", ("click", "view")), ("one again", ("click",))):
        build = lambda kinds=kinds: raw.filter(F.col("event_type").isin(*kinds)).select("user_id", "event_type")
        table = materialise(spark, "query_tagged", build, [f"{folder}/events.parquet"], FeatureConfig(kinds=kinds))
        out.append(table.agg(F.lit(label).alias("config"), F.count("*").alias("n")))
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- scalar derivations


@query("P1_to_ts", """
    select style, count(*) n, cast(min(t) as varchar) lo, cast(max(t) as varchar) hi,
           sum(epoch(t) // 60)::bigint n_minutes from (
      select o_orderkey % 3 style, case o_orderkey % 3 when 0 then o_orderdate
             when 1 then o_orderdate + interval 13 hour + interval 5 minute
             else o_orderdate + interval 11 hour + interval 5 minute end t from orders) group by style""")
def _(spark, folder):
    o = Driver(spark, folder).table("orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    text = (F.when(F.col("o_orderkey") % 3 == 0, day)
            .when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T13:05:00Z")))
            .otherwise(F.concat(day, F.lit("T13:05:00+02:00"))))
    parsed = o.select((F.col("o_orderkey") % 3).alias("style"), TM.to_ts(text).alias("t"))
    minutes = F.floor(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("t")) / 60)
    return parsed.groupBy("style").agg(
        F.count("*").alias("n"), F.min("t").cast("string").alias("lo"), F.max("t").cast("string").alias("hi"),
        F.sum(minutes).alias("n_minutes"))


@query("P2_event_token", """
    select event_type || '_' || (json_extract_string(props, '$.k')::int) token, count(*) n from events group by 1""")
def _(spark, folder):
    ev = Driver(spark, folder).table("events")
    return ev.groupBy(S.event_token("event_type", F.get_json_object("props", "$.k")).alias("token")).agg(
        F.count("*").alias("n"))


@query("P3_numeric_value", wf("""
    select kind, count(*) n, count(case when kind <> 'error' then v end)::bigint n_value,
           coalesce(round(sum(case when kind <> 'error' then v end), 4), 0.0) + 0.0 total from b_raw group by kind"""))
def _(spark, folder):
    raw = Activity(spark, folder).raw.select("event_type", S.numeric_value("value", "value_type").alias("x"))
    return raw.groupBy(F.col("event_type").alias("kind")).agg(
        F.count("*").alias("n"), F.count("x").alias("n_value"),
        tidy(F.coalesce(F.sum("x"), F.lit(0.0)), 4).alias("total"))


@query("P4_normalise_reason_code", wf("""
    select case k % 6 when 0 then '16255561000119' || lpad(k::varchar, 3, '0') when 1 then '16255561000119' || lpad(k::varchar, 3, '0')
           when 2 then '962855561000119' || lpad(k::varchar, 3, '0') when 3 then k::varchar end reason, count(*) n from b_raw group by 1"""))
def _(spark, folder):
    """Codes of up to 18 digits with and without a zero fraction, and fractions and text, which are no codes."""
    raw = Activity(spark, folder).driver.table("events")
    k = F.get_json_object("props", "$.k").cast("int")
    padded = F.lpad(k.cast("string"), 3, "0")
    text = (F.when(k % 6 == 0, F.concat(F.lit("16255561000119"), padded)).when(k % 6 == 1, F.concat(F.lit("16255561000119"), padded, F.lit(".0")))
            .when(k % 6 == 2, F.concat(F.lit(" 962855561000119"), padded, F.lit(".00"))).when(k % 6 == 3, F.concat(k.cast("string"), F.lit(".")))
            .when(k % 6 == 4, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.lit("n/a")))
    return raw.groupBy(S.normalise_reason(text).alias("reason")).agg(F.count("*").alias("n"))


@query("P5_first_available_cost", """
    select l_returnflag flag, round(sum(case when l_linenumber % 3 = 0 then l_tax
             when l_linenumber % 3 = 1 then l_discount end), 4) + 0.0 total,
           count(case when l_linenumber % 3 <> 2 then 1 end) n from lineitem group by 1""")
def _(spark, folder):
    line = Driver(spark, folder).table("lineitem")
    turn = F.col("l_linenumber") % 3
    text = line.select("l_returnflag", F.when(turn == 0, F.col("l_tax").cast("string")).alias("c1"),
                       F.when(turn == 1, F.col("l_discount").cast("string")).alias("c2"))
    cost = S.first_cost("c1", "c2")
    return text.groupBy(F.col("l_returnflag").alias("flag")).agg(
        tidy(F.sum(cost), 4).alias("total"), F.count(cost).alias("n"))


@query("P6_is_pre_anchor", wf("""
    select kind, count(*) filter (is_pre_anchor) n_before, count(*) filter (not is_pre_anchor) n_after
    from a_events group by kind"""))
def _(spark, folder):
    return Purchases(spark, folder).events.groupBy("kind").agg(
        F.count_if("is_pre_anchor").alias("n_before"), F.count_if(~F.col("is_pre_anchor")).alias("n_after"))


@query("P7_kind_order", """
    select event_type kind, case event_type when 'purchase' then 0 when 'view' then 1 else 2 end rank, count(*) n from events group by all""")
def _(spark, folder):
    """Kinds in a declared order; those that are not declared come last."""
    events = Driver(spark, folder).table("events")
    return events.groupBy(F.col("event_type").alias("kind"), S.kind_rank("event_type", ("purchase", "view")).alias("rank")).agg(F.count("*").alias("n"))


@query("P8_age_at", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, round(age_at_anchor, 6) + 0.0 age_at_anchor,
           round(date_diff('microsecond', birthdate, cutoff) / 8.64e10 / 365.25, 6) + 0.0 age
    from a_rolling join a_cohort using (subject_id)"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    rows = a.rolling.select("subject_id", "cutoff").join(
        a.cohort.select("subject_id", "birthdate", "age_at_anchor"), "subject_id")
    return TL.age_at(rows).select("subject_id", as_day("cutoff").alias("cutoff"),
                                  tidy("age_at_anchor").alias("age_at_anchor"), tidy("age").alias("age"))


@query("P9_age_days", wf("""
    select subject_id, round(sum(date_diff('microsecond', ts, anchor) / 8.64e10), 3) + 0.0 age_sum,
           round(min(date_diff('microsecond', ts, anchor) / 8.64e10), 6) + 0.0 age_min
    from b_events join b_cohort using (subject_id) where is_pre_anchor group by subject_id"""))
def _(spark, folder):
    b = Activity(spark, folder)
    age = TM.days_between(F.col("ts"), F.col("anchor"))
    return (b.events.filter("is_pre_anchor").join(b.cohort.select("subject_id", "anchor"), "subject_id")
            .groupBy("subject_id").agg(tidy(F.sum(age), 3).alias("age_sum"), tidy(F.min(age)).alias("age_min")))


@query("P11_clip_logit_sigmoid", """
    select l_returnflag flag, round(sum(ln(q / (1 - q))), 4) + 0.0 logit_sum,
           round(sum(1 / (1 + exp(-(0.5 * ln(q / (1 - q)) + 0.1)))), 4) + 0.0 sigmoid_sum, round(min(q), 8) + 0.0 lo
    from (select l_returnflag, least(greatest(l_discount * 10, 1e-6), 1 - 1e-6) q from lineitem) group by 1""")
def _(spark, folder):
    p = F.col("l_discount") * 10
    return Driver(spark, folder).table("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        tidy(F.sum(S.logit(p)), 4).alias("logit_sum"),
        tidy(F.sum(S.sigmoid(S.logit(p) * 0.5 + 0.1)), 4).alias("sigmoid_sum"), tidy(F.min(S.clip_prob(p)), 8).alias("lo"))


@query("P12_name_clean", """
    select regexp_replace(nm, ' \\((disorder|finding|situation)\\)', '', 'g') clean,
           cast(regexp_matches(lower(nm), 'fracture|sprain|laceration|whiplash|concussion|sinusitis|bronchitis|pharyngitis|sore throat')
                and not contains(lower(nm), 'pathological') as int) acute, count(*) n
    from (select case when p_size % 4 = 0 then 'Pathological ' else '' end || p_name ||
          case p_size % 3 when 0 then ' Fracture (disorder)' when 1 then ' (finding)' else ' Sprain' end nm from part)
    group by 1, 2""")
def _(spark, folder):
    size = F.col("p_size")
    name = F.concat(
        F.when(size % 4 == 0, "Pathological ").otherwise(""), F.col("p_name"),
        F.when(size % 3 == 0, " Fracture (disorder)").when(size % 3 == 1, " (finding)").otherwise(" Sprain"))
    part = Driver(spark, folder).table("part").select(name.alias("nm"))
    return part.groupBy(S.clean_name("nm").alias("clean"), S.is_acute("nm").cast("int").alias("acute")).agg(
        F.count("*").alias("n"))


# ---------------------------------------------------------------- cohort and timeline


@query("C1_anchor_from_visits", wf("""
    select subject_id, cast(last_visit as date)::varchar last_visit, cast(derived_anchor as date)::varchar anchor
    from a_derived"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return TL.anchor_from_visits(a.visits, a.spec).select(
        "subject_id", as_day("last_visit").alias("last_visit"), as_day("derived_anchor").alias("anchor"))


@query("C2_anchor_override", wf("""
    select subject_id, split, cast(anchor as date)::varchar anchor, anchor_source from a_cohort"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    out = TL.anchor_override(TL.anchor_from_visits(a.visits, a.spec), a.splits, a.given_anchors)
    return out.withColumn("anchor", as_day("anchor"))


@query("C3_window_end", wf("""
    select subject_id, cast(window_end as date)::varchar window_end from a_cohort"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return TL.window_end(TL.anchor_override(TL.anchor_from_visits(a.visits, a.spec), a.splits, a.given_anchors),
                         a.spec).select("subject_id", as_day("window_end").alias("window_end"))


@query("C4_build_cohort", wf("""
    select subject_id, split, cast(birthdate as date)::varchar birthdate, cast(anchor as date)::varchar anchor,
           cast(window_end as date)::varchar window_end, anchor_source, round(age_at_anchor, 6) + 0.0 age_at_anchor,
           segment, nation, region from a_cohort"""))
def _(spark, folder):
    c = Purchases(spark, folder).cohort
    return (c.withColumn("birthdate", as_day("birthdate")).withColumn("anchor", as_day("anchor"))
            .withColumn("window_end", as_day("window_end")).withColumn("age_at_anchor", tidy("age_at_anchor")))


@query("C5_union_timeline", wf("""
    select subject_id, kind, token, count(*) n, count(*) filter (is_pre_anchor) n_pre,
           coalesce(sum(value), 0)::double as value, round(sum(cost), 2) + 0.0 cost from a_events group by all"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return TL.union_timeline(a.tables, a.cohort, a.spec).groupBy("subject_id", "kind", "token").agg(
        F.count("*").alias("n"), F.count_if("is_pre_anchor").alias("n_pre"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), tidy(F.sum("cost"), 2).alias("cost"))


@query("C6_snap_date_only", wf("""
    select subject_id, kind, cast(ts as varchar) ts, cast(ts_seq as varchar) ts_seq, token, count(*) n
    from b_events group by all"""))
def _(spark, folder):
    """All kinds: the date-only one moves to the day's first visit, the others stay."""
    return Activity(spark, folder).events.groupBy("subject_id", "kind", F.col("ts").cast("string").alias("ts"),
                           F.col("ts_seq").cast("string").alias("ts_seq"), "token").agg(F.count("*").alias("n"))


@query("C7_timeline_order", wf("""
    select subject_id, cast(ts_seq as varchar) ts_seq, kind_rank::int kind_rank, token, n,
           (coalesce(sum(n) over (partition by subject_id order by ts_seq, kind_rank, token
                                  rows between unbounded preceding and 1 preceding), 0))::bigint as position
    from (select subject_id, ts_seq, kind_rank, token, count(*) n from b_events group by all)"""))
def _(spark, folder):
    return TL.timeline_order(Activity(spark, folder).events).withColumn("ts_seq", F.col("ts_seq").cast("string"))


@query("C8_snap_invariants", wf("""
    select count(*) filter (ts_seq < ts) moved_back, count(*) filter (ts_seq::date <> ts::date) left_day,
           count(*) filter ((ts_seq < anchor) <> is_pre_anchor) crossed_anchor,
           count(*) filter (kind = 'signup' and ts <> date_trunc('day', ts)) not_midnight,
           count(*) filter (ts_seq > ts) n_snapped from b_events join b_cohort using (subject_id)"""))
def _(spark, folder):
    b = Activity(spark, folder)
    return TL.snap_invariants(b.events, b.cohort, b.spec)


# ---------------------------------------------------------------- examples


@query("E1_real_examples", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, cast(window_end as date)::varchar window_end, split,
           is_real::int is_real, k from a_examples"""))
def _(spark, folder):
    return _days(Purchases(spark, folder).examples)


def _days(examples):
    return examples.select("subject_id", as_day("cutoff").alias("cutoff"), as_day("window_end").alias("window_end"),
                           "split", F.col("is_real").cast("int").alias("is_real"), "k")


@query("E2_rolling_cutoffs", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, split, k from (
      select c.subject_id, split, k, date_trunc('day', anchor - to_years(k))::timestamp cutoff
      from a_cohort c, (select unnest(range(1, 40))::int k)) c
    join (select subject_id, min(ts) lo from a_events group by 1) f using (subject_id) where lo < cutoff"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return E.rolling_cutoffs(a.cohort, a.events, a.example_cfg).withColumn("cutoff", as_day("cutoff"))


@query("E3_min_history_filter", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, cast(window_end as date)::varchar window_end, split,
           is_real::int is_real, k from a_rolling"""))
def _(spark, folder):
    return _days(Purchases(spark, folder).rolling)


@query("E3_min_history_filter_days", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, cast(window_end as date)::varchar window_end, split,
           is_real::int is_real, k from b_rolling"""))
def _(spark, folder):
    return _days(Activity(spark, folder).rolling)


@query("E4_example_key", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, is_real::int is_real,
           row_number() over (partition by is_real order by md5('0,' || key), key) - 1
             + case when is_real then 0 else (select count(*) from a_examples) end eid
    from (select *, subject_id || '|' || cast(cutoff as varchar) as key from a_rolling)"""))
def _(spark, folder):
    keyed = E.example_key(Purchases(spark, folder).rolling)
    return keyed.select("subject_id", as_day("cutoff").alias("cutoff"), F.col("is_real").cast("int").alias("is_real"), "eid")


@query("E5_example_invariants", wf("""
    select count(*) filter (is_real and cutoff <> anchor) real_off_anchor,
           count(*) filter (not is_real and cutoff >= anchor) synthetic_not_earlier,
           count(*) filter (not is_real) n_synthetic,
           (select count(*) from (select subject_id from a_rolling where split <> 'train'
             group by 1 having count(*) > 1)) repeated_outside_augmented
    from a_rolling join a_cohort using (subject_id)"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return E.example_invariants(a.rolling, a.cohort, a.example_cfg)


@query("E6_anchor_relabel", wf("""
    select r.subject_id, cast(r.cutoff as date)::varchar cutoff, r.code, r.is_real::int is_real, p.y, p.at_risk
    from a_rolling_labels r join a_labels p using (subject_id, code)"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    labels = L.label_pairs(a.rolling, a.first, a.targets).drop("is_real")
    return (E.anchor_relabel(a.rolling, labels).withColumn("cutoff", as_day("cutoff"))
            .withColumn("is_real", F.col("is_real").cast("int")))


# ---------------------------------------------------------------- labels


@query("L1_first_ever", wf("select subject_id, code, cast(first as date)::varchar as first from a_first"))
def _(spark, folder):
    return Purchases(spark, folder).first.withColumn("first", as_day("first"))


@query("L2_incident_label", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, code, (first between cutoff and window_end)::int y,
           (first < cutoff)::int prevalent from a_examples join a_first using (subject_id)"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return L.incident_label(a.examples, a.first).select(
        "subject_id", as_day("cutoff").alias("cutoff"), "code", "y", "prevalent")


@query("L3_prevalent_flag", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, code, prevalent from a_rolling_labels where prevalent = 1"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return (L.incident_label(a.rolling, a.first).filter("prevalent = 1")
            .select("subject_id", as_day("cutoff").alias("cutoff"), "code", "prevalent"))


@query("L4_densify_labels", wf("""
    select subject_id, cast(cutoff as date)::varchar cutoff, split, is_real::int is_real, code, y, prevalent, at_risk
    from a_rolling_labels"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return (L.label_pairs(a.rolling, a.first, a.targets).withColumn("cutoff", as_day("cutoff"))
            .withColumn("is_real", F.col("is_real").cast("int")))


@query("L5_at_risk_mask", wf("""
    select subject_id, code, split, at_risk from a_labels"""))
def _(spark, folder):
    return Purchases(spark, folder).labels.select("subject_id", "code", "split", "at_risk")


@query("L6_label_invariants", wf("""
    select count(*) filter (y = 1 and prevalent = 1) n_both,
           count(*) filter (split = 'test' and y = 1) held_out_positive,
           count(*) filter (y = 1) n_incident, count(*) filter (prevalent = 1) n_prevalent,
           (select count(*) from a_examples join a_first using (subject_id) where first > window_end) past_edge,
           (select count(*) from a_examples join a_first using (subject_id) where first = window_end) on_edge
    from a_labels"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return L.label_invariants(a.labels, L.incident_label(a.examples, a.first))


@query("L7_recurrence_trap", wf("""
    select subject_id, code, count(*) filter (ts < anchor) n_before,
           count(*) filter (ts between anchor and window_end) n_recur
    from a_items join a_cohort using (subject_id) group by all
    having count(*) filter (ts < anchor) > 0 and count(*) filter (ts between anchor and window_end) > 0"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return L.recurrence_trap(a.events, a.cohort, a.targets, a.spec)


@query("L8_label_totals", wf("""
    select split, code, sum(y)::bigint n_incident, sum(prevalent)::bigint n_prevalent,
           sum(at_risk)::bigint n_at_risk, count(*) n_rows from a_labels group by all"""))
def _(spark, folder):
    return L.label_totals(Purchases(spark, folder).labels)


# ---------------------------------------------------------------- record-end diagnostics


@query("V14_censoring_report", wf("""
    select split, count(*) n, count(*) filter (fu < 1.99) n_short, round(min(fu), 6) + 0.0 lo,
           round(quantile_cont(fu, 0.5), 6) + 0.0 med, round(max(fu), 6) + 0.0 hi
    from (select split, date_diff('day', anchor, max(ts)) / 365.25::double fu
          from a_cohort join a_events using (subject_id) group by subject_id, split, anchor) group by split"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    out = D.censoring_report(a.cohort, a.events, a.spec.window)
    return out.select("split", "n", "n_short", tidy("lo").alias("lo"), tidy("med").alias("med"), tidy("hi").alias("hi"))


fragment("a_terminal", """
    select o_custkey subject_id, max(l_shipdate) terminal from lineitem join orders on l_orderkey = o_orderkey
    where l_returnflag = 'R' group by 1""")
fragment("a_terminal_gap", """
    select c.*, terminal, date_diff('day', window_end, terminal) gap
    from a_cohort c left join a_terminal using (subject_id) where split <> 'test'""")


@query("V15_anchor_selection_report", wf("""
    select count(*) n, count(terminal)::bigint n_terminal, round(quantile_cont(gap, 0.5), 6) + 0.0 median_gap,
           round(avg(case when gap is not null then (abs(gap) <= 30)::int end), 6) + 0.0 within_30,
           round(avg(case when gap is not null then (abs(gap) <= 365)::int end), 6) + 0.0 within_365,
           count(*) filter (terminal between anchor and window_end) n_inside from a_terminal_gap"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    returned = scan_event_table(a.shipments, a.ship_spec).filter(F.col("code") == "R")
    terminal = returned.groupBy("subject_id").agg(F.max("ts").alias("terminal"))
    out = D.anchor_selection_report(a.cohort, terminal)
    return out.select("n", "n_terminal", tidy("median_gap").alias("median_gap"), tidy("within_30").alias("within_30"),
                      tidy("within_365").alias("within_365"), "n_inside")
