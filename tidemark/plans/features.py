"""Fitted statistics and point-in-time feature blocks as runnable queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.scalars import as_day, tidy
from tidemark.operators import features as FE, stats as ST
from tidemark.plans import core  # noqa: F401  (defines the timeline fragments)
from tidemark.plans.catalog import fragment, query, with_fragments as wf
from tidemark.sources.demo import Activity, Purchases

DAY = "cast(cutoff as date)::varchar cutoff"


def _shared(t: str, windows: tuple[int, int], rate: int, cap: int, kinds: tuple[str, ...]) -> None:
    """SQL twins of the fitted statistics and blocks, for one timeline."""
    w1, w2 = windows
    fragment(f"{t}_scope_events", f"""
        select * from {t}_events where is_pre_anchor and subject_id in (select subject_id from {t}_scope)""")
    fragment(f"{t}_vocab", f"""
        select token, count(distinct subject_id) n_subjects from {t}_scope_events group by 1
        having count(distinct subject_id) >= 5""")
    fragment(f"{t}_edges", f"""
        select token, list_sort(list_distinct(list_transform(qs, lambda x: round(x, 9)))) edges, n from (
          select token, quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) qs, count(*) n
          from {t}_scope_events where value is not null group by 1)
        where len(list_distinct(list_transform(qs, lambda x: round(x, 9)))) >= 2""")
    fragment(f"{t}_labs", f"""
        select token, n_subjects, n_subjects / n::double coverage from (
          select token, count(distinct subject_id) n_subjects from {t}_scope_events where value is not null group by 1),
          (select count(*) n from {t}_scope) where n_subjects / n::double >= 0.05""")
    fragment(f"{t}_pre", f"""
        select r.subject_id, r.cutoff, e.ts, e.kind, e.token, e.value, e.cost,
               date_diff('microsecond', e.ts, r.cutoff) / 8.64e10 age
        from {t}_rolling r join {t}_events e on r.subject_id = e.subject_id and e.ts < r.cutoff
        where e.is_pre_anchor and e.token in (select token from {t}_vocab)""")
    fragment(f"{t}_ages", f"""
        select subject_id, cutoff, date_diff('microsecond', birthdate, cutoff) / 8.64e10 / 365.25 age
        from {t}_rolling join {t}_cohort using (subject_id)""")
    fragment(f"{t}_age_fit", f"""
        select avg(age) mu, stddev_pop(age) + 1e-9 sd from {t}_ages where subject_id in (select subject_id from {t}_scope)""")
    fragment(f"{t}_counts", f"""
        select subject_id, cutoff, token, count(*) filter (age <= {w1}) n1, count(*) filter (age <= {w2}) n2, count(*) n3
        from {t}_pre group by all""")
    fragment(f"{t}_deciles", f"""
        select subject_id, cutoff, token, least(len(list_filter(edges, lambda x: x <= value)), 9)::int bin, count(*) n
        from {t}_pre join {t}_edges using (token) where value is not null group by all""")
    fragment(f"{t}_history", f"""
        select subject_id, cutoff, count(*)::double n, count(distinct ts)::double d, count(distinct token)::double tk,
               max(age) - min(age) span, min(age) recency, count(*) filter (age <= {rate})::double recent
               {''.join(f", count(*) filter (kind = '{k}')::double k_{k}" for k in kinds)}
        from {t}_pre group by all""")
    parts = {
        "log_n_events": "ln(1 + coalesce(n, 0))", "log_n_days": "ln(1 + coalesce(d, 0))",
        "log_n_distinct_tokens": "ln(1 + coalesce(tk, 0))", "history_span_years": "coalesce(span, 0) / 365.25",
        "log_days_since_last": f"ln(1 + coalesce(recency, {cap}))", "log_rate_recent": "ln(1 + coalesce(recent, 0) / 2)",
        "events_per_active_day": "coalesce(n, 0) / greatest(coalesce(d, 0), 1)",
        **{f"frac_{k}": f"coalesce(k_{k}, 0) / greatest(coalesce(n, 0), 1)" for k in kinds},
    }
    fragment(f"{t}_shape", f"""
        select r.subject_id, r.cutoff, {', '.join(f'{e} "{c}"' for c, e in parts.items())}
        from {t}_rolling r left join {t}_history h using (subject_id, cutoff)""")
    fragment(f"{t}_last", f"""
        select subject_id, cutoff, token, arg_max(value, (ts, value)) as last from {t}_pre
        where value is not null and token in (select token from {t}_labs) group by all""")
    fragment(f"{t}_last_fit", f"""
        select token, avg(last) mu, stddev_pop(last) + 1e-9 sd from {t}_last
        where subject_id in (select subject_id from {t}_scope) group by 1""")
    fragment(f"{t}_reasons", f"select distinct reason from {t}_scope_events where reason is not null")
    fragment(f"{t}_reason_counts", f"""
        select subject_id, cutoff, reason, count(*) filter (age <= {w1}) n1, count(*) filter (age <= {w2}) n2, count(*) n3
        from (select r.subject_id, r.cutoff, reason, date_diff('microsecond', ts, cutoff) / 8.64e10 age
              from {t}_rolling r join {t}_events e on r.subject_id = e.subject_id and ts < cutoff
              where is_pre_anchor and reason in (select reason from {t}_reasons)) group by all""")
    fragment(f"{t}_slopes", f"""
        select subject_id, cutoff, token,
               case when count(distinct ts) > 1 then regr_slope(value, -age / 365.25) end slope
        from {t}_pre where value is not null and token in (select token from {t}_labs) group by all""")
    fragment(f"{t}_tracked", f"""
        select token from {t}_vocab where token in ({_targets(t)}) union
        select token from (select token from {t}_vocab order by n_subjects desc, token limit 5)""")
    fragment(f"{t}_since", f"""
        select r.subject_id, r.cutoff, t.token, least(coalesce(min(age), {cap}), {cap}) / 365.25 since
        from {t}_rolling r cross join {t}_tracked t left join {t}_pre p using (subject_id, cutoff, token) group by all""")
    fragment(f"{t}_cost", f"""
        select r.subject_id, r.cutoff, {', '.join(
            f'ln(1 + coalesce(sum(cost) filter ({c}), 0)) "cost_log_total[{n}]", '
            f'coalesce(sum(cost) filter ({c}), 0) / greatest(count(cost) filter ({c}), 1) "cost_mean[{n}]"'
            for n, c in ((f'{w1}d', f'age <= {w1}'), (f'{w2}d', f'age <= {w2}'), ('ever', 'true')))}
        from {t}_rolling r left join {t}_pre p using (subject_id, cutoff) group by all""")
    fragment(f"{t}_shape_long", f"""
        unpivot {t}_shape on {', '.join(f'"{c}"' for c in parts)} into name feature value v""")
    fragment(f"{t}_resid_rows", f"""
        select s.subject_id, s.cutoff, feature, v, a.age - mu x from {t}_shape_long s
        join {t}_ages a using (subject_id, cutoff), {t}_age_fit""")
    fragment(f"{t}_resid_sums", f"""
        select feature, sum(1.0::double) s0, sum(x) s1, sum(x*x) s2, sum(x**3) s3, sum(x**4) s4,
               sum(v) t0, sum(v*x) t1, sum(v*x*x) t2
        from {t}_resid_rows where subject_id in (select subject_id from {t}_scope) group by 1""")
    det = lambda a, b, c, d, e, f, g, h, i: f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"
    fragment(f"{t}_resid_fit", f"""
        select feature, {det('t0','s1','s2','t1','s2','s3','t2','s3','s4')} / dd c0,
               {det('s0','t0','s2','s1','t1','s3','s2','t2','s4')} / dd c1,
               {det('s0','s1','t0','s1','s2','t1','s2','s3','t2')} / dd c2
        from (select *, {det('s0','s1','s2','s1','s2','s3','s2','s3','s4')} dd from {t}_resid_sums)""")
    fragment(f"{t}_resid", f"""
        select subject_id, cutoff, 'resid_age:' || feature feature, v - (c0 + c1 * x + c2 * x * x) v
        from {t}_resid_rows join {t}_resid_fit using (feature)""")


def _targets(t: str) -> str:
    return "select 'ITEM_' || code from a_targets" if t == "a" else "select 'purchase_' || i from (select unnest(range(10)) i)"


_shared("a", (365, 1825), 730, 3650, ("ORD", "ITEM"))
_shared("b", (1, 7), 3, 30, ("view", "signup", "click", "purchase", "error"))


def _day(df):
    return df.withColumn("cutoff", as_day("cutoff"))


def _tidy(df, *names):
    for n in names:
        df = df.withColumn(n, tidy(n))
    return df


# ---------------------------------------------------------------- fitted statistics


@query("F0_fit_scope", wf("""
    select count(*) n_scope, count(*) filter (subject_id % 2 = 0) n_even from a_scope
    where subject_id not in (select subject_id from a_cohort where split <> 'train')"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    scope = ST.check_scope(a.scope, a.cohort)
    return scope.agg(F.count("*").alias("n_scope"), F.count_if(F.col("subject_id") % 2 == 0).alias("n_even"))


@query("F1_fit_vocabulary", wf("""
    select token, count(distinct subject_id) n_subjects from b_scope_events group by 1
    having count(distinct subject_id) >= 80"""))
def _(spark, folder):
    b = Activity(spark, folder)
    return ST.fit_vocabulary(b.events, b.scope, replace(b.feature_cfg, min_subjects=80))


@query("P10_kind_filter", wf("""
    select token, count(distinct subject_id) n_subjects from b_scope_events where kind in ('click', 'error') group by 1
    having count(distinct subject_id) >= 5"""))
def _(spark, folder):
    """A vocabulary of two kinds only."""
    b = Activity(spark, folder)
    return ST.fit_vocabulary(b.events, b.scope, replace(b.feature_cfg, min_subjects=5, kinds=("click", "error")))


@query("F2_fit_value_edges", wf("""
    select token, n, array_to_string(list_transform(edges, lambda x: round(x * 10000)::bigint), ' ') edges from b_edges
    union all select token, n, array_to_string(list_transform(edges, lambda x: round(x * 10000)::bigint), ' ') from a_edges"""))
def _(spark, folder):
    a, b = Purchases(spark, folder), Activity(spark, folder)
    both = ST.fit_value_edges(b.events, b.scope, b.feature_cfg).unionByName(
        ST.fit_value_edges(a.events, a.scope, a.feature_cfg))
    text = F.array_join(F.transform("edges", lambda e: F.round(e * 10000).cast("bigint").cast("string")), " ")
    return both.select("token", "n", text.alias("edges"))


@query("F3_lab_coverage", wf("select token, n_subjects, round(coverage, 6) + 0.0 coverage from b_labs"))
def _(spark, folder):
    b = Activity(spark, folder)
    return _tidy(ST.lab_coverage(b.events, b.scope, b.feature_cfg), "coverage")


@query("F4_point_in_time_expand", wf("""
    select subject_id, cutoff::varchar cutoff, kind, token, count(*) n, round(sum(age), 3) + 0.0 age_sum
    from b_pre group by all"""))
def _(spark, folder):
    """Totals of the (event, cutoff) pairs, without ever forming the pairs."""
    b = Activity(spark, folder)
    n, last = F.sum("n"), F.sum("moved")
    origin = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    placed = FE.place_events(b.usable, b.rolling)
    since = FE.days_between(origin, F.col("ts"))
    cells = placed.groupBy("subject_id", "kind", "token", "seg").agg(F.count("*").alias("n"), F.sum(since).alias("moved"))
    out = FE.roll_up(cells, b.rolling, ["kind", "token"], [n.alias("n"), last.alias("moved")])
    age = F.col("n") * FE.days_between(origin, F.col("cutoff")) - F.col("moved")
    return out.select("subject_id", F.col("cutoff").cast("string").alias("cutoff"), "kind", "token", "n",
                      tidy(age, 3).alias("age_sum"))


# ---------------------------------------------------------------- blocks


@query("F5_nested_counts", wf(f'select subject_id, {DAY}, token, n1 "n_365d", n2 "n_1825d", n3 n_ever from a_counts'))
def _(spark, folder):
    a = Purchases(spark, folder)
    return _day(FE.nested_counts(a.cells, a.rolling, a.feature_cfg))


@query("F5_nested_counts_days", wf(f'select subject_id, {DAY}, token, n1 "n_1d", n2 "n_7d", n3 n_ever from b_counts'))
def _(spark, folder):
    b = Activity(spark, folder)
    return _day(FE.nested_counts(b.cells, b.rolling, b.feature_cfg))


@query("F6_value_decile_counts", wf(f"select subject_id, {DAY}, token, bin, n from b_deciles"))
def _(spark, folder):
    b = Activity(spark, folder)
    return _day(FE.value_decile_counts(b.usable, b.rolling, b.fitted.edges, b.feature_cfg))


@query("F7_prevalent_block", wf(f"""
    select subject_id, {DAY}, 'C_prevalent' block, 'prev:' || code feature, 1.0::double as value
    from a_rolling_labels where prevalent = 1"""))
def _(spark, folder):
    return _day(FE.prevalent_block(Purchases(spark, folder).rolling_labels))


fragment("b_demo", """
    select r.subject_id, r.cutoff, 'device_' || case when v in (select coalesce(device, 'MISSING') from b_cohort
        where subject_id in (select subject_id from b_scope)) then v else 'OTHER' end feature, 1.0::double v
    from b_rolling r join (select subject_id, coalesce(device, 'MISSING') v from b_cohort) using (subject_id)
    union all select subject_id, cutoff, 'age_z', (age - mu) / sd from b_ages, b_age_fit
    union all select subject_id, cutoff, 'age_z_sq', ((age - mu) / sd) ** 2 from b_ages, b_age_fit""")


@query("F8_demographics", wf(f"select subject_id, {DAY}, feature, round(v, 6) + 0.0 as value from b_demo"))
def _(spark, folder):
    b = Activity(spark, folder)
    return _tidy(_day(FE.demographics_block(b.rolling, b.cohort, b.scope, b.spec.demographics)), "value").drop("block")


def _shape_sql(t, kinds):
    names = ["log_n_events", "log_n_days", "log_n_distinct_tokens", "history_span_years", "log_days_since_last",
             "log_rate_recent", "events_per_active_day", *[f"frac_{k}" for k in kinds]]
    return wf(f"select subject_id, {DAY}, {', '.join(f'round({n}, 6) + 0.0 {n}' for n in names)} from {t}_shape")


def _shape(tl):
    shape = FE.history_shape(tl.usable, tl.cells, tl.rolling, tl.feature_cfg)
    return _tidy(_day(shape), *[c for c in shape.columns if c not in FE.KEY])


@query("F9_history_shape", _shape_sql("a", ("ORD", "ITEM")))
def _(spark, folder):
    return _shape(Purchases(spark, folder))


@query("F9_history_shape_days", _shape_sql("b", ("view", "signup", "click", "purchase", "error")))
def _(spark, folder):
    return _shape(Activity(spark, folder))


@query("F10_lab_last", wf(f"""
    select subject_id, {DAY}, token, round(last, 6) + 0.0 as last, round((last - mu) / sd, 6) + 0.0 z
    from b_last join b_last_fit using (token)"""))
def _(spark, folder):
    b = Activity(spark, folder)
    return _tidy(_day(FE.lab_last(b.cells, b.rolling, b.labs, b.scope, b.feature_cfg)), "last", "z")


@query("F11_reason_counts", wf(f'select subject_id, {DAY}, reason, n1 "n_365d", n2 "n_1825d", n3 n_ever from a_reason_counts'))
def _(spark, folder):
    a = Purchases(spark, folder)
    return _day(FE.reason_counts(a.events, a.rolling, a.fitted.reasons, a.feature_cfg))


@query("F12_lab_slope", wf(f"select subject_id, {DAY}, token, round(slope + 1e-7, 4) + 0.0 slope from a_slopes"))
def _(spark, folder):
    a = Purchases(spark, folder)
    return _day(FE.lab_slope(a.cells, a.rolling, a.labs, a.feature_cfg)).withColumn("slope", tidy(F.col("slope") + 1e-7, 4))


@query("F13_time_since_last", wf(f"select subject_id, {DAY}, token, round(since, 6) + 0.0 since from a_since"))
def _(spark, folder):
    a = Purchases(spark, folder)
    tracked = FE.tracked_tokens(a.vocabulary, a.target_tokens, a.feature_cfg)
    return _tidy(_day(FE.time_since_last(a.cells, a.rolling, tracked, a.feature_cfg)).withColumnRenamed("years", "since"), "since")


def _cost_sql(t, names):
    cols = [f"cost_log_total[{n}]" for n in names] + [f"cost_mean[{n}]" for n in names]
    return wf(f"""select subject_id, {DAY}, {', '.join(f'round("{c}" + 1e-9, 6) + 0.0 "{c}"' for c in cols)} from {t}_cost""")


@query("F14_cost_windows", _cost_sql("a", ("365d", "1825d", "ever")))
def _(spark, folder):
    a = Purchases(spark, folder)
    cost = FE.cost_windows(a.cells, a.rolling, a.feature_cfg)
    return _day(cost).select("subject_id", "cutoff", *[tidy(F.col(f"`{c}`") + 1e-9).alias(c) for c in cost.columns if c not in FE.KEY])


@query("F15_age_residual", wf(f"select subject_id, {DAY}, feature, round(v, 6) + 0.0 as value from a_resid"))
def _(spark, folder):
    a = Purchases(spark, folder)
    return _tidy(_day(FE.age_residual(a.shape, FE.example_ages(a.rolling, a.cohort), a.scope)), "value").drop("block")


# ---------------------------------------------------------------- whole matrix

_A_COUNTS = "\n union all ".join(
    f"select subject_id, cutoff, 'A{i}_counts_{n}' block, 'cnt[{n}]:' || token feature, n{i + 1}::double v from a_counts where n{i + 1} > 0"
    for i, n in enumerate(("365d", "1825d", "ever")))
_A_REASONS = "\n union all ".join(
    f"select subject_id, cutoff, 'G{i}_reason_{n}', 'rsn[{n}]:' || reason, n{i + 1}::double from a_reason_counts where n{i + 1} > 0"
    for i, n in enumerate(("365d", "1825d", "ever")))
fragment("a_demo_values", """
    select subject_id, 'segment' col, segment v from a_cohort union all
    select subject_id, 'nation', nation from a_cohort union all select subject_id, 'region', region from a_cohort""")
fragment("a_demo", """
    select r.subject_id, r.cutoff, col || '_' || case when (col, v) in (select (col, v) from a_demo_values
        where subject_id in (select subject_id from a_scope)) then v else 'OTHER' end feature, 1.0::double v
    from a_rolling r join a_demo_values using (subject_id)
    union all select subject_id, cutoff, 'age_z', (age - mu) / sd from a_ages, a_age_fit
    union all select subject_id, cutoff, 'age_z_sq', ((age - mu) / sd) ** 2 from a_ages, a_age_fit""")
fragment("a_features", f"""
    {_A_COUNTS}
    union all select subject_id, cutoff, 'B_value_deciles', 'dec:' || token || ':Q' || bin, n::double from a_deciles
    union all select subject_id, cutoff, 'C_prevalent', 'prev:' || code, 1 from a_rolling_labels where prevalent = 1
    union all select subject_id, cutoff, 'D_demographics', feature, v from a_demo
    union all select subject_id, cutoff, 'E_history_shape', feature, v from a_shape_long
    union all select subject_id, cutoff, 'F_lab_last', 'lab_last_z:' || token, (last - mu) / sd
              from a_last join a_last_fit using (token)
    union all select subject_id, cutoff, 'F_lab_last', 'lab_seen:' || token, 1 from a_last
    union all {_A_REASONS}
    union all select r.subject_id, r.cutoff, 'H_lab_slope', 'lab_slope:' || l.token, slope
              from a_rolling r cross join a_labs l left join a_slopes s using (subject_id, cutoff, token)
    union all select subject_id, cutoff, 'I_time_since', 'time_since_y:' || token, since from a_since
    union all select subject_id, cutoff, 'J_cost', feature, v from a_cost_long
    union all select subject_id, cutoff, 'K_age_residual', feature, v from a_resid""")
fragment("a_cost_long", """
    unpivot a_cost on "cost_log_total[365d]", "cost_mean[365d]", "cost_log_total[1825d]", "cost_mean[1825d]",
                      "cost_log_total[ever]", "cost_mean[ever]" into name feature value v""")
# One text per value keeps the comparison of columns free of the last floating-point digits.
fragment("a_features_text", """
    select *, case when v is null then 'null' else (round(v * 100000)::bigint)::varchar end txt from a_features
    where v is null or round(v * 100000) <> 0""")


fragment("a_signatures", """
    select block, feature, string_agg(subject_id || '@' || cutoff || '=' || txt, ';' order by subject_id, cutoff) sig
    from a_features_text group by all""")
fragment("a_shown", """
    select block, feature, count(*) c, min(round(v * 100000)) lo, max(round(v * 100000)) hi from a_features
    where subject_id in (select subject_id from a_scope) group by all""")
fragment("a_scope_size", "select count(*) n from a_rolling where subject_id in (select subject_id from a_scope)")
fragment("a_varied", """
    select block, feature from a_shown, a_scope_size
    where case when c < n then least(lo, 0) else lo end < case when c < n then greatest(hi, 0) else hi end""")


@query("F16_dedupe_features", wf("""
    select min(bf).block block, min(bf).feature feature from (
      select sig, {'block': block, 'feature': feature} bf from a_signatures join a_varied using (block, feature))
    group by sig"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    snapped = F.round(F.col("value") * 100000)
    return FE.dedupe_features(a.features.withColumn("value", snapped), a.rolling, a.scope)


@query("F17_assemble_features", wf("""
    select block, feature, count(*) n, count(v)::bigint n_value, round(coalesce(sum(v), 0), 3) + 0.0 total,
           round(min(v), 5) + 0.0 lo, round(max(v), 5) + 0.0 hi from a_features group by all"""))
def _(spark, folder):
    return Purchases(spark, folder).features.groupBy("block", "feature").agg(
        F.count("*").alias("n"), F.count("value").alias("n_value"),
        tidy(F.coalesce(F.sum("value"), F.lit(0.0)), 3).alias("total"),
        tidy(F.min("value"), 5).alias("lo"), tidy(F.max("value"), 5).alias("hi"))


@query("F17_feature_index", wf("""
    select block, feature, (row_number() over (order by block, feature) - 1)::int "index"
    from (select distinct block, feature from a_features)"""))
def _(spark, folder):
    return ST.rank_features(Purchases(spark, folder).features)


@query("F18_feature_subset", wf(f"""
    select subject_id, {DAY}, feature, round(v, 5) + 0.0 as value from a_features
    where feature in ('age_z', 'age_z_sq', 'log_n_distinct_tokens')"""))
def _(spark, folder):
    kept = FE.feature_subset(Purchases(spark, folder).features, ["age_z", "age_z_sq", "log_n_distinct_tokens"])
    return _day(kept).select("subject_id", "cutoff", "feature", tidy("value", 5).alias("value"))


fragment("a_scaling", """
    select feature, median, case when peak > 0 then peak else 1 end peak from (
      select feature, coalesce(any_value(m), 0) median, max(abs(ln(1 + greatest(coalesce(v, m, 0), 0)))) peak from (
        select feature, v, case when bool_or(v is null) over (partition by feature)
               then quantile_cont(v, 0.5) over (partition by feature) end m
        from a_features where subject_id in (select subject_id from a_scope)) group by feature)""")


@query("F19_model_scaling", wf(f"""
    select feature, count(*) n, round(sum(ln(1 + greatest(coalesce(v, median), 0)) / peak), 3) + 0.0 total,
           round(max(ln(1 + greatest(coalesce(v, median), 0)) / peak), 5) + 0.0 hi
    from a_features join a_scaling using (feature) group by feature"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    scaled = ST.apply_scaling(a.features, ST.fit_scaling(a.features, a.rolling, a.scope))
    return scaled.groupBy("feature").agg(F.count("*").alias("n"), tidy(F.sum("value"), 3).alias("total"),
                                         tidy(F.max("value"), 5).alias("hi"))
