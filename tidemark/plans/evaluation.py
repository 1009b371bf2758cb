"""Folds, metrics, resampling and calibration as runnable queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.scalars import as_day, tidy
from tidemark.operators import calibrate as CA, diagnostics as D, distributed as DI, folds as FO, metrics as M, models as MO
from tidemark.plans import features  # noqa: F401  (defines the feature fragments)
from tidemark.plans.catalog import draw_sql, fragment, query, with_fragments as wf
from tidemark.sources.demo import Driver, Purchases
from tidemark.sources.materialise import keep

N_BOOT = 2_000


def _r(name: str, digits: int = 6, alias: str | None = None) -> str:
    return f"round({name}, {digits}) + 0.0 {alias or name}"


def _tidy(df, *names, digits: int = 6):
    for n in names:
        df = df.withColumn(n, tidy(n, digits))
    return df


# ---------------------------------------------------------------- folds

fragment("a_perm", """
    select subject_id, row_number() over (order by md5('12345,' || subject_id), subject_id) - 1 pos,
           count(*) over () n from a_scope""")
fragment("a_folds", """
    select subject_id, (len(list_filter([round_even(i * n / 5.0::double, 0) for i in range(5)], lambda e: e <= pos)) - 1)::int fold
    from a_perm""")


@query("K1_grouped_folds", wf("select subject_id, fold from a_folds"))
def _(spark, folder):
    return Purchases(spark, folder).folds


@query("K1_round_robin_folds", wf("select subject_id, (pos % 5)::int fold from a_perm"))
def _(spark, folder):
    return FO.grouped_folds(Purchases(spark, folder).scope, contiguous=False)


@query("K2_fold_masks", wf("""
    select k_fold, role, count(*) n, count(distinct subject_id) n_subjects from (
      select subject_id, kf::int k_fold, case when fold <> kf then 'fit' when is_real then 'oof' end role
      from a_rolling join a_folds using (subject_id), (select unnest(range(5)) kf)) where role is not null group by all"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return FO.fold_roles(a.rolling, a.folds).groupBy("k_fold", "role").agg(
        F.count("*").alias("n"), F.countDistinct("subject_id").alias("n_subjects"))


@query("K3_holdout_carve", wf("""
    select subject_id, case when pos >= n - 100 then 'locked' else 'pool' end part from a_perm"""))
def _(spark, folder):
    return FO.holdout_carve(Purchases(spark, folder).scope, 100)


@query("K4_inner_split", wf("""
    select subject_id, case when pos < round_even(0.2 * n, 0) then 'dev'
           when pos < round_even(0.2 * n, 0) + round_even(0.1 * n, 0) then 'holdout' else 'fit' end part from a_perm"""))
def _(spark, folder):
    return FO.inner_split(Purchases(spark, folder).scope, 0.2, 0.1)


fragment("a_train_labels", "select * from a_labels where split = 'train'")
fragment("a_strata", """
    select l.subject_id, coalesce(min(case when y = 1 then {'t': total, 'c': code} end),
                                  {'t': 4611686018427387904, 'c': '~none'}) st
    from a_train_labels l join (select code, sum(y) total from a_train_labels group by 1) using (code) group by 1""")
fragment("a_strat_folds", """
    select subject_id, st.c stratum,
           ((row_number() over (order by st.t, st.c, md5('12345,' || subject_id), subject_id) - 1) % 5)::int fold from a_strata""")


@query("K5_stratified_folds", wf("select * from a_strat_folds"))
def _(spark, folder):
    return FO.stratified_folds(Purchases(spark, folder).labels.filter("split = 'train'"))


@query("K5_iterative_stratification", wf("""
    select code, sum(y)::bigint n_pos, (select count(distinct subject_id) from a_train_labels) n_subjects,
           case when row_number() over (order by sum(y), code) = 1 then 1 end as is_level
    from a_train_labels group by 1"""))
def _(spark, folder):
    """Folds from iterative stratification: positives of each code, subjects dealt (each once), and whether the code treated first,
    the rarest, is level over the folds: less than one positive from a fifth in each. Later codes are as level as earlier ones let them be.
    """
    labels = Purchases(spark, folder).labels.filter("split = 'train'")
    folds = FO.iterative_folds(labels)
    cells = labels.join(folds, "subject_id").groupBy("code", "fold").agg(F.sum("y").alias("pos"))
    n = folds.agg(F.countDistinct("subject_id").alias("n_subjects"), F.count(F.lit(1)).alias("n_rows"))
    table = cells.groupBy("code").agg(F.sum("pos").alias("n_pos"), F.max("pos").alias("hi"), F.min("pos").alias("lo"))
    table = DI.beside(table, table.agg(F.min(F.struct("n_pos", "code"))["code"].alias("rarest")))
    found = DI.beside(table, n).filter("n_subjects = n_rows")
    ideal = F.col("n_pos") / 5
    level = ((F.col("hi") - ideal < 1) & (ideal - F.col("lo") < 1)).cast("int")
    return found.select("code", "n_pos", "n_subjects", F.when(F.col("code") == F.col("rarest"), level).alias("is_level"))


@query("K6_fold_diagnostics", wf("""
    select fold, (select count(*) from a_folds g where g.fold = p.fold) n_subjects, min(pos)::bigint min_positives,
           sum(pos)::bigint n_positives, count(*) filter (pos = 0) n_empty_codes
    from (select fold, code, sum(y) pos from a_train_labels join a_folds using (subject_id) group by all) p group by fold"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return FO.fold_diagnostics(a.folds, a.labels.filter("split = 'train'"))


@query("K7_split_disjointness", wf("""
    select distinct subject_id, 'listed only' side from a_splits
    where subject_id not in (select o_custkey from orders where o_orderstatus = 'P')
    union all select distinct o_custkey, 'found only' from orders
    where o_orderstatus = 'P' and o_custkey not in (select subject_id from a_splits)"""))
def _(spark, folder):
    """The split list against the customers that have a pending order."""
    a = Purchases(spark, folder)
    found = a.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject_id"))
    return FO.split_disjointness(a.splits, found)


# ---------------------------------------------------------------- score tables in SQL

fragment("a_real_pre", """
    select r.subject_id, r.cutoff, e.ts, e.kind, e.token, date_diff('microsecond', e.ts, r.cutoff) / 8.64e10 age
    from a_examples r join a_events e on r.subject_id = e.subject_id and e.ts < r.cutoff
    where e.is_pre_anchor and e.token in (select token from a_vocab)""")
fragment("a_brand_counts", """
    select subject_id, token[6:] code, count(*) n_ever, count(*) filter (age <= 365) n_365 from a_real_pre
    where kind = 'ITEM' group by all""")
fragment("a_recency", "select subject_id, min(age) recency from a_real_pre group by 1")
fragment("a_score_base", """
    select l.*, coalesce(fold, -1) fold, coalesce(c.n_ever, 0) n_ever, coalesce(c.n_365, 0) n_365,
           coalesce(x.n_ever, 0) near_a, coalesce(y.n_ever, 0) near_b, coalesce(recency, 3650.0) / 365.25 yrs
    from a_labels l left join a_brand_counts c using (subject_id, code) left join a_recency using (subject_id)
    left join a_brand_counts x on x.subject_id = l.subject_id and x.code = 'Brand#' || (l.code[7:]::int % 25 + 1)
    left join a_brand_counts y on y.subject_id = l.subject_id and y.code = 'Brand#' || ((l.code[7:]::int + 2) % 25 + 1)
    left join a_folds using (subject_id)""")
fragment("a_scores", """
    select subject_id, split, code, y, prevalent, at_risk, fold, 'a' model,
           round(1 / (1 + exp(-(-2.0 + 0.3 * n_ever + 0.2 * near_a - 0.1 * yrs))), 6) p from a_score_base
    union all select subject_id, split, code, y, prevalent, at_risk, fold, 'b',
           round(1 / (1 + exp(-(-2.0 + 0.3 * n_365 + 0.2 * near_b - 0.1 * yrs))), 6) p from a_score_base""")
fragment("d_scores", """
    select lang code, 'n_chars' model, doc_id subject_id, toxic y, 1 at_risk, n_chars / (n_chars + 1000.0::double) p
    from labels join documents using (doc_id)""")


@query("V0_score_fixture", wf("""
    select split, count(*) pairs, count(*) filter (a.p <> b.p) differing from a_scores a join a_scores b using (subject_id, split, code)
    where a.model = 'a' and b.model = 'b' and a.at_risk = 1 group by split"""))
def _(spark, folder):
    """At-risk pairs on which the two models differ; comparisons of models mean something only if these are many."""
    rows = Purchases(spark, folder).scores.filter("at_risk = 1").groupBy("subject_id", "split", "code").agg(
        (F.min("p") < F.max("p")).alias("differ"))
    return rows.groupBy("split").agg(F.count("*").alias("pairs"), F.count_if("differ").alias("differing"))


def metrics_sql(src: str, by: str, p: str = "p", w: str = "1") -> str:
    """Per group of ``by``: n_pos, n_neg, auroc, ap over the rows of ``src``."""
    return f"""
      select {by}, any_value(pt)::bigint n_pos, any_value(nt)::bigint n_neg,
             case when any_value(pt) > 0 and any_value(nt) > 0
                  then sum(pos * (nb + neg / 2.0::double)) / (any_value(pt)::double * any_value(nt)) end auroc,
             case when any_value(pt) > 0 and any_value(nt) > 0
                  then sum(pos * (pt - pb)::double / nullif(pt - pb + nt - nb, 0)) / any_value(pt) end ap
      from (select *, sum(pos) over g pt, sum(neg) over g nt,
                   coalesce(sum(pos) over o, 0) pb, coalesce(sum(neg) over o, 0) nb
            from (select {by}, {p} score, sum({w} * y) pos, sum({w} * (1 - y)) neg from {src} group by all)
            window g as (partition by {by}),
                   o as (partition by {by} order by score rows between unbounded preceding and 1 preceding))
      group by {by}"""


fragment("a_populations", """
    select *, 'all' population from a_scores union all select *, 'at_risk' from a_scores where at_risk = 1""")
fragment("a_label_metrics", metrics_sql("a_populations", "model, population, code"))


@query("V1_auroc_by_label", wf(f"""
    select model, population, code, n_pos, n_neg, {_r('auroc')} from a_label_metrics
    union all select 'n_chars', 'all', code, n_pos, n_neg, {_r('auroc')} from ({metrics_sql('d_scores', 'code')})"""))
def _(spark, folder):
    both = _population_metrics(spark, folder).unionByName(_toxic_metrics(spark, folder))
    return _tidy(both, "auroc").drop("ap")


def _population_metrics(spark, folder):
    rows = M.populations(Purchases(spark, folder).scores)
    return M.label_metrics(rows, ["model", "population", "code"])


def _toxic_metrics(spark, folder):
    d = Driver(spark, folder)
    rows = d.table("labels").join(d.table("documents").select("doc_id", "lang", "n_chars"), "doc_id").select(
        F.lit("n_chars").alias("model"), F.lit("all").alias("population"), F.col("lang").alias("code"),
        F.col("toxic").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"))
    return M.label_metrics(rows, ["model", "population", "code"])


@query("V2_ap_by_label", wf(f"""
    select model, population, code, n_pos, n_neg, {_r('ap')} from a_label_metrics
    union all select 'n_chars', 'all', code, n_pos, n_neg, {_r('ap')} from ({metrics_sql('d_scores', 'code')})"""))
def _(spark, folder):
    both = _population_metrics(spark, folder).unionByName(_toxic_metrics(spark, folder))
    return _tidy(both, "ap").drop("auroc")


@query("V3_macro_metrics", wf(f"""
    select model, population, {_r('avg(auroc)', alias='macro_auroc')}, {_r('avg(ap)', alias='macro_ap')},
           count(auroc)::bigint n_labels, count(*) filter (auroc is null) n_unscorable from a_label_metrics group by all"""))
def _(spark, folder):
    return _tidy(M.macro(_population_metrics(spark, folder), ["model", "population"]), "macro_auroc", "macro_ap")


HANLEY_SQL = """case when n_pos > 0 and n_neg > 0 then sqrt(greatest(0, (auroc * (1 - auroc)
    + (n_pos - 1) * (auroc / (2 - auroc) - auroc ** 2) + (n_neg - 1) * (2 * auroc ** 2 / (1 + auroc) - auroc ** 2))
    / (n_pos::double * n_neg))) end"""


@query("V4_hanley_mcneil_se", wf(f"select model, population, code, {_r(HANLEY_SQL, alias='se')} from a_label_metrics"))
def _(spark, folder):
    rows = _population_metrics(spark, folder)
    return rows.select("model", "population", "code", tidy(M.hanley_mcneil_se("auroc", "n_pos", "n_neg")).alias("se"))


fragment("a_code_counts", """
    select code, sum(1 - at_risk)::bigint n_prevalent, sum(at_risk)::bigint n_at_risk, avg(y) prevalence
    from a_scores where model = 'a' group by 1""")


@query("V5_per_code_table", wf(f"""
    select code, n_pos, n_neg, n_prevalent, n_at_risk, {_r('prevalence')}, {_r('auroc', alias='auroc_all')},
           {_r('ap')}, {_r('risk', alias='auroc_at_risk')}, {_r('ap / nullif(prevalence, 0)', alias='lift')},
           {_r(HANLEY_SQL, alias='se_hanley')}
    from (select * from a_label_metrics where model = 'a' and population = 'all') join a_code_counts using (code)
    left join (select code, auroc risk from a_label_metrics where model = 'a' and population = 'at_risk') using (code)"""))
def _(spark, folder):
    table = M.per_code_table(Purchases(spark, folder).scores.filter("model = 'a'"))
    return _tidy(table, "prevalence", "auroc_all", "ap", "auroc_at_risk", "lift", "se_hanley")


# ---------------------------------------------------------------- resampling in SQL

fragment("a_open_scores", "select * from a_scores where split <> 'test'")
fragment("a_boot_rank", """
    select subject_id, row_number() over (order by md5('7,' || subject_id), subject_id) - 1 pos, count(*) over () n
    from (select distinct subject_id from a_open_scores)""")
fragment("a_boot_weights", f"""
    select replicate, subject_id, w from (
      select replicate, {draw_sql("7", "replicate", "pos")} % n pos, count(*) w
      from a_boot_rank, (select unnest(range({N_BOOT})) replicate) group by all) join a_boot_rank using (pos)""")
fragment("a_boot_rows", "select s.*, replicate, w from a_open_scores s join a_boot_weights using (subject_id)")
fragment("a_boot_labels", metrics_sql("a_boot_rows", "model, replicate, code", w="w"))
fragment("a_boot_macro", """
    select model, replicate, avg(auroc) macro_auroc, avg(ap) macro_ap, count(*) filter (auroc is null) n_unscorable
    from a_boot_labels group by all""")
fragment("a_open_labels", metrics_sql("a_open_scores", "model, code"))
fragment("a_open_macro", "select model, avg(auroc) macro_auroc, avg(ap) macro_ap from a_open_labels group by 1")


@query("V6_bootstrap_macro", wf(f"""
    select model, {_r('any_value(o.macro_auroc)', alias='macro_auroc')}, {_r('any_value(o.macro_ap)', alias='macro_ap')},
           {_r('quantile_cont(b.macro_auroc, 0.025)', alias='macro_auroc_lo')},
           {_r('quantile_cont(b.macro_auroc, 0.975)', alias='macro_auroc_hi')},
           {_r('quantile_cont(b.macro_ap, 0.025)', alias='macro_ap_lo')},
           {_r('quantile_cont(b.macro_ap, 0.975)', alias='macro_ap_hi')}, sum(n_unscorable)::bigint n_label_drops
    from a_boot_macro b join a_open_macro o using (model) group by model"""))
def _(spark, folder):
    rows = Purchases(spark, folder).scores.filter("split <> 'test'")
    return _tidy(M.bootstrap_macro(rows, N_BOOT, 7), "macro_auroc", "macro_ap", "macro_auroc_lo", "macro_auroc_hi",
                 "macro_ap_lo", "macro_ap_hi")


fragment("a_deltas", """
    select a.replicate, a.macro_auroc - b.macro_auroc d_macro_auroc, a.macro_ap - b.macro_ap d_macro_ap
    from a_boot_macro a join a_boot_macro b using (replicate) where a.model = 'a' and b.model = 'b'""")
fragment("a_paired", "select " + ", ".join(
    f"(select a.macro_{m} - b.macro_{m} from a_open_macro a, a_open_macro b where a.model = 'a' and b.model = 'b') d_macro_{m}, "
    f"quantile_cont(d_macro_{m}, 0.025) d_macro_{m}_lo, quantile_cont(d_macro_{m}, 0.975) d_macro_{m}_hi, "
    f"stddev_pop(d_macro_{m}) d_macro_{m}_sd, "
    f"avg(case when d_macro_{m} > 0 then 1 when d_macro_{m} = 0 then 0.5 else 0 end) d_macro_{m}_win"
    for m in ("auroc", "ap")) + ", count(*) n_resamples from a_deltas")
_PAIRED = [f"d_macro_{m}{s}" for m in ("auroc", "ap") for s in ("", "_lo", "_hi", "_sd", "_win")]


def _paired(spark, folder):
    return M.paired_bootstrap(Purchases(spark, folder).scores.filter("split <> 'test'"), "a", "b", N_BOOT, 7)


@query("V7_paired_bootstrap_delta", wf(f"select {', '.join(_r(c) for c in _PAIRED)}, n_resamples from a_paired"))
def _(spark, folder):
    return _tidy(_paired(spark, folder), *_PAIRED)


@query("V13_resolvable_flag", wf("""
    select (d_macro_ap_lo > 0 or d_macro_ap_hi < 0)::int resolvable_ap,
           (d_macro_auroc_lo > 0 or d_macro_auroc_hi < 0)::int resolvable_auroc,
           ((d_macro_ap_win >= 0.75 and d_macro_auroc >= 0) or (d_macro_auroc_win >= 0.75 and d_macro_ap >= 0))::int candidate
    from a_paired"""))
def _(spark, folder):
    flags = M.resolvable(_paired(spark, folder))
    return flags.select(*[F.col(c).cast("int").alias(c) for c in ("resolvable_ap", "resolvable_auroc", "candidate")])


fragment("a_oof", "select * from a_scores where fold >= 0")
fragment("a_ranked", """
    select *, (row_number() over (partition by model, fold, code order by p, md5('tie,' || subject_id), subject_id) - 1)
              / greatest(count(*) over (partition by model, fold, code) - 1, 1)::double p_rank from a_oof""")


@query("V8_within_fold_rank", wf(f"select subject_id, code, model, fold, {_r('p_rank')} from a_ranked"))
def _(spark, folder):
    ranked = M.within_fold_rank(Purchases(spark, folder).scores.filter("fold >= 0"))
    return _tidy(ranked.select("subject_id", "code", "model", "fold", "p_rank"), "p_rank")


fragment("a_oof_risk", "select * from a_oof where at_risk = 1")
fragment("a_ranked_risk", "select * from a_ranked where at_risk = 1")
fragment("a_fold_labels", metrics_sql("a_oof_risk", "model, fold, code"))
fragment("a_fold_macro", "select model, fold, avg(auroc) au, avg(ap) ap from a_fold_labels group by all")
fragment("a_pooled_labels", metrics_sql("a_oof_risk", "model, code"))
fragment("a_rank_labels", metrics_sql("a_ranked_risk", "model, code", p="p_rank"))


@query("V9_fold_summary", wf(f"""
    select model, {_r('avg(au)', alias='auroc_mean')}, {_r('stddev_samp(au)', alias='auroc_sd')},
           {_r('avg(f.ap)', alias='ap_mean')}, {_r('stddev_samp(f.ap)', alias='ap_sd')},
           {_r('any_value(p1)', alias='auroc_pooled')}, {_r('any_value(p2)', alias='ap_pooled')},
           {_r('any_value(r1)', alias='auroc_rank')}, {_r('any_value(r2)', alias='ap_rank')}
    from a_fold_macro f join (select model, avg(auroc) p1, avg(ap) p2 from a_pooled_labels group by 1) using (model)
    join (select model, avg(auroc) r1, avg(ap) r2 from a_rank_labels group by 1) using (model) group by model"""))
def _(spark, folder):
    out = M.fold_summary(Purchases(spark, folder).scores.filter("fold >= 0"))
    return _tidy(out, *[c for c in out.columns if c != "model"])


# ---------------------------------------------------------------- calibration measures


def _murphy_sql(src: str) -> str:
    return f"""
      select model, brier, rel, res, unc, 1 - brier / nullif(unc, 0) bss, case when res > 0 then rel / res end rel_over_res
      from (select model, sum(err) / sum(n) brier, sum(n * (pk - ok) ** 2) / sum(n) rel,
                   sum(n * (ok - base) ** 2) / sum(n) res, any_value(base * (1 - base)) unc
            from (select model, least(floor(p * 10), 9) bin, count(*) n, avg(p) pk, avg(y) ok, sum((p - y) ** 2) err
                  from {src} where at_risk = 1 group by all)
            join (select model, avg(y) base from {src} where at_risk = 1 group by 1) using (model) group by model)"""


_MURPHY = ["brier", "rel", "res", "unc", "bss", "rel_over_res"]


@query("V10_murphy_decomposition", wf(f"select model, {', '.join(_r(c, 2 if c == 'rel_over_res' else 6) for c in _MURPHY)} from ({_murphy_sql('a_scores')})"))
def _(spark, folder):
    parts = M.murphy(Purchases(spark, folder).scores, ["model"])
    return _tidy(parts, *_MURPHY[:-1]).withColumn("rel_over_res", tidy("rel_over_res", 2))


@query("V11_calibration_ratio", wf(f"""
    select model, {_r('min(p)', alias='lo')}, {_r('max(p)', alias='hi')}, {_r('avg(f)', alias='mean_p')},
           {_r('avg(y)', alias='mean_y')}, count(*) filter (f <= 1.5e-6) n_floored,
           count(*) filter (at_risk = 0) n_expected, {_r('avg(f) / greatest(avg(y), 1e-9)', alias='ratio')}
    from (select *, case when at_risk = 1 then p else 1e-6 end f from a_scores) group by model"""))
def _(spark, folder):
    out = M.calibration_ratio(Purchases(spark, folder).scores, ["model"])
    return _tidy(out, "lo", "hi", "mean_p", "mean_y", "ratio")


fragment("t_log", """
    select n_name run, o_orderkey t, (date_part('year', o_orderdate) - 1990)::int * 12 + date_part('month', o_orderdate)::int epoch,
           o_totalprice / 500000.0::double ap
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""")
fragment("t_latest", "select run, epoch, arg_max(ap, (t, ap)) ap from t_log group by all")
fragment("t_best", """
    select run, list_reduce(list({'epoch': epoch, 'ap': ap} order by epoch), lambda a, x: case when x.ap > a.ap + 0.002 then x else a end,
           {'epoch': 0, 'ap': -1.0::double}) best, count(*) n_epochs from t_latest group by run""")


@query("V12_best_epoch_replay", wf(f"""
    select run, best.epoch best_epoch, {_r('best.ap', alias='best_ap')}, n_epochs::int n_epochs from t_best"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    month = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")
    log = a.orders.join(a.subjects.select("subject_id", "nation"), F.col("o_custkey") == F.col("subject_id")).select(
        F.col("nation").alias("run"), F.col("o_orderkey").alias("t"), month.alias("epoch"),
        (F.col("o_totalprice") / 500000.0).alias("ap"))
    return _tidy(M.best_epoch_replay(log), "best_ap")


_LEDGER_SQL = """
    select user_id::varchar run, case event_type when 'click' then 'lr/macro_auroc' when 'purchase' then 'gbdt/macro_auroc'
           when 'view' then 'macro_auroc' when 'error' then 'lr/macro_ap' else 'note' end key from events"""
fragment("l_looks", f"""
    select run, key, case when contains(key, '/') then regexp_replace(key, '/[^/]*$', '') else run end model
    from ({_LEDGER_SQL}) where split_part(key, '/', -1) = 'macro_auroc'""")


@query("V16_selection_ledger", wf(f"""
    select n_evaluations, n_candidates, {_r('0.0104 * sqrt(2 * ln(n_candidates))', alias='bound_candidates')},
           {_r('0.0104 * sqrt(2 * ln(n_evaluations))', alias='bound_evaluations')}
    from (select count(*) n_evaluations, count(distinct (run, model)) n_candidates from l_looks)"""))
def _(spark, folder):
    out = D.selection_ledger(ledger_of(Driver(spark, folder)))
    return _tidy(out, "bound_candidates", "bound_evaluations")


def ledger_of(driver):
    """The event table as a JSON-lines ledger, one evaluation or note a line."""
    kind = F.col("event_type")
    key = (F.when(kind == "click", "lr/macro_auroc").when(kind == "purchase", "gbdt/macro_auroc")
           .when(kind == "view", "macro_auroc").when(kind == "error", "lr/macro_ap").otherwise("note"))
    entries = F.map_from_arrays(F.array(F.lit("run"), F.lit("t"), key), F.array(
        F.col("user_id").cast("string"), F.col("ts").cast("string"), F.col("value").cast("string")))
    return driver.table("events").select(F.to_json(entries).alias("value"))


@query("V17_masked_log_loss", wf(f"""
    select model, {_r('sum(-(y * ln(p) + (1 - y) * ln(1 - p)) * at_risk) / greatest(sum(at_risk), 1)', alias='log_loss')}
    from a_scores group by model"""))
def _(spark, folder):
    return _tidy(M.masked_log_loss(Purchases(spark, folder).scores, ["model"]), "log_loss")


# ---------------------------------------------------------------- blending and calibration


@query("M1_fit_prevalence", wf(f"""
    select subject_id, code, {_r('rate', alias='p')} from a_labels
    join (select code, avg(y) rate from a_labels where split = 'train' group by 1) using (code)"""))
def _(spark, folder):
    a = Purchases(spark, folder)
    return _tidy(MO.fit_prevalence(a.labels, a.scope).select("subject_id", "code", "p"), "p")


@query("M1_prevalence_auroc", wf("""
    select code, case when sum(y) > 0 and sum(1 - y) > 0 then 0.5::double end auroc from a_labels group by code"""))
def _(spark, folder):
    """A constant score must rank at exactly one half; this tests the metric code."""
    a = Purchases(spark, folder)
    return M.label_metrics(MO.fit_prevalence(a.labels, a.scope), ["code"]).select("code", "auroc")


@query("M6_at_risk_floor", wf("""
    select subject_id, code, model, case when at_risk = 1 then p else 1e-6 end p from a_scores"""))
def _(spark, folder):
    return MO.at_risk_floor(Purchases(spark, folder).scores).select("subject_id", "code", "model", "p")


@query("M7_logit_blend", wf(f"""
    select subject_id, code, {_r('1 / (1 + exp(-avg(ln(q / (1 - q)))))', alias='p')}
    from (select *, least(greatest(p, 1e-6), 1 - 1e-6) q from a_scores) group by all"""))
def _(spark, folder):
    blend = MO.logit_blend(Purchases(spark, folder).scores)
    return _tidy(blend.select("subject_id", "code", "p"), "p")


def _platt_sql(steps: int) -> str:
    """Newton steps as nested fragments over the points of model a's train pairs."""
    fragment("p_rows", "select * from a_scores where model = 'a' and split = 'train' and at_risk = 1")
    fragment("p_sizes", "select code, sum(y)::double np, sum(1 - y)::double nn from p_rows group by 1")
    fragment("p_points", """
        select code, ln(q / (1 - q)) x, count(*)::double w,
               sum(case when y = 1 then (np + 1) / (np + 2) else 1 / (nn + 2) end) t
        from (select *, least(greatest(p, 1e-6), 1 - 1e-6) q from p_rows) join p_sizes using (code)
        where np >= 5 and nn >= 5 group by all""")
    fragment("p_step0", "select distinct code, 1.0::double a, 0.0::double b from p_points")
    for i in range(steps):
        fragment(f"p_step{i + 1}", f"""
          select code, a - da * f a, b - db * f b from (
            select *, least(1.0, 5.0 / greatest(abs(da), abs(db), 1e-300)) f from (
              select code, a, b, (h * ga - hx * r) / (haa * h - hx * hx) da, (haa * r - hx * ga) / (haa * h - hx * hx) db
              from (select code, any_value(a) a, any_value(b) b, sum(w * q - t) r,
                           sum((w * q - t) * x) + any_value(a) / 1e6 ga, sum(w * q * (1 - q)) h,
                           sum(w * q * (1 - q) * x) hx, sum(w * q * (1 - q) * x * x) + 1e-6 haa
                    from (select p.*, a, b, 1 / (1 + exp(-(a * x + b))) q from p_points p join p_step{i} using (code))
                    group by code)))""")
    fragment("p_fit", f"""
        select t.code, coalesce(a, 1.0) a, coalesce(b, 0.0) b, (a is not null) ok
        from a_targets t left join p_step{steps} using (code)""")
    return "p_fit"


_platt_sql(12)


def _platt(spark, folder):
    train = Purchases(spark, folder).scores.filter("model = 'a' and split = 'train'")
    return CA.fit_platt(train)


@query("M8_fit_platt", wf(f"select code, {_r('a')}, {_r('b')}, ok::int ok from p_fit"))
def _(spark, folder):
    return _tidy(_platt(spark, folder), "a", "b").withColumn("ok", F.col("ok").cast("int"))


fragment("p_applied", """
    select s.* exclude (p), case when at_risk = 0 then 1e-6 when ok
           then 1 / (1 + exp(-(a * ln(q / (1 - q)) + b))) else p end p
    from (select *, least(greatest(p, 1e-6), 1 - 1e-6) q from a_scores where model = 'a') s join p_fit using (code)""")


@query("M9_apply_platt", wf(f"select subject_id, code, {_r('p')} from p_applied"))
def _(spark, folder):
    rows = Purchases(spark, folder).scores.filter("model = 'a'")
    return _tidy(CA.apply_platt(rows, _platt(spark, folder)).select("subject_id", "code", "p"), "p")


fragment("p_rising", "select code from p_fit where a > 0")
fragment("p_before", "select * from a_scores where model = 'a' and at_risk = 1 and code in (select code from p_rising)")
fragment("p_before_labels", metrics_sql("p_before", "code"))


@query("M10_calibration_noop_check", wf(f"""
    select {_r('avg(ap)', alias='macro_ap')}, 0.0::double d_macro_ap, {_r('avg(auroc)', alias='macro_auroc')},
           0.0::double d_macro_auroc from p_before_labels"""))
def _(spark, folder):
    rows = Purchases(spark, folder).scores.filter("model = 'a'")
    params = _platt(spark, folder)
    check = CA.noop_check(rows, CA.apply_platt(rows, params), params)
    return _tidy(check, "macro_ap", "macro_auroc", "d_macro_ap", "d_macro_auroc", digits=6)


@query("M11_select_recipe", wf(f"""
    select population, arg_max(model, (macro_ap, model)) model, {_r('max(macro_ap)', alias='macro_ap')}
    from (select model, population, round(avg(ap), 12) macro_ap from a_label_metrics group by all) group by population
    union all select population || '/chosen', 'a', {_r('avg(ap)', alias='macro_ap')} from a_label_metrics where model = 'a' group by population"""))
def _(spark, folder):
    """The best model of each population, and the one that was chosen beforehand."""
    table = M.macro(_population_metrics(spark, folder), ["model", "population"])
    chosen = MO.select_recipe(table, ["population"], chosen="a").withColumn("population", F.concat("population", F.lit("/chosen")))
    return _tidy(MO.select_recipe(table, ["population"]).unionByName(chosen), "macro_ap")


@query("M13_oof_uniqueness", wf("""
    select model, code, count(*) n, count(distinct subject_id) n_subjects from a_oof group by all"""))
def _(spark, folder):
    counts = keep(MO.oof_counts(Purchases(spark, folder).scores.filter("fold >= 0")), "oof")
    if counts.filter("n_repeated > 0").limit(1).count():
        raise ValueError("a subject is scored more than once")
    return counts.drop("n_repeated")
