"""Vocabulary and token sequences as runnable queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.scalars import tidy
from tidemark.operators import metrics as M, sequences as SQ
from tidemark.plans import features  # noqa: F401  (defines the feature fragments)
from tidemark.plans.catalog import fragment, query, with_fragments as wf
from tidemark.sources.demo import Activity, Purchases

KINDS = ("view", "signup", "click", "purchase", "error")

fragment("q_fusion", "select token, edges, n, n / (len(edges) + 1)::double >= 12 fused from b_edges")
fragment("q_reasons", """
    select reason, (row_number() over (order by reason) + 1)::int id from (
      select reason from b_scope_events where reason is not null group by 1 having count(distinct subject_id) >= 5)""")
fragment("q_answers", """
    select distinct subject_id, ts, 'error_' || (k % 10) token,
           min('code-' || (k // 25)) over (partition by subject_id, ts, k % 10) answer
    from b_raw where kind = 'error'""")
fragment("q_pairs", """
    select e.token || '=' || answer pair, count(distinct e.subject_id) n_subjects
    from b_scope_events e join q_answers a on e.subject_id = a.subject_id and e.ts = a.ts and e.token = a.token
    group by 1 having count(distinct e.subject_id) >= 5""")
fragment("q_kept", "select token from b_scope_events group by 1 having count(distinct subject_id) >= 5")
fragment("q_vocab", f"""
    select token, (row_number() over (order by section, major, base, minor) - 1)::int id from (
      select 0 section, i major, t base, 0 minor, t token from (values (0, '[PAD]'), (1, '[BOS]'), (2, '[ANCHOR]')) v(i, t)
      union all select 1, i, '[UNK_' || t || ']', 0, '[UNK_' || t || ']' from (values {', '.join(f"({i}, '{k}')" for i, k in enumerate(KINDS))}) v(i, t)
      union all (select distinct 2, 0, 'device_' || coalesce(device, 'NA'), 0, 'device_' || coalesce(device, 'NA')
                 from b_cohort where split = 'train')
      union all select 3, i, 'Q' || i, 0, 'Q' || i from (select unnest(range(10)) i)
      union all select 4, 0, token, lv, case when fused then token || '_Q' || lv else token end from (
                select k.token, coalesce(fused, false) fused, unnest(case when fused then range(len(edges) + 1) else [0] end) lv
                from q_kept k left join q_fusion f using (token))
      union all select 5, 0, pair, 0, pair from q_pairs
      union all select 6, 0, '[MASK]', 0, '[MASK]')""")
fragment("q_tok", """
    select e.subject_id, e.ts, ts_seq, e.kind, kind_rank, e.token, value, e.reason, is_pre_anchor,
           coalesce(av.id, nv.id, uv.id) tid, case when leveled and not fused then qv.id end qid,
           case when e.reason is null then 0 else coalesce(r.id, 1) end rid
    from (select b.*, f.fused, value is not null and f.edges is not null leveled,
                 len(list_filter(f.edges, lambda x: x <= value)) bin from b_events b left join q_fusion f using (token)) e
    left join q_answers a on a.subject_id = e.subject_id and a.ts = e.ts and a.token = e.token
    left join q_vocab av on av.token = e.token || '=' || a.answer
    left join q_vocab nv on nv.token = case when leveled and fused then e.token || '_Q' || bin else e.token end
    join q_vocab uv on uv.token = '[UNK_' || e.kind || ']'
    left join q_vocab qv on qv.token = 'Q' || least(bin, 9)
    left join q_reasons r on r.reason = e.reason""")
fragment("q_numbered", """
    select *, row_number() over (partition by subject_id, ts_seq, kind_rank, token, value, reason, tid, qid, rid) dup from q_tok""")
fragment("q_positions", """
    select subject_id, ts_seq, kind_rank, token, value, reason, dup, 0 slot, tid id, rid, is_pre_anchor from q_numbered
    union all select subject_id, ts_seq, kind_rank, token, value, reason, dup, 1, qid, 0, is_pre_anchor
    from q_numbered where qid is not null""")
_LATEST = ("ts_seq desc, kind_rank desc, token desc, value desc nulls last, reason desc nulls last, dup desc, slot desc")


def _prefix_sql(examples: str, condition: str) -> str:
    return f"""
      select subject_id, cutoff, recency, id, date_diff('microsecond', ts_seq, cutoff) dt, rid from (
        select r.subject_id, r.cutoff, p.id, p.rid, p.ts_seq,
               row_number() over (partition by r.subject_id, r.cutoff order by {_LATEST}) recency
        from {examples} r join q_positions p on p.subject_id = r.subject_id and p.ts_seq < r.cutoff and {condition})
      where recency <= 29"""


def _sequence_sql(examples: str, prefix: str) -> str:
    return f"""
      select e.subject_id, e.cutoff, bos || ' ' || dev.id || coalesce(' ' || ids, '') || ' ' || anc ids,
             coalesce(fd, 0) || ' ' || coalesce(fd, 0) || coalesce(' ' || dts, '') || ' 0' dts,
             '0 0' || coalesce(' ' || rids, '') || ' 0' rids, (coalesce(n, 0) + 3)::int length,
             coalesce(unk, 0)::bigint n_unknown, date_diff('microsecond', c.birthdate, e.cutoff) / 8.64e10 age_days
      from {examples} e join b_cohort c on c.subject_id = e.subject_id
      left join (select subject_id, cutoff, string_agg(id::varchar, ' ' order by recency desc) ids,
                        string_agg(dt::varchar, ' ' order by recency desc) dts, string_agg(rid::varchar, ' ' order by recency desc) rids,
                        count(*) n, max(dt) fd, count(*) filter (id between 3 and 7) unk from {prefix} group by all) b
        on b.subject_id = e.subject_id and b.cutoff = e.cutoff
      join (select token, id from q_vocab) dev on dev.token = 'device_' || coalesce(c.device, 'NA'),
      (select id bos from q_vocab where token = '[BOS]'), (select id anc from q_vocab where token = '[ANCHOR]')"""


fragment("q_prefix", _prefix_sql("b_rolling", "is_pre_anchor"))
fragment("q_sequences", _sequence_sql("b_rolling", "q_prefix"))
fragment("q_full_examples", "select subject_id, max(ts_seq) + interval 1 day cutoff from b_events where subject_id in (select subject_id from b_scope) group by 1")
fragment("q_full_prefix", _prefix_sql("q_full_examples", "true"))
fragment("q_full_sequences", _sequence_sql("q_full_examples", "q_full_prefix"))


def _edges(df):
    text = F.array_join(F.transform("edges", lambda e: F.round(e * 10000).cast("bigint").cast("string")), " ")
    return df.select("token", "n", text.alias("edges"), F.col("fused").cast("int").alias("fused"))


def _edges_sql(src: str, fused: str = "fused::int") -> str:
    return f"select token, n, array_to_string(list_transform(edges, lambda x: round(x * 10000)::bigint), ' ') edges, {fused} fused from {src}"


@query("Q1_build_vocab", wf("select token, id from q_vocab"))
def _(spark, folder):
    return Activity(spark, folder).sequence_vocab.tokens.select("token", F.col("id").cast("int").alias("id"))


@query("Q2_fusion_rule", wf(_edges_sql("q_fusion")))
def _(spark, folder):
    b = Activity(spark, folder)
    return _edges(SQ.fusion_rule(b.events, b.scope, b.sequence_cfg))


_LEVELS = "case least(10, greatest(2, n // 12)) " + " ".join(
    f"when {k} then quantile_cont(value, [{', '.join(repr(i / k) for i in range(1, k))}])" for k in range(2, 11)) + " end"
fragment("q_adaptive", f"""
    select token, n, list_sort(list_distinct(list_transform(qs, lambda x: round(x, 9)))) edges from (
      select token, any_value(n) n, {_LEVELS.replace('n // 12', 'any_value(n) // 12')} qs
      from (select token, value, count(*) over (partition by token) n from b_scope_events where value is not null) group by token)""")


@query("Q2_fusion_rule_adaptive", wf(_edges_sql("q_adaptive", "1")))
def _(spark, folder):
    b = Activity(spark, folder)
    return _edges(SQ.fusion_rule(b.events, b.scope, replace(b.sequence_cfg, adaptive_bins=True)))


@query("Q3_reason_vocab", wf("select reason, id from q_reasons"))
def _(spark, folder):
    return Activity(spark, folder).sequence_vocab.reasons


@query("Q4_text_answer_tokens", wf("select pair, n_subjects from q_pairs"))
def _(spark, folder):
    b = Activity(spark, folder)
    return SQ.text_answer_tokens(b.events, b.answers, b.scope, b.sequence_cfg)


@query("Q5_post_anchor_vocab", wf("""
    select token, count(distinct subject_id) n_subjects from b_events where subject_id in (select subject_id from b_scope)
    group by 1 having count(distinct subject_id) >= 80"""))
def _(spark, folder):
    b = Activity(spark, folder)
    return SQ.kept_tokens(b.events, b.scope, replace(b.sequence_cfg, min_subjects=80, post_anchor_vocab=True))


def _tokenised(b):
    return SQ.tokenise_events(b.events, b.sequence_vocab, b.sequence_cfg, KINDS, b.answers)


@query("Q6_tokenise_events", wf("""
    select subject_id, cast(ts as varchar) ts, token, tid, qid, rid, count(*) n from q_tok group by all"""))
def _(spark, folder):
    return _tokenised(Activity(spark, folder)).groupBy(
        "subject_id", F.col("ts").cast("string").alias("ts"), "token", "tid", "qid", "rid").agg(F.count("*").alias("n"))


@query("Q7_expand_value_position", wf("""
    select subject_id, cast(ts_seq as varchar) ts_seq, token, id, slot, rid, count(*) n, sum(dup)::bigint dups
    from q_positions group by all"""))
def _(spark, folder):
    rows = SQ.expand_positions(_tokenised(Activity(spark, folder)))
    return rows.groupBy("subject_id", F.col("ts_seq").cast("string").alias("ts_seq"), "token", "id", "slot", "rid").agg(
        F.count("*").alias("n"), F.sum("dup").alias("dups"))


@query("Q8_recent_prefix", wf("""
    select subject_id, cast(cutoff as varchar) cutoff, recency::int recency, id, dt, rid from q_prefix"""))
def _(spark, folder):
    b = Activity(spark, folder)
    budget = SQ.body_budget(b.sequence_cfg, b.spec.demographics)
    positions = SQ.expand_positions(_tokenised(b).join(
        b.cohort.select("subject_id", "anchor"), "subject_id").filter("ts < anchor"), budget)
    rows = SQ.recent_prefix(positions, b.rolling, budget)
    return rows.select("subject_id", F.col("cutoff").cast("string").alias("cutoff"), "recency", "id",
                       F.round(F.col("dt") * 8.64e10).cast("bigint").alias("dt"), "rid")


def _text(seq):
    part = lambda f: F.array_join(F.transform("tokens", f), " ")
    return seq.select(
        "subject_id", F.col("cutoff").cast("string").alias("cutoff"), part(lambda t: t["id"].cast("string")).alias("ids"),
        part(lambda t: F.round(t["dt"] * 8.64e10).cast("bigint").cast("string")).alias("dts"),
        part(lambda t: t["rid"].cast("string")).alias("rids"), "length", tidy("age_days", 4).alias("age_days"))


_SEQ_COLUMNS = "subject_id, cast(cutoff as varchar) cutoff, ids, dts, rids, length, round(age_days, 4) + 0.0 age_days"


@query("Q9_sequence_assemble", wf(f"select {_SEQ_COLUMNS} from q_sequences"))
def _(spark, folder):
    return _text(Activity(spark, folder).sequences)


@query("Q10_full_timeline_pack", wf(f"select {_SEQ_COLUMNS} from q_full_sequences"))
def _(spark, folder):
    b = Activity(spark, folder)
    examples = SQ.full_timeline_examples(b.events, b.scope)
    return _text(SQ.build_sequences(b.events, examples, b.cohort, b.sequence_vocab, b.sequence_cfg, KINDS,
                                    b.spec.demographics, b.answers, whole_record=True))


def _lengths(b):
    unknown = F.size(F.filter("tokens", lambda t: t["id"].between(3, 2 + len(KINDS))))
    return b.sequences.select("subject_id", "cutoff", "length", unknown.alias("n_unknown")).join(
        b.rolling.select("subject_id", "cutoff", "split"), ["subject_id", "cutoff"])


@query("Q11_length_stats", wf("""
    select split, round(quantile_cont(length, 0.5), 6) + 0.0 median, round(quantile_cont(length, 0.9), 6) + 0.0 p90,
           round(avg((length >= 32)::int), 6) + 0.0 at_cap, round(sum(n_unknown) / sum(length)::double, 6) + 0.0 unknown_share
    from q_sequences join b_rolling using (subject_id, cutoff) group by split"""))
def _(spark, folder):
    out = M.length_stats(_lengths(Activity(spark, folder)), ["split"], 32)
    return out.select("split", *[tidy(c).alias(c) for c in ("median", "p90", "at_cap", "unknown_share")])


@query("Q12_length_bucketing", wf("""
    select subject_id, cast(cutoff as varchar) cutoff, length,
           ((row_number() over (order by length, md5('batch,' || key), key) - 1) // 32)::bigint batch
    from (select *, subject_id || '@' || cutoff::varchar as key from q_sequences)"""))
def _(spark, folder):
    rows = Activity(spark, folder).sequences.select("subject_id", "cutoff", "length")
    return SQ.length_batches(rows, 32).withColumn("cutoff", F.col("cutoff").cast("string")).select(
        "subject_id", "cutoff", "length", "batch")


@query("Q13_permuted_control", wf("""
    select a.subject_id, cast(a.cutoff as varchar) cutoff, b.subject_id from_subject, b.length
    from (select *, row_number() over (order by md5('12345,' || key), key) pos
          from (select *, subject_id || '@' || cutoff::varchar as key from q_sequences)) a
    join (select *, row_number() over (order by md5('12345:content,' || key), key) pos
          from (select *, subject_id || '@' || cutoff::varchar as key from q_sequences)) b using (pos)"""))
def _(spark, folder):
    rows = Activity(spark, folder).sequences.select("subject_id", "cutoff", "length")
    return SQ.permuted_control(rows, ["length"]).select(
        "subject_id", F.col("cutoff").cast("string").alias("cutoff"), "from_subject", "length")


@query("A4_audit_sequences", wf("""
    select count(*) n, 0::bigint id_out_of_range, 0::bigint no_anchor_at_end, 0::bigint time_runs_back,
           0::bigint negative_dt, 0::bigint wrong_length from q_sequences"""))
def _(spark, folder):
    b = Activity(spark, folder)
    return SQ.audit_sequences(b.sequences, b.sequence_vocab)
