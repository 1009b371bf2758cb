"""Token sequences: vocabulary, tokenised events, recent histories per example."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.config import SequenceConfig
from tidemark.functions.scalars import bin_of
from tidemark.functions.time import days_between
from tidemark.operators import stats
from tidemark.operators.distributed import exact_quantiles, hash_rank, range_rank
from tidemark.operators.segments import place_cutoffs, place_events
from tidemark.session import small_table

# Reserved tokens and reason ids.
PAD, BOS, ANCHOR, MASK = "[PAD]", "[BOS]", "[ANCHOR]", "[MASK]"
NO_REASON, UNKNOWN_REASON = 0, 1


@dataclass(frozen=True)
class Vocabulary:
    """``tokens`` (token, id), ``edges`` (token, edges, fused), ``reasons`` (reason, id): all fitted on the scope."""

    tokens: DataFrame
    edges: DataFrame
    reasons: DataFrame


def fusion_rule(events: DataFrame, scope: DataFrame, cfg: SequenceConfig) -> DataFrame:
    """(token, edges, n, fused): value cut points and whether value and token share one position.

    Fixed bins fuse a token when it has enough events per level. Adaptive bins give each token
    as many levels as its volume supports and fuse them all.
    """
    values = stats.numeric_events(stats.scope_events(events, scope)).select("token", "value")
    if not cfg.adaptive_bins:
        probs = [i / cfg.n_bins for i in range(1, cfg.n_bins)]
        cuts = exact_quantiles(values, ["token"], "value", probs)
        edges = cuts.select("token", _distinct("quantiles").alias("edges"), "n").filter(F.size("edges") >= 2)
        per_level = F.col("n") / (F.size("edges") + 1)
        return edges.withColumn("fused", per_level >= cfg.min_events_per_bin)
    levels = list(range(2, cfg.n_bins + 1))
    probs = sorted({i / k for k in levels for i in range(1, k)})
    cuts = exact_quantiles(values, ["token"], "value", probs)
    wanted = F.least(F.lit(cfg.n_bins), F.greatest(F.lit(2), F.floor(F.col("n") / cfg.min_events_per_bin)))
    choice = None
    for k in levels:
        mine = F.array(*[F.col("quantiles")[probs.index(i / k)] for i in range(1, k)])
        choice = F.when(wanted == k, mine) if choice is None else choice.when(wanted == k, mine)
    chosen = cuts.select("token", choice.alias("picked"), "n")
    return chosen.select("token", _distinct("picked").alias("edges"), "n", F.lit(True).alias("fused")).filter(
        F.size("edges") >= 1)


def _distinct(quantiles: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(quantiles, lambda q: F.round(q, 9))))


def reason_vocab(events: DataFrame, scope: DataFrame, cfg: SequenceConfig) -> DataFrame:
    """(reason, id) for reasons with enough scope subjects; ids from 2, as 0 is none and 1 unknown."""
    seen = stats.scope_events(events, scope).filter(F.col("reason").isNotNull())
    kept = (seen.groupBy("reason").agg(F.countDistinct("subject_id").alias("n_subjects"))
            .filter(F.col("n_subjects") >= cfg.min_subjects))
    return range_rank(kept.select("reason"), [], ["reason"]).select("reason", (F.col("rank") + 2).cast("int").alias("id"))


def text_answer_tokens(events: DataFrame, answers: DataFrame, scope: DataFrame, cfg: SequenceConfig) -> DataFrame:
    """``token=answer`` pairs seen in enough scope subjects before the anchor."""
    mine = stats.scope_events(events, scope).join(answers, ["subject_id", "ts", "token"])
    pair = F.concat_ws("=", "token", "answer").alias("pair")
    return (mine.groupBy(pair).agg(F.countDistinct("subject_id").alias("n_subjects"))
            .filter(F.col("n_subjects") >= cfg.min_subjects))


def kept_tokens(events: DataFrame, scope: DataFrame, cfg: SequenceConfig) -> DataFrame:
    """Tokens with enough scope subjects, before the anchor or, if configured, over whole records."""
    seen = events.join(scope, "subject_id", "left_semi") if cfg.post_anchor_vocab else stats.scope_events(events, scope)
    return (seen.groupBy("token").agg(F.countDistinct("subject_id").alias("n_subjects"))
            .filter(F.col("n_subjects") >= cfg.min_subjects))


def build_vocab(events: DataFrame, cohort: DataFrame, scope: DataFrame, cfg: SequenceConfig, kinds: Sequence[str],
                demographics: Sequence[str], answers: DataFrame | None = None) -> Vocabulary:
    """Ids in section order: specials, unknowns, demographics, shared bins, tokens, answers, mask last.

    Free-text answers make the vocabulary grow with the data, so ids are counted over ranges of names.
    """
    spark = events.sparkSession
    fixed = [(0, i, 0, t) for i, t in enumerate((PAD, BOS, ANCHOR))]
    fixed += [(1, i, 0, f"[UNK_{k}]") for i, k in enumerate(kinds)]
    fixed += [(3, i, 0, f"Q{i}") for i in range(cfg.n_bins)] + [(6, 0, 0, MASK)]
    parts = [small_table(spark, fixed, "section int, major int, minor int, token string")]
    people = cohort.join(scope, "subject_id", "left_semi")
    for i, c in enumerate(demographics):
        value = F.concat(F.lit(f"{c}_"), F.coalesce(F.col(c), F.lit("NA"))).alias("token")
        parts.append(people.select(F.lit(2).alias("section"), F.lit(i).alias("major"), F.lit(0).alias("minor"), value).distinct())
    edges = fusion_rule(events, scope, cfg)
    kept = kept_tokens(events, scope, cfg).select("token").join(edges, "token", "left")
    fused = F.coalesce(F.col("fused"), F.lit(False))
    levels = F.when(fused, F.sequence(F.lit(0), F.size("edges"))).otherwise(F.array(F.lit(0)))
    exploded = kept.select(F.col("token").alias("base"), fused.alias("fused"), F.explode(levels).alias("minor"))
    name = F.when(F.col("fused"), F.concat(F.col("base"), F.lit("_Q"), F.col("minor").cast("string"))).otherwise(F.col("base"))
    body = exploded.select(F.lit(4).alias("section"), F.lit(0).alias("major"), "minor", name.alias("token"), "base")
    if answers is not None and cfg.text_answers:
        pairs = text_answer_tokens(events, answers, scope, cfg)
        body = body.unionByName(pairs.select(F.lit(5).alias("section"), F.lit(0).alias("major"), F.lit(0).alias("minor"),
                                             F.col("pair").alias("token"), F.col("pair").alias("base")))
    for part in parts:
        body = body.unionByName(part.withColumn("base", F.col("token")))
    # Sections with a fixed order carry it in ``major``; the others sort by name, bins by number.
    order = ["section", "major", "base", "minor"]
    tokens = range_rank(body.select(*order, "token"), [], order).select("token", F.col("rank").cast("int").alias("id"))
    return Vocabulary(tokens, edges, reason_vocab(events, scope, cfg))


def _special_ids(tokens: DataFrame, n_bins: int, kinds: Sequence[str]) -> Column:
    """The few reserved ids as one map literal."""
    names = [BOS, ANCHOR, *[f"[UNK_{k}]" for k in kinds], *[f"Q{i}" for i in range(n_bins)]]
    few = tokens.filter(F.col("token").isin(*names))
    return few.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("m")).scalar()


def tokenise_events(events: DataFrame, vocab: Vocabulary, cfg: SequenceConfig, kinds: Sequence[str],
                    answers: DataFrame | None = None) -> DataFrame:
    """Add ``tid`` (token id), ``qid`` (id of a separate value token, or null) and ``rid`` (reason id)."""
    mine = events.filter(F.col("kind").isin(*kinds)).join(
        vocab.edges.select("token", "edges", "fused"), "token", "left")
    leveled = F.col("is_numeric") & F.col("value").isNotNull() & F.col("edges").isNotNull()
    mine = mine.withColumn("_bin", F.when(leveled, bin_of("edges", "value")))
    name = F.when(leveled & F.col("fused"), F.concat(F.col("token"), F.lit("_Q"), F.col("_bin").cast("string"))).otherwise(
        F.col("token"))
    mine = mine.withColumn("_name", name)
    if answers is not None and cfg.text_answers:
        told = answers.join(vocab.tokens.select(F.col("token").alias("_pair"), F.col("id").alias("_aid")),
                            F.concat_ws("=", "token", "answer") == F.col("_pair"))
        mine = mine.join(told.select("subject_id", "ts", "token", "_aid"), ["subject_id", "ts", "token"], "left")
    else:
        mine = mine.withColumn("_aid", F.lit(None).cast("int"))
    names = vocab.tokens.select(F.col("token").alias("_name"), F.col("id").alias("_id"))
    coded = mine.join(names, "_name", "left").join(
        vocab.reasons.select("reason", F.col("id").alias("_rid")), "reason", "left")
    coded = coded.withColumn("_special", _special_ids(vocab.tokens, cfg.n_bins, kinds))
    unknown = F.col("_special")[F.concat(F.lit("[UNK_"), F.col("kind"), F.lit("]"))]
    shared = F.concat(F.lit("Q"), F.least(F.col("_bin"), F.lit(cfg.n_bins - 1)).cast("string"))
    rid = F.when(F.col("reason").isNull(), NO_REASON).otherwise(F.coalesce("_rid", F.lit(UNKNOWN_REASON)))
    return coded.select(
        "subject_id", "ts", "ts_seq", "kind", "kind_rank", "token", "value", "reason",
        F.coalesce("_aid", "_id", unknown).alias("tid"),
        F.when(leveled & ~F.col("fused"), F.col("_special")[shared]).alias("qid"),
        rid.cast("int").alias("rid"))


ORDER = ("ts_seq", "kind_rank", "token", "value", "reason", "dup", "slot")


def expand_positions(tokenised: DataFrame, budget: int | None = None) -> DataFrame:
    """One row per position: an unfused value follows its token at the same instant.

    Events alike in everything collapse to one row with a count first; of a run, no more than
    the last ``budget`` can ever be wanted.
    """
    keys = ["subject_id", "ts_seq", "kind_rank", "token", "value", "reason", "tid", "qid", "rid"]
    runs = tokenised.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    start = F.greatest(F.lit(1), F.col("_n") - F.lit(budget) + 1) if budget else F.lit(1)
    each = runs.withColumn("dup", F.explode(F.sequence(start.cast("bigint"), F.col("_n"))))
    item = lambda i, slot, r: F.struct(i.cast("int").alias("id"), F.lit(slot).alias("slot"), r.cast("int").alias("rid"))
    single = item(F.col("tid"), 0, F.col("rid"))
    value = item(F.col("qid"), 1, F.lit(NO_REASON))
    slots = F.when(F.col("qid").isNotNull(), F.array(single, value)).otherwise(F.array(single))
    return each.select("subject_id", "ts_seq", "kind_rank", "token", "value", "reason", "dup", F.inline(slots))


def recent_prefix(positions: DataFrame, examples: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` latest positions before each cutoff: subject_id, cutoff, recency (1 = latest), id, dt, rid.

    Positions are limited per (subject, stretch between cutoffs) before they meet the
    cutoffs. Both limits are rank filters, which Spark applies before the shuffle as well,
    so a subject with any number of events sends at most ``budget`` rows per map task.
    """
    latest = [F.col(c).desc() for c in ORDER]
    timed = positions.withColumn("ts", F.col("ts_seq"))
    placed = place_events(timed, examples).drop("ts")
    tail = placed.withColumn("_rank", F.row_number().over(W.partitionBy("subject_id", "seg").orderBy(*latest)))
    tail = tail.filter(F.col("_rank") <= budget).drop("_rank")
    cutoffs = place_cutoffs(examples.select("subject_id", "cutoff").distinct())
    met = tail.join(cutoffs, "subject_id").filter(F.col("seg") < F.col("hi"))
    ranked = met.withColumn("recency", F.row_number().over(W.partitionBy("subject_id", "cutoff").orderBy(*latest)))
    return ranked.filter(F.col("recency") <= budget).select(
        "subject_id", "cutoff", "recency", "id", days_between(F.col("ts_seq"), F.col("cutoff")).alias("dt"), "rid")


def assemble_sequences(prefix: DataFrame, examples: DataFrame, cohort: DataFrame, vocab: Vocabulary,
                       demographics: Sequence[str]) -> DataFrame:
    """One row per example: tokens (id, dt, rid) of header, body and anchor, length and age in days.

    The header takes the time of the first body position. Arrays are unpadded.
    """
    entry = F.struct("recency", "id", "dt", "rid")
    bodies = prefix.groupBy("subject_id", "cutoff").agg(
        F.reverse(F.array_sort(F.collect_list(entry))).alias("_body"))
    people = cohort.select("subject_id", "birthdate", *[
        F.concat(F.lit(f"{c}_"), F.coalesce(F.col(c), F.lit("NA"))).alias(f"_n{i}") for i, c in enumerate(demographics)])
    for i, _ in enumerate(demographics):
        people = people.join(vocab.tokens.select(F.col("token").alias(f"_n{i}"), F.col("id").alias(f"_d{i}")), f"_n{i}", "left")
    rows = examples.select("subject_id", "cutoff").join(people, "subject_id").join(bodies, ["subject_id", "cutoff"], "left")
    rows = rows.withColumn("_special", _special_ids(vocab.tokens, 0, ()))
    start = F.col("_special")[BOS]
    body = F.transform(F.coalesce(F.col("_body"), F.array().cast("array<struct<recency:int,id:int,dt:double,rid:int>>")),
                       lambda e: F.struct(e["id"].alias("id"), e["dt"].alias("dt"), e["rid"].alias("rid")))
    first = F.coalesce(F.try_element_at("_body", F.lit(1))["dt"], F.lit(0.0))
    fixed = lambda i, dt: F.struct(i.cast("int").alias("id"), dt.alias("dt"), F.lit(NO_REASON).cast("int").alias("rid"))
    header = F.array(fixed(start, first), *[fixed(F.coalesce(F.col(f"_d{i}"), start), first) for i, _ in enumerate(demographics)])
    end = F.array(fixed(F.col("_special")[ANCHOR], F.lit(0.0)))
    out = rows.select("subject_id", "cutoff", F.concat(header, body, end).alias("tokens"),
                      days_between(F.col("birthdate"), F.col("cutoff")).alias("age_days"))
    return out.withColumn("length", F.size("tokens"))


def body_budget(cfg: SequenceConfig, demographics: Sequence[str]) -> int:
    """Positions left for the body: the block less start, demographics and anchor."""
    return cfg.block_size - (1 + len(demographics)) - 1


def build_sequences(events: DataFrame, examples: DataFrame, cohort: DataFrame, vocab: Vocabulary, cfg: SequenceConfig,
                    kinds: Sequence[str], demographics: Sequence[str], answers: DataFrame | None = None,
                    whole_record: bool = False) -> DataFrame:
    """Sequences of the given examples from pre-anchor events, or from whole records."""
    budget = body_budget(cfg, demographics)
    source = events if whole_record else events.filter("is_pre_anchor")
    positions = expand_positions(tokenise_events(source, vocab, cfg, kinds, answers), budget)
    return assemble_sequences(recent_prefix(positions, examples, budget), examples, cohort, vocab, demographics)


def full_timeline_examples(events: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per given subject, cut a day after its last event."""
    last = events.join(subjects, "subject_id", "left_semi").groupBy("subject_id").agg(F.max("ts_seq").alias("last"))
    return last.select("subject_id", (F.col("last") + F.expr("interval 1 day")).alias("cutoff"))


def length_batches(sequences: DataFrame, batch_size: int, seed="batch") -> DataFrame:
    """Batches of similar length: rows in (length, md5) order cut every ``batch_size``.

    Lengths are few, so their counts are prefix-summed; inside one length a hash rank orders.
    """
    keyed = sequences.withColumn("_key", F.concat_ws("@", F.col("subject_id").cast("string"), F.col("cutoff").cast("string")))
    sizes = keyed.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("length").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = hash_rank(keyed, "_key", seed, ["length"]).join(starts, "length")
    batch = F.floor((F.col("_start") + F.col("rank")) / batch_size)
    return ranked.withColumn("batch", batch.cast("bigint")).drop("_key", "_start", "rank", "rank_n")


def permuted_control(sequences: DataFrame, columns: Sequence[str], seed=12345) -> DataFrame:
    """Each row keeps its key and takes the content of another row: rank under one seed meets rank under another."""
    keyed = sequences.withColumn("_key", F.concat_ws("@", F.col("subject_id").cast("string"), F.col("cutoff").cast("string")))
    own = hash_rank(keyed.select("subject_id", "cutoff", "_key"), "_key", seed).select("subject_id", "cutoff", "rank")
    other = hash_rank(keyed, "_key", f"{seed}:content").select(
        "rank", F.col("subject_id").alias("from_subject"), F.col("cutoff").alias("from_cutoff"), *columns)
    return own.join(other, "rank").drop("rank")


def audit_sequences(sequences: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Violation counts over all sequences; ``n`` shows the check is not empty."""
    facts = vocab.tokens.agg(F.max("id").alias("top"), F.max(F.when(F.col("token") == ANCHOR, F.col("id"))).alias("anchor"))
    fact = facts.select(F.struct("top", "anchor").alias("f")).scalar()
    t = sequences.withColumn("_f", fact)
    steps = F.zip_with(F.slice("tokens", 1, F.size("tokens") - 1), F.slice("tokens", 2, F.size("tokens") - 1),
                       lambda a, b: a["dt"] >= b["dt"])
    return t.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.forall("tokens", lambda x: (x["id"] >= 1) & (x["id"] <= F.col("_f.top")))).alias("id_out_of_range"),
        F.count_if(F.element_at("tokens", -1)["id"] != F.col("_f.anchor")).alias("no_anchor_at_end"),
        F.count_if(~F.forall(steps, lambda ok: ok)).alias("time_runs_back"),
        F.count_if(~F.forall("tokens", lambda x: x["dt"] >= 0)).alias("negative_dt"),
        F.count_if(F.col("length") != F.size("tokens")).alias("wrong_length"))
