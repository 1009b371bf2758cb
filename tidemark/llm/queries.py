"""One query for each training-data operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.chat_format import format_chats
from tidemark.llm.common import scratch, table
from tidemark.llm.decontamination import find_leaks
from tidemark.llm.exact_dedup import DigestIndex
from tidemark.llm.html_extraction import extract_pages
from tidemark.llm.language_id import fit_language_model, held_out, identify
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.merkle import prove_documents
from tidemark.llm.mixing import mix, sized
from tidemark.llm.period_runs import periodic_runs
from tidemark.llm.simhash_dedup import near_duplicates
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_store import read_tokens, write_tokens
from tidemark.llm.window_dedup import remove_repeated_windows

END_ID = 1


def tokenizer_path() -> str:
    """The public tokenizer the queries use; ``TIDEMARK_TOKENIZERS`` names another folder of them."""
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return f"{folder}/word_bpe_49k.json"
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without strings of 200 bytes that occur elsewhere."""
    return remove_repeats(spark, table(spark, folder, "documents"), length=200)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal logged conversations, rendered."""
    return format_chats(spark, table(spark, folder, "conversations"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, folder, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most 2 bits."""
    return near_duplicates(spark, table(spark, folder, "documents"), width=3, distance=2, segments=2)


def op6_token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets, lengths and checksums read back from the token files."""
    path = scratch(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, tokenizer_path(), END_ID)
    return read_tokens(spark, path)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit_language_model(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of each document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mix(sized(docs).drop("text"), weights=(5, 2, 1), share=1.5, epochs=2).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row that stays of its texts."""
    return DigestIndex(spark).ingest(table(spark, folder, "documents"))


def op10_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan_licenses(spark, table(spark, folder, "documents"))


def op11_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without windows of 13 words that an earlier document holds."""
    found = remove_repeated_windows(spark, table(spark, folder, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document, checked against a copy in which half of the texts have lost their line ends."""
    lost = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = prove_documents(spark, table(spark, folder, "documents"), text)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text repeats a stretch of its words up to its end, as the contract of op13 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    g = F.floor(F.col("h") / 10)
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    told = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of each document and what is left when each is cut to its first period."""
    found = periodic_runs(with_repeats(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_chat_formatting, op4_html_extraction, op5_simhash_near_dedup,
                                   op6_token_output, op7_language_id, op8_source_mixing, op9_exact_dedup, op10_license_scans,
                                   op11_window_dedup, op12_merkle_manifest, op13_periodic_runs)}


def _leaf_sql(text: str) -> str:
    return " || ".join(f"coalesce(strlen({c})::varchar || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))


SQL = {
    "op3_chat_formatting": r"""
with turns as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
keyed as (select *, case when conv_id is null then row_number() over () end as own from turns),
placed as (
  select conv_id, own, row_number() over w as length, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line
  from keyed window w as (partition by conv_id, own order by turn nulls first, role, text)),
prefixes as (
  select conv_id, length, max(length) over (partition by conv_id, own) as n,
         string_agg(line, '') over (partition by conv_id, own order by length) as body from placed),
whole as (select min(conv_id) as conv_id, length, body, count(*) as n_copies from prefixes where length = n group by length, body)
select conv_id, length::INTEGER as n_turns, n_copies, body as text from whole w
where not exists (select 1 from prefixes p where p.length < p.n and p.length = w.length and p.body = w.body)""",
    "op9_exact_dedup": r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)""",
    "op11_window_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from d, unnest(range(1, len(w) - 11)) as t(i)),
hits as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as low from windows) where low < doc_id),
gone as (select distinct doc_id, i + j as i from hits, range(13) as r(j)),
words as (select doc_id, i, w[i] as word from d, unnest(range(1, len(w) + 1)) as t(i)),
kept as (select doc_id, string_agg(word, ' ' order by i) as body, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, len(w)::BIGINT as n_words, (len(w) - coalesce(n, 0))::BIGINT as n_removed, sha256(coalesce(body, '')) as kept_sha256
from d left join kept using (doc_id)""",
    "op12_merkle_manifest": f"""
with recursive
d as (select *, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::UBIGINT), lambda x, b:
             list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)), xor(x, b)),
             4294967295::UBIGINT), 4294967295::UBIGINT) % 2 = 0 as lost from documents),
leaf as (select doc_id, source, sha256({_leaf_sql("text")}) as node, sha256({_leaf_sql("case when lost then replace(text, chr(10), '') else text end")}) as seen from d),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, node) - 1 as place, count(*) over (partition by source) as n from leaf),
up as (
  select source, 0 as level, place, node, n from placed
  union all
  select source, level + 1, place // 3, sha256(string_agg(node, '' order by place)), (n + 2) // 3 from up where n > 1 group by source, level, place // 3, n),
root as (select source, node as subroot, row_number() over (order by source nulls first) - 1 as spot, count(*) over () as m from up where n = 1),
over_ as (
  select 0 as level, spot as place, subroot as node, m as n from root
  union all
  select level + 1, place // 3, sha256(string_agg(node, '' order by place)), (n + 2) // 3 from over_ where n > 1 group by level, place // 3, n),
-- Every node of both trees that has runs above it: the lower tree's levels first.
both_ as (
  select coalesce(':' || source, '-') as tree, level, place, node from up where n > 1
  union all select '', level, place, node from over_ where n > 1),
start as (select doc_id, coalesce(':' || p.source, '-') as tree, place, spot, n, m, node as leaf, seen, subroot
          from placed p join root r on p.source is not distinct from r.source),
fold as (
  select doc_id, leaf, subroot, tree, spot, 0 as level, case when n > 1 then place else spot end as place, case when n > 1 then n else m end as n, n > 1 as low, m, seen, '' as proof
  from start
  union all
  select f.doc_id, f.leaf, f.subroot, f.tree, f.spot, case when f.low and f.n <= 3 then 0 else f.level + 1 end,
         case when f.low and f.n <= 3 then f.spot else f.place // 3 end, case when f.low and f.n <= 3 then f.m else (f.n + 2) // 3 end, f.low and f.n > 3, f.m,
         sha256(string_agg(case when b.place = f.place then f.seen else b.node end, '' order by b.place)),
         f.proof || coalesce(string_agg(b.node, '' order by b.place) filter (b.place <> f.place), '')
  from fold f join both_ b on b.tree = case when f.low then f.tree else '' end and b.level = f.level and b.place // 3 = f.place // 3
  where f.n > 1 group by f.doc_id, f.leaf, f.subroot, f.tree, f.spot, f.level, f.place, f.n, f.low, f.m, f.seen, f.proof)
select doc_id, leaf, subroot, r.root, sha256(proof) as proof_sha256, seen as folded_root, seen = r.root as verified
from fold, (select node as root from over_ where n = 1) r where not low and fold.n = 1""",
}
