"""Exact dedup, chat formatting and license scans on planted rows and against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from tidemark.llm import queries
from tidemark.llm.chat_format import format_chats
from tidemark.llm.exact_dedup import DigestIndex
from tidemark.llm.license_scan import BASE_PHRASES, NOTICES, PositionalIndex, make_templates, scan_licenses, words_of

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, name):
    _, message = compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name])
    assert not message, message


def test_exact_dedup_edges_and_second_batch(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (9, "a b"), (7, None), (8, ""), (None, "a b"), (1, " "), (3, " ")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], COLUMNS).withColumn("digest", F.lit("clash"))
    index = DigestIndex(spark)
    got = index.ingest(docs).collect()
    assert len(got) == len(rows)
    kept = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"])
    assert kept == [(1, 1, 1), (2, 2, 5), (3, 3, 1), (7, 7, 2)]
    assert {r["text_sha256"] for r in got if r["doc_id"] == 5} == {hashlib.sha256(b"a b").hexdigest()}
    later = spark.createDataFrame([(0, "a b", "en", "s", 1), (10, "new", "en", "s", 1)], COLUMNS)
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in index.ingest(later).collect()) == [(0, 2, False), (10, 10, True)]
    assert index.rows().count() == 5
    assert DigestIndex(spark).ingest(docs.limit(0)).collect() == []


def test_repeated_row_is_kept_once(spark):
    docs = spark.createDataFrame([(4, "x", "en", "s", 1)] * 3, COLUMNS)
    assert sorted(r["kept"] for r in DigestIndex(spark).ingest(docs).collect()) == [False, False, True]


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
            (3, 1, "assistant", "yo"), (4, 0, "user", None), (5, 0, None, "hi"), (None, 0, "user", "hi"), (None, 0, "user", "alone"),
            (6, None, "user", ""), (7, 0, "user", "hi"), (7, 1, "assistant", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(0))
    got = {(r["conv_id"], r["n_turns"], r["n_copies"], r["text"]) for r in format_chats(spark, df).collect()}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {(1, 2, 2, line("user", "hi") + line("assistant", "yo")), (7, 2, 1, line("user", "hi") + line("assistant", "other")),
                   (4, 1, 2, line("user", "")), (5, 1, 1, line("", "hi")), (None, 1, 1, line("user", "alone"))}
    assert format_chats(spark, df.limit(0)).collect() == []


def test_chats_that_render_alike_are_one(spark, tmp_path):
    """A null text or role counts as empty, rows without conv_id stay apart, and the SQL says the same."""
    rows = [(1, 0, "user", None), (1, 1, "assistant", "yo"), (2, 0, "user", ""), (3, 0, "user", ""), (3, 0, "user", None), (4, 0, None, "x" * 200_000),
            (5, 0, "", "x" * 200_000), (None, 0, "user", "alone"), (None, 1, "user", "other"), (None, 1, "user", "other"), (None, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_chats(spark, df)
    assert {(r["conv_id"], r["n_turns"], r["n_copies"]) for r in got.collect()} == {(1, 2, 1), (4, 1, 2), (None, 1, 1)}
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = connect(FOLDER)
    con.execute(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    _, message = compare(got, con, queries.SQL["op3_chat_formatting"])
    assert not message, message


def plain_scan(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    hits = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.encode().split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_places(spark):
    texts = [None, "", "Under the MIT License, under_the-mit license!", "cc by nc cc by nc", "mit license", "Apache License, Version 2.0",
             "under the mité license", "\x7f`under`the`mit`license", "under the mit under the mit license", "cc by cc by nc"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS).withColumn("score", F.lit("clash"))
    docs = docs.unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({"doc_id": F.col("doc_id") + 100, "score": F.lit("")}))
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in scan_licenses(spark, docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(by[r["doc_id"]]), by[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert scan_licenses(spark, docs.limit(0)).collect() == []


def test_every_notice_is_found_and_needs_its_key_phrase():
    templates = make_templates()
    index = PositionalIndex(templates, {})
    for label, (text, keys) in NOTICES.items():
        words = words_of(f"Some File. {text.upper()} and more".encode())
        assert label in {templates[n].label for n, *_ in index.find(words)}
        broken = text
        for k in keys:
            broken = broken.replace(k, k.replace(" ", " zzz ", 1))
        assert (label, False) not in {(templates[n].label, templates[n].exact) for n, *_ in index.find(words_of(broken.encode()))}
