"""Mixing against plain Python: water-filled targets, highest quotients, exact word counts."""

import heapq
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.mixing import apportion, mix, mixed_documents, sized, source_targets

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fill(sizes, weights, share, epochs):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > epochs * sizes[s]]
        if not over:
            target.update({s: left * w[s] / sum(w[x] for x in free) for s in free})
            break
        for s in over:
            target[s] = epochs * sizes[s]
            free.discard(s)
    return target


def test_targets_match_repeated_resharing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = mix(sized(docs)).collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words[r["doc_id"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    expected = fill(sizes, (5, 2, 1), 1.5, 2)
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - expected[r["source"]]) < 1e-6
    assert all(abs(taken[s] - expected[s]) <= 64 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mix(sized(docs)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_full_share_takes_every_word(spark):
    s = spark.createDataFrame([("a", 10), ("b", 7), (None, 3)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(s, (5, 2, 1), 2.0, 2.0).collect()}
    assert got == {"a": 20.0, "b": 14.0, None: 6.0}


def test_apportion_equals_the_quotient_queue(spark):
    for votes, seats in (([53, 24, 23], 7), ([1, 1, 1, 1, 1000], 3), ([5] * 6, 4), ([0, 10, 0], 5), ([3, 2], 0), ([900, 1, 50, 49], 100)):
        df = spark.createDataFrame([("g", i, float(v), seats) for i, v in enumerate(votes)], "g string, i int, w double, s int")
        got = {r["i"]: r["quota"] for r in apportion(df, ["g"], "w", "s", ["i"]).collect()}
        queue, expected = [(-v / 1, i, 0) for i, v in enumerate(votes) if v], dict.fromkeys(range(len(votes)), 0)
        heapq.heapify(queue)
        for _ in range(seats):
            _, i, q = heapq.heappop(queue)
            expected[i] += 1
            heapq.heappush(queue, (-votes[i] / (2 * q + 3), i, q + 1))
        assert got == expected, (votes, seats)


def test_edges_of_the_mix(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "x y z", None, "a", 5), (3, "x y z", None, "a", 5), (None, "one two", "en", "", 7)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("extra", F.lit(1))
    got = mix(sized(docs)).collect()
    assert len(got) == 5 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["source"] for r in got} == {"a", "", None}
    assert mix(sized(docs.limit(0))).collect() == []
    assert mixed_documents(docs.limit(0)).columns == docs.columns


def test_documents_of_the_mix_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mix(sized(docs)).collect()}
    words = {}
    for r in mixed_documents(docs).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {d: n for d, n in taken.items() if n}


@pytest.mark.parametrize("blocks", [256, 1, 0.01])
def test_a_small_source_meets_its_target_beside_a_large_one(spark, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "DOCS_PER_SHARD", 10)
    monkeypatch.setattr(mixing, "BLOCKS_PER_SHARD", blocks)
    rows = [(d, "w " * 10, "en", "a", 0) for d in range(300)] + [(1_000 + d, "w " * (40 + d % 90), "en", "b", 0) for d in range(1_500)]
    got = mix(sized(spark.createDataFrame(rows, COLUMNS)), weights=(5, 1), share=1.2).collect()
    assert all(r["taken"] <= 2 * r["size"] and sum(x["to"] - x["from"] for x in r["runs"]) == r["taken"] for r in got)
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 64


def test_columns_of_any_name_pass_through_the_mix(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 300, "en", "ab"[k % 2], 900) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("target", "source_size", "size", "taken", "runs", "_run", "_row", "_mark", "_source", "_text", "quota", "a.b")
    wide = docs
    for name in names:
        wide = wide.withColumn(name, F.lit(name))
    plain, got = mixing.mixed_documents(docs).collect(), mixing.mixed_documents(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[n] == n for r in rows for n in names)
    key = lambda r: (r["doc_id"], r["text"], r["n_chars"])
    assert sorted(map(key, rows)) == sorted(map(key, plain)) and rows


def test_texts_are_neither_sorted_nor_laid_in_windows(spark):
    rows = [(k, f"w{k} " * 30, "en", "ab"[k % 2], 90) for k in range(20)]
    plan = mixed_documents(spark.createDataFrame(rows, COLUMNS))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"^\(\d+\) (\w+)[^\n]*\n(.*?)(?=^\(\d+\) |\Z)", plan, re.M | re.S)
    holds = {name for name, body in nodes if re.search(r"^Input[^\n]*\b(text|_row)#", body, re.M)}
    assert "ShuffledHashJoin" in {name for name, _ in nodes} and not holds & {"Sort", "Window", "SortMergeJoin"}, holds
