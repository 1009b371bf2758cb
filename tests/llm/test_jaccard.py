"""Links of similar shingle sets, and the pipeline's near-duplicate stage, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.jaccard_dedup import shingle_set, similar_pairs
from tidemark.llm.simhash_dedup import components, simhash, shingle_hashes

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_components(rows, links=()):
    sets = [(d, shingle_set((t or "").encode(), 5)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        label[b] = a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y), 1):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 9 * shared >= 4 * (len(x) + len(y)):
                    join(a, b)
    for a, b in links:
        join(a, b)
    return {d: root(d) for d in label}


def planted(docs):
    """Loose copies at every similarity around 0.8, a chain, a large group around one text, and edges."""
    rng, out, n = random.Random(1), [], 5_000
    texts = [r["text"].split() for r in docs.orderBy("doc_id").limit(25).collect()]
    for words in texts[:20]:
        for k in (1, 2, 3, 4, 5, 8):
            w = list(words)
            for at in rng.sample(range(len(w)), min(len(w), max(1, len(w) * k // 200))):
                w[at] = f"x{rng.randrange(9_999)}"
            out.append((n := n + 1, " ".join(w)))
    for k in range(60):
        out.append((n := n + 1, " ".join(texts[20] + [f"tail{k}_{j}" for j in range(len(texts[20]) // 20 * (1 + k % 5))])))
    chain = texts[21]
    for k in range(6):
        chain = chain[len(chain) // 15:] + [f"link{k}_{j}" for j in range(len(chain) // 15)]
        out.append((n := n + 1, " ".join(chain)))
    return out + [(1, "a b c d e f g"), (6_000, None), (6_001, ""), (6_002, "one"), (6_003, "ONE"), (6_003, "two"), (None, " ".join(texts[0]) + " end")]


def test_links_join_every_similar_pair_and_no_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    both = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in planted(docs)], COLUMNS))
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    expected = brute_components(rows)
    for sample in (20_000, 0):  # the order of shingles changes the work, not the result
        got = {r["id"]: r["component"] for r in components(spark, similar_pairs(spark, both, sample_docs=sample)).collect()}
        assert {d: got.get(d, d) for d in expected} == expected
    assert len(set(expected.values())) < len(expected) - 100
    assert similar_pairs(spark, docs.limit(0)).collect() == []


def test_stage_drops_copies_beyond_three_bits(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = planted(docs)
    first = {d: simhash(shingle_hashes(t.encode(), 5)) for d, t in extra if t}
    assert sum(bin(first[5_001] ^ f).count("1") > 3 for f in first.values()) > 100
    both = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in extra], COLUMNS))
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, both, FOLDER).collect()}
    # Of the two texts of 6003 one is a copy of 6002 and the other a document of its own.
    assert (6_003, "two") in left and (6_003, "ONE") not in left
    left = {d for d, t in left if (d, t) != (6_003, "two")}
    group = brute_components([(r["doc_id"], r["text"]) for r in both.collect() if r["text"] != "two"])
    assert left <= {None} | {d for d, c in group.items() if d == c}


def test_texts_that_share_a_doc_id_are_judged_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(80)) for k in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b + " end"), (3, a + " end"), (4, c), (4, c), (5, c + " end"), (5, "other words"), (None, c), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS)
    for name in ("_key", "_mark", "_low", "_rank", "component", "first", "id", "node", "_row"):
        docs = docs.withColumn(name, F.lit(name))
    left = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert left.columns == docs.columns and all(r["_key"] == "_key" and r["_row"] == "_row" for r in left.collect())
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (4, c), (5, "other words"), (None, c), (None, None)], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), FOLDER).collect() == []


def test_a_long_chain_settles(spark):
    pairs = spark.range(3_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(spark, pairs).collect()} == {0}
