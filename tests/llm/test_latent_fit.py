"""The latent space of op2 is fitted on every passage of every document."""

import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import decontamination as D


def _plain(texts, weights, idf, thin):
    """A.T @ (A @ thin), a passage at a time."""
    total = np.zeros((D.BUCKETS, thin.shape[1]))
    for text, weight in zip(texts, weights):
        b = D.word_buckets(D.words_of(text))
        for a in range(0, max(1, len(b) - D.HALF), D.HALF):
            part = b[a:a + 2 * D.HALF]
            row = np.bincount(part, minlength=D.BUCKETS) * idf
            if len(part):
                total += weight * np.outer(row, row @ thin) / (idf[part] ** 2).sum()
    return total


def test_products_are_those_of_single_passages(monkeypatch):
    rng = random.Random(3)
    sizes = (0, 1, 15, 16, 17, 31, 32, 33, 48, 49, 500)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(n)).encode() for n in sizes]
    idf = np.random.default_rng(1).uniform(0.1, 3.0, D.BUCKETS).astype(np.float32)
    thin = np.random.default_rng(2).standard_normal((D.BUCKETS, 5)).astype(np.float32)
    weights = np.array([rng.choice([0.25, 1.0, 8.0]) for _ in sizes])
    scaled = np.append(idf[:, None] * thin, np.zeros((1, 5), np.float32), axis=0)
    for halves in (3, 512):
        monkeypatch.setattr(D, "FIT_HALVES", halves)
        total = np.zeros_like(scaled)
        D._multiply(D.Texts(texts), weights, scaled, np.append(idf, 0.0).astype(np.float32), total)
        assert np.allclose(total[:D.BUCKETS], _plain(texts, weights, idf, thin), rtol=1e-3, atol=1e-3) and not total[D.BUCKETS].any()


def test_the_space_covers_all_documents_and_whole_texts(spark, monkeypatch):
    docs = spark.range(1_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(9_000, "long " * 2_000 + "end"), (9_001, None)], "doc_id long, text string"))
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    seen, fit = [], D.randomised_svd
    monkeypatch.setattr(D, "randomised_svd", lambda passages, *a, **b: (seen.append(passages), fit(passages, *a, **b))[1])
    assert len(list(D.index_passes(docs, benchmark))) == 1
    got = sorted((r["text"], r["weight"]) for r in seen[0].collect())
    assert len(got) == 1_502 and max(len(t) for t, _ in got) == 10_003
    assert len({w for t, w in got if not t.startswith("one")}) == 1


def test_words_that_recur_in_many_halves_are_given_back_whole():
    rng = np.random.default_rng(4)
    buckets = np.where(rng.random(900 * D.HALF) < 0.5, 7, rng.integers(0, 300, 900 * D.HALF))
    buckets[-40:] = D.BUCKETS  # padding
    sums = rng.standard_normal((901, 5)).astype(np.float32)
    sums[-1] = 0
    idf = np.append(rng.uniform(0.1, 3.0, D.BUCKETS), 0.0).astype(np.float32)
    total, plain = np.zeros((D.BUCKETS + 1, 5), np.float32), np.zeros((D.BUCKETS + 1, 5))
    D._give_back(sums, buckets.astype(np.uint16), idf, total)
    np.add.at(plain, buckets, sums[np.arange(len(buckets)) // D.HALF] * idf[buckets][:, None])
    assert np.allclose(total, plain, rtol=1e-3, atol=1e-3)


def test_an_index_travels_without_its_widest_matrix():
    rng = np.random.default_rng(6)
    items = [D.Item(i, [f"w{rng.integers(4_000)}".encode() for _ in range(60)], []) for i in range(40)]
    idf = rng.uniform(0.5, 4.0, D.BUCKETS)
    basis = np.linalg.qr(rng.standard_normal((D.BUCKETS, 8)))[0].astype(np.float32)
    index = D.LatentIndex(items, idf, basis, 0.4, 0.8, 0.5)
    assert len(pickle.dumps(index)) < 0.25 * index.rows.nbytes
    again = pickle.loads(pickle.dumps(index))
    assert len(pickle.dumps(again)) < 0.25 * index.rows.nbytes
    # Every passage is kept by half at least, and its latent vector has the length that the index says it has.
    text = D.Texts([b" ".join(item.words) for item in items])
    z = again.project(text, np.flatnonzero(text.opens))
    assert (index.kept > 0.49).all() and np.allclose((z * z).sum(axis=1), index.kept, atol=1e-3)
    assert np.allclose((z * again.passages).sum(axis=1), 1.0, atol=1e-3)
    wide = index.rows[:-1, :-1] / index.weights[:-1, None]
    assert np.allclose(wide.T @ wide, np.eye(wide.shape[1]), atol=1e-3)
    text = [b"nothing here", b"a " + b" ".join(items[3].words[:55]) + b" tail"]
    assert [[m[0] for m in found] for found in again.search(D.Texts(text))] == [[], [3]]


def test_the_corpus_is_split_into_words_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Alpha beta beta gamma"), (2, None), (3, "beta"), (4, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    seen, fit = {}, D.randomised_svd

    def spied(passages, idf, *a, words, **b):
        seen["idf"] = idf
        seen["words"] = sorted((bytes(r["words"]), r["weight"]) for r in words.collect() if r["words"])
        seen["plain"] = sorted((D.word_buckets(D.words_of(r["text"].encode())).astype(np.uint16).tobytes(), r["weight"]) for r in passages.collect() if r["text"])
        return fit(passages, idf, *a, words=words, **b)

    monkeypatch.setattr(D, "randomised_svd", spied)
    assert len(list(D.index_passes(docs, benchmark))) == 1
    assert seen["words"] == seen["plain"] and len(seen["words"]) == 3
    held = {w: seen["idf"][D.word_buckets([w])[0]] for w in (b"alpha", b"beta", b"six")}
    # Four documents, of which one holds the first word, two the second and none the third.
    assert np.allclose([held[b"alpha"], held[b"beta"], held[b"six"]], np.log(5.0 / np.array([2.0, 3.0, 1.0])) + 0.01)
