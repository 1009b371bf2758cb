"""SimHash components and the token store against brute force and round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import token_store as T
from tidemark.llm.common import batch_bytes, scratch
from tidemark.llm.elias_fano import EliasFano
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.simhash_dedup import components, near_duplicates, near_pairs
from tidemark.llm.token_store import WordEncoder, document, read_tokens, write_tokens

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text, width=3):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, distance=2):
    label = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if bin(x ^ y).count("1") <= distance and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_components_of_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, " \n"), (1006, "a b c"), (1007, "A  b\tC")]
    docs = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in extra], COLUMNS)).withColumn("fp", F.lit("clash"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = [(d, plain_fingerprint(t)) for d, t in sorted(texts.items())]
    expected = plain_components(prints)
    got = near_duplicates(spark, docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{f:016x}" for d, f in prints}
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert near_duplicates(spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("distance, segments", [(2, 2), (3, 4), (4, 2)])
def test_multi_index_hashing_misses_no_pair(spark, distance, segments):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for k in range(1, distance + 2):
            prints.add(int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)))
    fps = sorted(prints)
    nodes = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    got = {(r["a"], r["b"]) for r in near_pairs(nodes, distance, segments).collect()}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= distance}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 300), (300, 250)]
    got = {r["id"]: r["component"] for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 250: 200, 300: 200}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano_round_trip(values):
    values.sort()
    e = EliasFano.encode(values)
    assert e.decode().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2_000, 10_000))
    assert EliasFano.encode(ends).size_bits() < 14 * len(ends)


TEXTS = ["Hello, world. It's A.B., x.. don't", "", None, "É́cole é Straße ﬁn İx ΑΣ Σ", "<|endoftext|> A <|ENDOFTEXT|>", "a b c\x0bd\x1ce",
         "12,34 .5 %%% *** pour%%%", "naïve, été. ß.", "日本語 text", "x" * 3000]


def test_word_memory_gives_the_ids_of_whole_texts():
    w = WordEncoder(tokenizer_path())
    texts = [(t or "").encode() for t in TEXTS]
    expected = [w.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in TEXTS]
    for _ in range(2):
        assert [x.tolist() for x in w.encode(texts, 1)] == expected


def test_token_files_round_trip(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("part", F.lit("clash"))
    rows = [(1000 + i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(5, "repeated", "en", "s", 0), (None, "no id", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(rows, COLUMNS).withColumn("part", F.lit("")))
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer_path(), parts=3, block_tokens=5_000)
    tokenizer = WordEncoder(tokenizer_path()).tokenizer
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected, start = [], 0
    for d, t in order:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == expected
    blocks = [r.asDict() for r in spark.read.parquet(path).orderBy("part", "seq").collect()]
    flat = [document(b, i).tolist() for b in blocks for i in range(b["n_docs"])]
    assert flat == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for _, t in order]


def test_no_documents(spark):
    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0), path, tokenizer_path())
    assert read_tokens(spark, path).collect() == []


def test_texts_reach_the_encoder_in_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    key, longest, encode = "spark.sql.execution.arrow.maxBytesPerBatch", 200 << 10, T.WordEncoder.encode
    before = spark.conf.get(key, None)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr(f"repeat('some words ', {longest // 11})").alias("text"))
    with batch_bytes(spark, 1 << 20):
        sizes = docs.select("text").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in it), "n long").collect()
    assert max(r["n"] for r in sizes) <= (1 << 20) + 2 * longest and len(sizes) >= 50
    assert spark.conf.get(key, None) == before
    seen = []
    monkeypatch.setattr(T, "batch_bytes", lambda s, most: (seen.append(most), batch_bytes(s, most))[1])
    T.write_tokens(docs.limit(5), str(tmp_path / "bounded"), tokenizer_path(), 1, parts=1)
    assert seen == [T.ENCODED_BYTES] and spark.conf.get(key, None) == before


def test_the_word_memory_takes_four_bytes_a_number():
    encoder = T.WordEncoder(tokenizer_path())
    words = [f"w{i}x".encode() for i in range(5_000)]
    ids = encoder.encode([b" ".join(words)], 1)[0]
    assert ids.tolist() == [*encoder.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, 1]
    assert all(x.itemsize == 4 for x in (encoder.begin, encoder.count, encoder.flat))
