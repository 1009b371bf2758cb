"""Suffix-array removal and its interval tree against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import RepeatIndex, anchors, common_prefix, interval_tree, remove_repeats

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_force(texts, length=200):
    starts = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            starts[t[i:i + length]].append((d, i))
    cover = [bytearray(len(t)) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i:i + length] = b"\1" * length
    out = []
    for t, c in zip(texts, cover):
        kept = bytes(x for x, y in zip(t, c) if not y)
        runs = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
        out.append((len(t), sum(c), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, **extra):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("anchor", F.lit("clash"))
    got = sorted(tuple(r) for r in remove_repeats(spark, docs, **extra).collect())
    expected = [(i, *x) for i, x in enumerate(brute_force([(t or "").encode() for t in texts]))]
    assert got == expected, [(g, e) for g, e in zip(got, expected) if g != e][:5]


def test_documents_match_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(90), text(300)
    texts = [None, "", "x" * 150, "y" * 199, "y" * 200, "z" * 700, "ab" * 400, text(50), base, base, base[:-50] + text(20)]
    texts += [text(30) + passage + text(30) for _ in range(12)] + [passage[:250], passage[-230:], passage * 3]
    for _ in range(12):  # near copies
        cut = sorted(rng.sample(range(len(base)), 3))
        texts.append("".join(base[a:b] + rng.choice("xyzw") for a, b in zip([0, *cut], [*cut, len(base)])))
    q = text(400).encode()[:201].decode(errors="ignore")
    return [*texts, q, "q" + q, q[1:]]


def test_planted_repeats(spark, planted):
    check(spark, planted)


def test_crowded_anchors_give_the_same(spark, planted, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", 2)
    check(spark, planted)


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    docs = spark.createDataFrame([(7, t, "en", "s", 0), (7, t, "en", "s", 0), (None, t[:300], "en", "s", 0), (8, None, "en", "s", 0)], COLUMNS)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in remove_repeats(spark, docs).collect()), key=str)
    assert got == [(7, 400, 400), (7, 400, 400), (8, 0, 0), (None, 300, 300)]
    assert remove_repeats(spark, docs.limit(0)).collect() == []


def test_groups_are_maximal_and_complete(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    r = noise(240)
    texts = [noise(50) + r + noise(60), noise(90) + r + noise(10), noise(20) + r + noise(99)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)
    groups = defaultdict(set)
    for g in RepeatIndex(spark, docs).groups().collect():
        groups[g["anchor"], g["low"], g["high"], g["depth"]].add((g["doc_id"], g["start"]))
    for (*_, depth), places in groups.items():
        strings = {texts[d][i:i + depth] for d, i in places}
        assert len(strings) == 1 and len(places) > 1
    assert any(len(places) == 3 and (0, texts[0].index(r)) in places for places in groups.values())


def test_crowded_anchors_lose_no_start(spark, monkeypatch):
    """Every place of 40 passages stands in a group, and the place where it starts is one, however many contexts a task may hold."""
    rng = random.Random(21)
    noise = lambda n: "".join(rng.choice("abcdefghijklm") for _ in range(n))
    passages = [noise(rng.randint(205, 478)) for _ in range(40)]
    texts, places = [], set()
    for p in passages:
        for k in range(6):
            # The bytes before a passage are equal in some documents and differ in others.
            head = noise(rng.randint(20, 60)) + "xxyzwy"[k]
            places.add((len(texts), len(head)))
            texts.append(head + p + noise(30))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)
    for rows in (1_024, 2):
        monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", rows)
        groups = defaultdict(set)
        for g in RepeatIndex(spark, docs).groups().collect():
            groups[g["anchor"], g["low"], g["high"], g["depth"]].add((g["doc_id"], g["start"]))
        assert places <= set().union(*groups.values()), rows
        for (*_, depth), members in groups.items():
            assert len({texts[d][i:i + depth] for d, i in members}) == 1 and len(members) > 1
        # Those that start a passage are together with its five other copies.
        assert all(any(m >= {(6 * (d // 6) + k, places_of[6 * (d // 6) + k]) for k in range(6)} for m in groups.values())
                   for places_of in [dict(places)] for d, _ in places), rows


def test_interval_tree_lists_every_interval():
    rng = random.Random(1)
    for _ in range(50):
        words = sorted("".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(12))
        lcp = [0, *(common_prefix(a.encode(), b.encode()) for a, b in zip(words, words[1:]))]
        expected = set()
        for i in range(len(words)):
            for j in range(i + 1, len(words)):
                d = min(lcp[i + 1:j + 1])
                if d >= 2 and (i == 0 or lcp[i] < d) and (j + 1 == len(words) or lcp[j + 1] < d):
                    expected.add((d, i, j))
        assert set(interval_tree(lcp, 2)) == expected


def test_segments_of_a_long_text_have_the_same_anchors(monkeypatch):
    text = random.Random(2).randbytes(5_000)
    whole = anchors(text)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = anchors(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_ranges_are_numbers(spark):
    """The widest shuffle of op1 carries ranges; as structures they took four times as many bytes."""
    rng = random.Random(8)
    common = "".join(rng.choices("abcdefgh", k=300))
    texts = ["".join(rng.choices("ijkl", k=40)) + common, common + "tail", "x" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = RepeatIndex(spark, docs).spans()
    assert dict(spans.dtypes)["spans"] == "array<bigint>"
    found = {r["d"]: sorted(divmod(v, 1 << 32) for v in r["spans"]) for r in spans.collect()}
    assert set(found) == {0, 1}
    assert min(found[0])[0] == 40 and max(b for _, b in found[0]) == 340
    assert min(found[1])[0] == 0 and max(b for _, b in found[1]) == 300
