"""Word windows, Merkle proofs and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries, window_dedup
from tidemark.llm.merkle import fold, path, prove_documents, siblings
from tidemark.llm.period_runs import Positions, collapsed, periodic_runs, runs_of
from tidemark.llm.window_dedup import remove_repeated_windows, super_kmers

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Windows

def plain_windows(rows, window):
    low = {}
    for d, text in rows:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            low[k] = min(low.get(k, np.inf), np.inf if d is None else d)
    out = []
    for d, text in rows:
        w = words_of(text)
        gone = {i + j for i in range(len(w) - window + 1) if low[tuple(w[i:i + window])] < (np.inf if d is None else d) for j in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], COLUMNS)


def hot_rows(n=160):
    """A third of the rows share one line in ever new surroundings, another third is one text."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    line = " ".join(word() for _ in range(15))
    copy = " ".join(word() for _ in range(40))
    rows = []
    for i in range(n):
        body = [word() for _ in range(rng.randrange(5, 60))]
        rows.append((rng.randrange(n), copy if i % 3 == 0 else " ".join([*body, line, *body[::-1]]) if i % 3 == 1 else "  ".join(body) + "\n"))
    return rows


@pytest.mark.parametrize("bucket_rows", [2, 4_096])
def test_windows_match_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(window_dedup, "BUCKET_ROWS", bucket_rows)
    long = " ".join(f"v{i % 997}x{i % 13}" for i in range(30_000))
    rows = [*hot_rows(), (None, None), (5, ""), (6, " \n\t"), (None, long), (900, long), (901, "a " * 2_000), (902, "a " * 600), (901, "a " * 2_000),
            (903, "a " * 12), (904, "a " * 12), (None, "a " * 13), (-3, "b " * 13 + "end"), (-2, "start " + "b " * 13), (905, "é x " * 13), (906, "é x " * 14)]
    docs = documents(spark, rows).withColumn("doc", F.lit("clash")).withColumn("mark", F.lit(1)).withColumn("place", F.lit(1))
    got = remove_repeated_windows(spark, docs.repartition(7)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=str) == plain_windows(rows, 13)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_windows_of_an_empty_table(spark):
    assert remove_repeated_windows(spark, documents(spark, [(1, "x")]).limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=700), max_size=4), st.integers(1, 9))
def test_super_kmers_hold_every_window_once(texts, window):
    flat = [b"%d" % w for t in texts for w in t]
    ends = np.cumsum([len(t) for t in texts]).astype(int)
    m, first, n = super_kmers(flat, ends, window)
    seen = {}
    for name, a, k in zip(m.tolist(), first.tolist(), n.tolist()):
        for i in range(a, a + k):
            assert i not in seen
            seen[i] = name
    whole = {i for e, t in zip(ends.tolist(), texts) for i in range(e - len(t), e - window + 1)}
    assert set(seen) == whole and (not len(n) or n.max() <= 255)
    by = {}
    for i, name in seen.items():  # equal windows meet in one bucket
        assert by.setdefault(tuple(flat[i:i + window]), name) == name


def test_repeated_rows_are_found_over_any_batches():
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 30)
        rows = [(rng.randrange(8), 1, 2, -1 if rng.random() < .15 else i, False) for i in range(n)]
        sure = [(rng.randrange(8), 1, 2, 100 + i, True) for i in range(rng.randrange(4))]
        count = {}
        for r in rows:
            count[r[0]] = count.get(r[0], 0) + 1
        rows = sorted(rows, key=lambda r: r[0]) + sure
        expected = sorted(r[3] for r in rows if r[3] >= 0 and (r[4] or count[r[0]] > 1))
        batches, at = [], 0
        while at < len(rows):
            k = rng.randrange(0, 5)
            batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at:at + k])] if k and rows[at:at + k] else
                                                      [pa.array([], t) for t in (pa.int64(),) * 4 + (pa.bool_(),)], ["m", "doc", "mark", "place", "sure"]))
            at += k
        assert sorted(p for b in window_dedup._repeated(iter(batches)) for p in b.column(3).to_pylist()) == expected


# Merkle manifest

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(nodes):
    paths = [[] for _ in nodes]
    groups = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for k, node in enumerate(nodes):
            run = nodes[k - k % 3:k - k % 3 + 3]
            for i in groups[k]:
                paths[i].append((k % 3, run[:k % 3] + run[k % 3 + 1:]))
        groups = [sum(groups[i:i + 3], []) for i in range(0, len(nodes), 3)]
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return (nodes[0] if nodes else None), paths


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) in the contract's terms."""
    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    low = lambda v: (v is not None, b"" if v is None else str(v).encode())
    sources = sorted({r[3] for r in rows}, key=low)
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *plain_root([leaf(r, r[1]) for r in own])))
    root, above = plain_root([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, above):
        for r, steps in zip(own, paths):
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf(r, text)
            for at, others in steps + top:
                node = sha("".join(others[:at] + [node] + others[at:]))
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(x for _, o in steps + top for x in o)), node, node == root))
    return sorted(out, key=str)


def manifest(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("tree", F.lit("clash")).withColumn("node", F.lit(0)).withColumn("seen", F.lit(0))
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], sha(r["proof"]), r["folded_root"], r["verified"])
                   for r in prove_documents(spark, docs.repartition(5), text).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_matches_plain_python(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(i, rng.choice([None, "", "a\nb", "x" * i, "\n"]), rng.choice([None, "en"]), rng.choice(["hot"] * 6 + [None, "", "-", ":", "é", "b"]), rng.choice([None, i]))
            for i in range(120)]
    rows += [(None, "x", "en", "hot", 1), (None, "y\n", None, None, 2), (7, "other", "en", "hot", 1), (7, "other", "en", "hot", 1), (8, "a\n" * 50_000, "fr", "lone", 1)]
    assert manifest(spark, rows) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 10])
def test_manifest_of_small_trees(spark, n):
    one = [(i, f"t{i}\n", "en", "s", 1) for i in range(n)]
    each = [(i, f"t{i}\n", "en", f"s{i:02}", 1) for i in range(n)]
    for rows in ([one, each] if n else [[]]):
        assert manifest(spark, rows) == plain_manifest(rows)


def test_path_of_a_lone_last_node():
    tree = merkle.climb([sha(str(i)) for i in range(4)], 2)
    steps = path(tree, 3)
    assert fold(tree[0][3], steps) == tree[2][0] and steps[0] == "0" and siblings(steps) == tree[1][0]
    assert fold(tree[0][2], steps) != tree[2][0]


# Periodic runs

def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(w[i:i + n - r] == w[i + r:i + n] for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


_STRETCHES = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(_STRETCHES, max_size=4))
def test_runs_match_brute_force(texts):
    split = [[w for part, times in t for w in part * times] for t in texts]
    ends = np.cumsum([len(w) for w in split]).astype(np.int64)
    expected = [(s + int(e) - len(w), n, q) for w, e in zip(split, ends) for s, n, q in plain_runs(w)]
    assert runs_of(np.array([x for w in split for x in w], np.int64), ends) == expected
    for w in split:
        assert collapsed(w, plain_runs(w)) == plain_collapsed(w, plain_runs(w))


@settings(max_examples=30, deadline=None)
@given(st.permutations(range(300)))
def test_positions_stay_in_order_in_small_parts(order):
    import tidemark.llm.period_runs as module

    part, module._PART = module._PART, 4
    try:
        held, plain = Positions(order[0]), [order[0]]
        for x in order[1:]:
            assert held.add(x) == (max((p for p in plain if p < x), default=None), min((p for p in plain if p > x), default=None))
            plain.append(x)
        assert list(held) == sorted(plain) and held.size == len(plain)
    finally:
        module._PART = part


def planted(d, text):
    w = words_of(text)
    if d is None:
        return w
    h = zlib.crc32(str(d).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_runs_of_documents_match_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    short = [(d, t) for d, t in rows if len(words_of(t)) < 800]
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for d, text in short:
        w = planted(d, text)
        runs = plain_runs(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        r = got[d]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert r["exponent_milli"] == (1000 * -best[0] // best[2] if best else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(plain_collapsed(w, runs)))


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 5), (4, "a " * 6), (None, "a b " * 4), (6, "x " + "a b c " * 20_000 + "y"), (7, "A a " * 4), (8, "a a a a a a a")]
    docs = documents(spark, rows).withColumn("runs", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodic_runs(docs).collect()), key=str)
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 5, [], "a a a a a"), (4, 6, [(0, 6, 1)], "a"), (0, 8, [(0, 8, 2)], "a b"),
                          (6, 60_002, [(1, 60_000, 3)], "x a b c y"), (7, 8, [(0, 8, 2)], "A a"), (8, 6, [], "a a a a a a a")], key=str)
    assert periodic_runs(docs.limit(0)).collect() == []
