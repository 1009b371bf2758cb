"""Language ID, decontamination, HTML extraction and the pipeline: held-out accuracy, planted cases and edges."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination as D, html_extraction as H
from tidemark.llm.common import stored
from tidemark.llm.language_id import fit_language_model, held_out, identify
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# ---------------------------------------------------------------- language ID


@pytest.fixture(scope="module")
def model(docs):
    return fit_language_model(docs, per_language=60)


def test_language_of_held_out_documents(spark, docs, model):
    found = identify(docs, model).select("doc_id", "lang", "lang_pred", "score", held_out().alias("h")).collect()
    assert len(found) == docs.count()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["h"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 %%% 34"), (4, "é"), (None, "the of and"), (4, "é"), (5, "word " * 60_000), (6, "\x00\U0001F600")]
    df = spark.createDataFrame([(d, t, "xx", "s", 0) for d, t in rows], COLUMNS).withColumn("score", F.lit("clash"))
    got = identify(df, model).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 6}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert identify(df.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 0)], COLUMNS)
    assert identify(df, fit_language_model(df)).first()["lang_pred"] == "und"


# ---------------------------------------------------------------- decontamination


def brute_leaks(docs, items, share=0.8):
    out = set()
    for d, t in docs:
        words = D.words_of((t or "").encode())
        for i, text in items:
            w = D.words_of(text.encode())
            for a in range(0, max(1, len(words) - len(w) // 2), max(1, len(w) // 4)):
                if D.lcs(D.place_masks(w), len(w), words[a:a + 2 * len(w)], share * len(w)):
                    out.add((d, i))
                    break
    return out


def test_leaks_match_brute_force(spark, docs):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, benchmark).collect()}
    assert got == brute_leaks(rows, items)


def test_paraphrases_and_edges(spark, docs):
    rng = random.Random(3)
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet").withColumn("text", F.when(F.col("item_id") != 3, F.col("text")))
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    filler = [w for r in docs.limit(20).collect() for w in r["text"].split()]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    planted, clean = [], []
    for n, i in enumerate([0, 1, 5, 7, 9, 11]):
        words = items[i].split()
        body, last = words[:-4], words[-4:]
        for k in rng.sample(range(len(body)), max(1, len(body) // 10)):
            body[k] = rng.choice(filler)
        if n % 2:
            body.insert(len(body) // 2, rng.choice(filler))
        planted.append((2000 + n, f"{say(70)} {' '.join(body + last).upper()} {say(70)}", i))
        clean.append((3000 + n, f"{say(40)} {' '.join(words[: len(words) // 3])} {say(60)}"))
    rows = [(d, t, "en", "s", 0) for d, t, _ in planted] + [(d, t, "en", "s", 0) for d, t in clean]
    rows += [(4000, None, "en", "s", 0), (4001, "", "en", "s", 0), (4002, "word", "en", "s", 0), (2000, planted[0][1], "en", "s", 0)]
    all_docs = docs.unionByName(spark.createDataFrame(rows, COLUMNS)).withColumn("item_id", F.lit("clash"))
    found = D.find_leaks(all_docs, benchmark).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert {(d, i) for d, _, i in planted} <= got
    assert not {d for d, _ in clean} & {d for d, _ in got} and not {4000, 4001, 4002} & {d for d, _ in got}
    assert sum(r["doc_id"] == 2000 for r in found) == 2
    left = {r["doc_id"] for r in D.drop_leaks(all_docs, benchmark).collect()}
    assert left == {r["doc_id"] for r in all_docs.collect()} - {d for d, _ in got}
    assert D.find_leaks(all_docs.limit(0), benchmark).collect() == [] and D.find_leaks(docs, benchmark.limit(0)).collect() == []


def test_an_answer_that_is_missing_is_no_leak(spark, docs):
    words = " ".join(f"q{k}" for k in range(30))
    benchmark = spark.createDataFrame([(1, words + " forty two", "forty two")], "item_id long, text string, answer string")
    rows = [(1, f"start {words} forty two end", "en", "s", 0), (2, f"start {words} seventeen end", "en", "s", 0)]
    got = D.find_leaks(docs.unionByName(spark.createDataFrame([(9_000 + d, *r) for d, *r in rows], COLUMNS)), benchmark).collect()
    assert {r["doc_id"] for r in got} == {9_001}


def test_recall_by_edit_rate_and_few_candidates(spark, docs):
    """At least 0.95 of edited items are found at each rate, and under one in 1,000 pairs of a window and an item is a candidate."""
    rng = random.Random(5)
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    filler = [r["text"].encode() for r in docs.collect() if r["text"]]
    words = [w for t in filler for w in D.words_of(t)]
    for copies in (1, 8):
        more = benchmark.select((F.col("item_id") + 1_000 * F.lit(copies)).alias("item_id"), "text")
        for k in range(1, copies):
            # Other items from the same words, two words of three replaced.
            told = [(r["item_id"] + 1_000 * k, " ".join(rng.choice(words).decode() if rng.random() < 0.67 else w for w in r["text"].split())) for r in benchmark.collect()]
            more = more.union(spark.createDataFrame(told, "item_id long, text string"))
        blocks = [index for blocks in D.index_passes(docs, more) for index in blocks]
        assert all(index.kept.min() > 0.49 for index in blocks)
        clean = D.Texts(filler)
        pairs = len(clean.owner) * sum(len(index.items) for index in blocks)
        assert sum(len(index.reachable(clean)) for index in blocks) < 0.001 * pairs
        items = [(index, item) for index in blocks for item in index.items]
        for rate in (0.05, 0.1, 0.15, 0.19):
            hit = 0
            for index, item in (chosen := rng.sample(items, min(40, len(items)))):
                told = list(item.words)
                for at in rng.sample(range(len(told)), int(rate * len(told))):
                    told[at] = rng.choice(words)
                host = rng.choice(filler).split()
                text = b" ".join(host[:rng.randrange(60)] + told + host[60:120])
                hit += item.item_id in {m[0] for m in index.search(D.Texts([text]))[0]}
            assert hit >= 0.95 * len(chosen), (copies, rate, hit)


def test_edits_of_the_last_sentence_are_leaks(spark, docs):
    body = " ".join(f"q{k}" for k in range(30))
    texts = [(1, f"{body}. Er."), (2, f"{body.replace('q', 'z')}. One two three four.")]
    benchmark = spark.createDataFrame(texts, "item_id long, text string")
    rows = [(1, f"start {body} um end"), (2, f"start {body} end"), (3, f"start {body.replace('q', 'z')} one five three six end"),
            (4, f"start {' '.join(body.split()[:20])} er end")]
    planted = docs.unionByName(spark.createDataFrame([(9_000 + d, t, "en", "s", 0) for d, t in rows], COLUMNS))
    leaks = {(9_001, 1), (9_002, 1), (9_003, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(planted, benchmark).collect()} == leaks
    # An answer without words is none.
    silent = benchmark.withColumn("answer", F.lit("?!"))
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(planted, silent).collect()} == leaks


# ---------------------------------------------------------------- HTML extraction

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies. <button>Fine</button></div>
<main><h1>The &amp; title</h1><p>First   paragraph with <b>bold</b> words,
and a line break.<p>Second &eacute; paragraph, closed by the next one.<ul><li>A point that is made here in full.</ul>
<script>var x = "<p>hidden</p>";</script><p>x &lt; y holds, &#8220;always&#8221;.</p></main>
<aside class="sidebar"><p>Read this related story as well, it is good.</p></aside>
<form><label>Mail</label><input name=a></form><section id="comments"><p>Nice article, thanks for it, really.</p></section>
<footer>&copy; nobody</footer>"""
TEXT = ["The & title", "First paragraph with bold words, and a line break.", "Second é paragraph, closed by the next one.",
        "A point that is made here in full.", "x < y holds, “always”."]


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    extra = [(900, "u", PAGE), (901, None, None), (902, "u", ""), (903, "u", "<p"), (904, "u", "<script>x</script>"), (900, "u", PAGE)]
    both = pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumn("text", F.lit("clash"))
    got = H.extract_pages(both).collect()
    assert len(got) == pages.count() + len(extra)
    assert [r["text"] for r in got if r["page_id"] == 900] == ["\n\n".join(TEXT)] * 2
    assert {r["page_id"] for r in got if r["text"] == ""} >= {901, 902, 904}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract_pages(both.limit(0)).collect() == []
    plain = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in got:
        if r["page_id"] in plain:
            blocks = [b for b in H.blocks_of(plain[r["page_id"]]) if not H.is_boilerplate(b)]
            assert r["text"] == "\n\n".join(b.text for b in blocks)


def test_only_attributes_hide():
    shown = ["title='The hidden costs of x'", 'class="content hidden md:block"', "data-note='is hidden'", 'aria-label="display: none"', "aria-hidden=false",
             'title="aria-hidden=true"', "style='--x: hidden'", "data-hidden"]
    gone = ["hidden", "HIDDEN=''", "class=a hidden", 'hidden="until-found"', "style='color: red; DISPLAY : none'", 'aria-hidden="true"', "aria-hidden = TRUE", "id='a'hidden"]
    for a in shown:
        assert [b.text for b in H.blocks_of(f"<div {a}><p>Some <a {a}>linked</a> words.</p></div>")] == ["Some linked words."], a
    for a in gone:
        assert H.blocks_of(f"<div {a}><p>Some words.</p></div>") == [], a


def test_gradients_of_the_labeller():
    pages = [H.blocks_of(PAGE), H.blocks_of("<p>One short page.</p>")]
    net = H.BlockLabeller(hidden=3)
    before = net.label(pages)
    net.fit(pages, steps=60, batch=4)
    loss = lambda ps: sum(abs(x - (not H.is_boilerplate(b))) for p, bs in zip(ps, pages) for x, b in zip(p, bs))
    assert loss(net.label(pages)) < 0.3 * loss(before)


def test_context_reaches_both_ways():
    net = H.BlockLabeller()
    a, b = H.blocks_of("<p>same</p><p>one</p>"), H.blocks_of("<p>same</p><nav>two</nav>")
    assert net.label([a])[0][0] != net.label([b])[0][0]


def test_every_word_and_path_name_counts():
    """Blocks that differ only late in a long text, or high in a deep path, are told apart."""
    long = "same " * 5_000
    a, b = H.blocks_of(f"<p>{long}one</p><p>{long}two</p>")
    assert (H.features([a]) != H.features([b])).any()
    deep = "<div>" * 9 + "<p>x</p>" + "</div>" * 9
    (a,), (b,) = H.blocks_of(f"<table><tr><td>{deep}</td></tr></table>"), H.blocks_of(f"<section><div><div>{deep}</div></div></section>")
    assert (H.features([a], hide=True)[:, :H.DIMENSIONS] != H.features([b], hide=True)[:, :H.DIMENSIONS]).any()


def test_very_long_pages_in_parts(monkeypatch):
    """A page of many blocks is labelled alike in parts, and without feature rows for all of it."""
    page = H.blocks_of("".join(f"<p>block {i} says {'much ' * (i % 9)}</p><nav>go {i}</nav>" for i in range(300)))
    net = H.BlockLabeller()
    whole = net.label([page, page[:7]])
    monkeypatch.setattr(H, "BLOCKS_AT_ONCE", 64)
    for a, b in zip(whole, net.label([page, page[:7]])):
        assert abs(a - b).max() < 1e-4
    assert net.label([[], page[:1]])[0].shape == (0,)


# ---------------------------------------------------------------- pipeline


def test_stages_keep_what_they_should(spark, docs):
    extra = [(5000, None, "en", "s", 0), (5001, "123 %%%", "en", "s", 0), (None, docs.first()["text"] + " tail", "en", None, 0)]
    now = docs.unionByName(spark.createDataFrame(extra, COLUMNS))
    columns = now.columns
    seen = [sorted((r["doc_id"] for r in now.collect()), key=str)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(spark, stage(spark, now, FOLDER), name)
        assert now.columns == columns
        seen.append(sorted((r["doc_id"] for r in now.collect()), key=str))
    assert set(seen[0]) - set(seen[1]) == {5000, 5001}
    assert set(seen[2]) < set(seen[1]) and len(seen[2]) == len(set(seen[2])) and None in seen[2]
    leaks = brute_leaks([(r["doc_id"], r["text"]) for r in docs.collect()],
                        [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    assert set(seen[2]) - set(seen[3]) == {d for d, _ in leaks} & set(seen[2])
    assert set(seen[4]) <= set(seen[3]) and len(seen[4]) > len(seen[3])
    out = stored(spark, corpus_pipeline.STAGES[-1][1](spark, now, FOLDER), "out")
    assert out.count() == now.count()
    ends = out.selectExpr("max(start + n_tokens) as e", "sum(n_tokens) as n").first()
    assert ends["e"] == ends["n"]


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
