"""Exact removal of word windows that an earlier document holds, by super-k-mers.

A window is ``window`` consecutive words of one document; its minimiser is the smallest hash of the word grams inside
it. Consecutive windows with one minimiser are a super-k-mer: they travel as one packed string of words to the bucket of
that minimiser, where equal windows must meet. Strings travel only for minimisers that stand in more than one
super-k-mer, and equal strings are one row with their smallest and largest document before a bucket is read. In a bucket
the windows are sorted by their words, so that equal ones are counted exactly, whatever their hashes.
Buckets of many different strings (a common line in ever new surroundings) are dealt again by single windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import by_size, ship, stored, text_bytes

GRAM = 5  # words of a minimiser gram
LONGEST = 255  # windows of a super-k-mer; longer stretches of one minimiser are cut
BUCKET_ROWS = 4_096  # super-k-mers of a bucket that one task sorts together
BATCH_WINDOWS = 1 << 18  # windows sorted at once; bounds memory
_LAST = (1 << 63) - 1
_KEY = ["doc", "mark"]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's key: its doc_id, or a text hash where that is null, and a mark of the text and of the null."""
    text = F.col("text").cast("string")
    number = F.col("doc_id").cast("long")
    null = number.isNull()
    return docs.select(number.alias("doc_id"), text.alias("text"), F.coalesce(number, F.xxhash64(text)).alias("doc"),
                       (F.hash(text).cast("long") * 2 + null.cast("long")).alias("mark"))


def _rank() -> Column:
    """The order of documents; null ids come last."""
    return F.when(F.col("mark").bitwiseAND(1) == 1, F.lit(_LAST)).otherwise(F.col("doc"))


def super_kmers(words: list[bytes], ends: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of texts laid end to end; text k ends before word ``ends[k]``."""
    none = np.empty(0, np.int64)
    total = len(words)
    gram = min(gram, window)
    if total < window:
        return none, none, none
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, total)
    g = h[:total - gram + 1].copy()
    for k in range(1, gram):
        g = g * _MIX + h[k:total - gram + 1 + k]
    g = (g ^ (g >> np.uint64(29))) * _MIX
    g ^= g >> np.uint64(32)
    least, span, want = g, 1, window - gram + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    size = np.diff(ends, prepend=0)
    end = np.repeat(ends, size)[:len(least)]
    inside = end >= np.arange(len(least)) + window
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (end[1:] != end[:-1])
    at = np.arange(len(least))
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= inside & (since % LONGEST == 0)
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none
    # A super-k-mer ends where the next one begins or where windows would leave the text.
    stop = np.append(first[1:], len(least))
    return least[first].view(np.int64), first, np.minimum(stop, end[first] - window + 1) - first


def _cuts(window: int):
    """Rows (m, doc, mark, place): one for each super-k-mer, place = first window * 256 + number of windows.

    A minimiser that comes twice in one block of texts surely repeats: its rows are marked, and one row without a place
    tells the others. However common it is, its bucket gets one row a block.
    """

    def run(batches):
        for batch in batches:
            doc, mark, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_bytes(batch.column(2))
            for a, b in by_size([len(t) for t in texts]):
                split = [t.split() for t in texts[a:b]]
                ends = np.cumsum([len(s) for s in split])
                m, first, n = super_kmers([w for s in split for w in s], ends, window)
                if not len(m):
                    continue
                at = np.searchsorted(ends, first, side="right")
                place = (first - np.append(0, ends[:-1])[at]) * 256 + n
                known, inverse, count = np.unique(m, return_inverse=True, return_counts=True)
                sure, told = count[inverse] > 1, known[count > 1]
                none = np.zeros(len(told), np.int64)
                columns = [np.append(m, told), np.append(doc[a:b][at], none), np.append(mark[a:b][at], none), np.append(place, none - 1),
                           np.append(sure, none > 0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "doc", "mark", "place", "sure"])

    return run


def _repeated(batches):
    """Of rows sorted by m: those whose m has another row, and all that are sure. Only one row is ever held back."""
    held, last = None, None

    def told(columns, keep):
        keep &= columns[3] >= 0
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns[:4]], ["m", "doc", "mark", "place"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.append(h, c) for h, c in zip(held, columns)]
        m, place, sure = columns[0], columns[3], columns[4]
        if not len(m):
            continue
        twin = np.zeros(len(m), bool)
        same = ~sure[1:] & ~sure[:-1] & (m[1:] == m[:-1])
        twin[1:] |= same
        twin[:-1] |= same
        twin[0] |= not sure[0] and held is None and last is not None and last == m[0]
        open_ = not (twin[-1] or sure[-1])
        held = [c[-1:] for c in columns] if open_ else None
        last = None if sure[-1] or open_ else m[-1]
        upto = len(m) - open_
        yield from told([c[:upto] for c in columns], (twin | sure)[:upto])


def _packed(window: int):
    """Rows (m, packed, doc, mark, start) of the wanted super-k-mers of each text."""
    names = ["m", "packed", "doc", "mark", "start"]

    def run(batches):
        for batch in batches:
            doc, mark = batch.column(0), batch.column(1)
            for i, (text, wanted) in enumerate(zip(text_bytes(batch.column(2)), batch.column(3))):
                values = wanted.values
                m, place = values.field(0), values.field(1).to_numpy()
                first, n, words = place >> 8, place & 255, text.split()
                strings = [b" ".join(words[a:a + k + window - 1]) for a, k in zip(first.tolist(), n.tolist())]
                # In parts, so that a long text does not become one batch.
                for at in range(0, len(strings), 16_384):
                    part = strings[at:at + 16_384]
                    yield pa.RecordBatch.from_arrays([m[at:at + len(part)], pa.array(part, pa.binary()), pa.repeat(doc[i], len(part)), pa.repeat(mark[i], len(part)),
                                                      pa.array(first[at:at + len(part)], pa.int64())], names)

    return run


def lowest_documents(bucket: list[int], strings: list[bytes], low: np.ndarray, window: int) -> list[np.ndarray]:
    """For every string the smallest document of each of its windows, over all strings of its bucket."""
    ids: dict[bytes, int] = {}
    words = [[ids.setdefault(w, len(ids)) for w in s.split(b" ")] for s in strings]
    count = np.array([len(w) - window + 1 for w in words])
    rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(w, np.int32), window) for w in words])
    owner = np.repeat(np.arange(len(words)), count)
    keyed = np.concatenate([np.unique(np.array(bucket), return_inverse=True)[1].astype(np.int32)[owner][:, None], rows], axis=1)
    order = np.lexsort(keyed.T)
    new = np.append(True, (keyed[order][1:] != keyed[order][:-1]).any(axis=1))
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(low[owner][order], np.flatnonzero(new))
    found = np.empty(len(order), np.int64)
    found[order] = least[group]
    return np.split(found, np.cumsum(count)[:-1])


def _bucketed(window: int):
    """Of rows (m, id, packed, lo, hi) sorted by m: (m, id, lows) where a window stands in an earlier document."""

    def told(rows):
        lows = lowest_documents([r[0] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows], np.int64), window)
        hit = [(r[0], r[1], v.tolist()) for r, v in zip(rows, lows) if v.min() < r[4]]
        if hit:
            m, name, v = zip(*hit)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(name, pa.int64()), pa.array(v, pa.list_(pa.int64()))], ["m", "id", "lows"])

    def run(batches):
        rows, start, windows = [], 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != rows[-1][0]:
                    start = len(rows)  # the last bucket may go on
                    if windows > BATCH_WINDOWS:
                        yield from told(rows)
                        rows, start, windows = [], 0, 0
                rows.append(row)
                windows += row[2].count(b" ") - window + 2
        if rows:
            yield from told(rows)

    return run


def _windows(window: int):
    """Every window of the rows (m, id, packed, lo), as (m, id, place, words, lo)."""

    def run(batches):
        for batch in batches:
            for m, name, packed, lo in zip(*(c.to_pylist() for c in batch.columns)):
                words = packed.split(b" ")
                n = len(words) - window + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * n, pa.int64()), pa.array([name] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array([b" ".join(words[i:i + window]) for i in range(n)], pa.binary()), pa.array([lo] * n, pa.int64())],
                    ["m", "id", "place", "words", "lo"])

    return run


def _kept(batches, window: int):
    for batch in batches:
        out = [[], [], [], []]
        for text, found in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            words = text.split()
            covered, spans = 0, []
            for start in sorted(set().union(*found)) if found else ():
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = start + window
                else:
                    spans.append([start, start + window])
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                covered += b - a
                at = b
            kept += words[at:]
            for column, value in zip(out, (len(words), covered, [{"start": a, "stop": b} for a, b in spans], b" ".join(kept).decode())):
                column.append(value)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), spans, pa.string())))],
                                         ["doc_id", "n_words", "n_removed", "spans", "text"])


def repeated_windows(spark: SparkSession, docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc, mark, starts): keys of ``docs`` and lists of the windows whose words also start in a smaller doc_id."""
    keyed = _keyed(docs)
    cuts = keyed.select(*_KEY, "text").mapInArrow(_cuts(window), "m long, doc long, mark long, place long, sure boolean")
    deal = F.when(F.col("sure"), F.xxhash64(*_KEY, "place")).otherwise(F.col("m"))
    pairs = cuts.repartition(deal).sortWithinPartitions("sure", "m").mapInArrow(_repeated, "m long, doc long, mark long, place long")
    held = stored(spark, pairs.groupBy(*_KEY).agg(F.collect_set(F.struct("m", "place")).alias("wanted")), "wanted")
    packed = stored(spark, keyed.select(*_KEY, "text").join(held, _KEY)
                    .mapInArrow(_packed(window), "m long, packed binary, doc long, mark long, start long"), "packed")

    crowded = packed.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_ROWS).select("m")
    crowded = stored(spark, crowded, "crowded")
    ends = [F.min(_rank()).alias("lo"), F.max(_rank()).alias("hi")]
    answer = "m long, id long, lows array<long>"
    # Dealt by minimiser before equal strings are merged, so that a bucket's strings are together without being sent again.
    few = packed.join(crowded, "m", "left_anti").repartition("m").groupBy("m", "packed").agg(*ends)
    few = (few.select("m", F.xxhash64("packed").alias("id"), "packed", "lo", "hi").sortWithinPartitions("m").mapInArrow(_bucketed(window), answer))
    # Buckets of many strings: equal ones are merged before they are sent, and the windows of the rest go their own ways.
    many = packed.join(crowded, "m", "left_semi").groupBy("m", "packed").agg(*ends)
    single = stored(spark, many.select("m", F.xxhash64("packed").alias("id"), "packed", "lo")
                    .mapInArrow(_windows(window), "m long, id long, place int, words binary, lo long"), "windows")
    lowest = single.groupBy("words").agg(F.min("lo").alias("lowest"))
    many = single.join(lowest, "words").groupBy("m", "id").agg(F.array_sort(F.collect_list(F.struct("place", "lowest")))["lowest"].alias("lows"))
    answers = stored(spark, few.union(many), "lowest")

    starts = F.filter(F.transform("lows", lambda low, j: F.when(low < _rank(), F.col("start") + j)), lambda x: x.isNotNull())
    hits = packed.select("m", F.xxhash64("packed").alias("id"), *_KEY, "start").join(answers, ["m", "id"]).select(*_KEY, starts.alias("starts"))
    return hits.filter(F.size("starts") > 0).groupBy(*_KEY).agg(F.collect_set("starts").alias("starts"))


def remove_repeated_windows(spark: SparkSession, docs: DataFrame, window: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed words, from start up to stop), text (what is kept).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window over it also starts in a document with a smaller
    doc_id; windows are judged on the input. Null texts have no words and give an empty text. Texts under ``window`` words
    lose nothing. Rows with a null doc_id come after all others: they lose what any document with an id holds, and nothing
    is removed for their sake. Rows that repeat a doc_id remove nothing from each other and are all returned; other columns
    are not read. An empty table gives an empty one.
    """
    ship(spark)
    found = stored(spark, repeated_windows(spark, docs, window), "repeated")
    rows = _keyed(docs).join(found, _KEY, "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(lambda batches: _kept(batches, window),
                           "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, text string")
