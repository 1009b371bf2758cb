"""Periodic runs of words by a Kruskal sweep over the longest common prefixes of a text's suffixes.

The suffixes of a block of texts are put in order by prefix doubling. Neighbours in that order are then united by
decreasing common prefix, with union-find over ordered sets of positions. When two sets are united at a common prefix l,
positions a < b that become neighbours at a distance of at most l seed a repetition of period b - a: the words from a up
to b + l. It is a run where the word before a doesn't belong to it.

A run with smallest period q and at least 4q words is met, and once: its start i and i + q are united at length - q words,
and a position between them in that set would give a smaller period. A seed of at least four periods has no smaller
one either, as the start would then have a nearer neighbour, united with it before. Only suffixes that share a few words
with another of their text take part, so texts without repeats cost little more than their sorting.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_size, ship, text_bytes

SHORTEST, PERIODS = 6, 4  # a run has at least 6 words and 4 periods
_SHARED = 5  # words that the start of a run and the next period share at least: max(6, 4q) - q
_PART = 1_024


class Positions:
    """An ordered set of positions in parts of bounded length, so that adding one costs little however many there are."""

    __slots__ = ("parts", "tops", "size")

    def __init__(self, position: int):
        self.parts, self.tops, self.size = [[position]], [position], 1

    def __iter__(self):
        for part in self.parts:
            yield from part

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Add a new position; the ones next to it on both sides."""
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        part = self.parts[k]
        at = bisect_left(part, x)
        before = part[at - 1] if at else self.tops[k - 1] if k else None
        after = part[at] if at < len(part) else None  # past the last of a part only in the last part
        part.insert(at, x)
        self.tops[k] = part[-1]
        self.size += 1
        if len(part) > _PART:
            half = len(part) // 2
            self.parts[k:k + 1] = [part[:half], part[half:]]
            self.tops[k:k + 1] = [part[half - 1], part[-1]]
        return before, after


def suffix_order(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shared): suffixes that share words with the next one of their text in suffix order, and how many.

    Texts lie end to end; text k ends before ``ends[k]``. Returned are pairs of neighbours: ``positions[i]`` is (a, b), and
    ``shared[i]`` the longest common prefix of the suffixes at a and b, at least ``_SHARED``.
    """
    n = len(words)
    none = np.empty((0, 2), np.int64), np.empty(0, np.int64)
    if not n:
        return none
    size = np.diff(ends, prepend=0)
    text, end = np.repeat(np.arange(len(ends)), size), np.repeat(ends, size)
    # rank[p]: place of the class of the first words at p. A class of one keeps its rank, others are split by what follows.
    key = text * (int(words.max()) + 1) + words
    alive, length = np.arange(n), 1
    ranks, rank = [], np.zeros(n, np.int64)
    base = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        members = alive[order]
        # ``base`` is the rank of the class before; the new one counts from it.
        old = base[order]
        first_of_old = np.append(True, old[1:] != old[:-1])
        origin = np.maximum.accumulate(np.where(first_of_old, np.arange(len(members)), 0))
        rank = rank.copy()
        rank[members] = old + start[group] - origin
        ranks.append(rank)
        many = np.diff(np.append(start, len(members)))[group] > 1
        alive = np.sort(members[many])
        if not len(alive):
            break
        follow = alive + length
        after = np.where(follow < end[alive], rank[np.minimum(follow, n - 1)] + 1, 0)
        base = rank[alive]
        key = base * (n + 1) + after
        length *= 2
    held = np.argsort(rank, kind="stable")
    a, b = held[:-1], held[1:]
    four = ranks[min(2, len(ranks) - 1)]  # classes of four words, or of one where the ranks settled before
    near = (text[a] == text[b]) & (four[a] == four[b])
    a, b = a[near], b[near]
    shared, x, y = np.zeros(len(a), np.int64), a.copy(), b.copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = (x < end[a]) & (y < end[b])
        same &= ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)]
        step = np.where(same, 1 << k, 0)
        shared, x, y = shared + step, x + step, y + step
    keep = shared >= _SHARED
    return np.stack([a[keep], b[keep]], axis=1), shared[keep]


def runs_of(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in texts laid end to end, by start, then period."""
    pairs, shared = suffix_order(words, ends)
    order = np.argsort(-shared, kind="stable")
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    begins = set(np.append(0, ends).tolist())
    value = words.tolist() if len(order) else []
    runs = []

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for (a, b), level in zip(pairs[order].tolist(), shared[order].tolist()):
        for x in (a, b):
            if x not in parent:
                parent[x] = x
                sets[x] = Positions(x)
        large, small = root(a), root(b)
        if sets[large].size < sets[small].size:
            large, small = small, large
        parent[small] = large
        into, moved = sets[large], list(sets.pop(small))
        own = set(moved)
        for x in reversed(moved):  # from the last, so that what stands between x and later ones is there before x
            before, after = into.add(x)
            for p, q in ((before, x), (x, after)):
                if p is None or q is None or (p in own and q in own):
                    continue
                period, length = q - p, q - p + level
                if length >= max(SHORTEST, PERIODS * period) and (p in begins or value[p - 1] != value[q - 1]):
                    runs.append((p, length, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside all runs, and the first period of those inside."""
    kept, at = [], 0
    for start, stop in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:max(at, start)]
        at = max(at, stop)
    return kept + words[at:]


def _run(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = text_bytes(batch.column(1))
        for a, b in by_size([len(t) for t in texts]):
            split = [t.split() for t in texts[a:b]]
            numbers: dict[bytes, int] = {}
            flat = np.fromiter((numbers.setdefault(w, len(numbers)) for s in split for w in s), np.int64, sum(map(len, split)))
            ends = np.cumsum([len(s) for s in split])
            found: list[list] = [[] for _ in split]
            begins = np.append(0, ends[:-1])
            for start, length, period in runs_of(flat, ends):
                k = int(np.searchsorted(ends, start, side="right"))
                found[k].append((start - int(begins[k]), length, period))
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
            out = [b" ".join(collapsed(s, f)).decode() for s, f in zip(split, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(s) for s in split], pa.int64()), pa.array(rows, kind), pa.array(out, pa.string())],
                                             ["doc_id", "n_words", "runs", "text"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), text (collapsed).

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period q, of at least 6 words and 4 periods, that
    no neighbouring word extends. ``text`` keeps the first q words of each run and all words outside, joined by one space. Null
    and empty texts have no words, no runs and an empty text. Null or repeated doc_ids are returned as they come; other
    columns are not read. A task holds one block of texts (1 MB of text or one longer text) and its ranks, which take about
    8 * log2(longest repeat) bytes a word.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
