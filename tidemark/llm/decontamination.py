"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words, weighed by TF-IDF over hashed words. A randomised SVD of the matrix of
all passages of the benchmark and of the corpus gives a latent space;
its products with the sparse matrix are summed on the executors. Benchmark passages are a query set held in blocks
of bounded size, and each block completes the space for its passages. Every window of every document that holds as many rare
words of some item as a match must is projected and compared by cosine with the passages.
Candidates are then read word by word: the longest common subsequence must hold
most of the item in order, and most of its answer where the benchmark has one, so paraphrases with changed,
missing or inserted words are found and texts that only share vocabulary are not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Shelf, by_size, ship, stored, text_bytes, vector_blocks, vector_sum

BUCKETS = 1 << 15
HALF = 16  # words; a window is two halves, so windows overlap by half
# Passages of a block of items, and blocks searched in one pass over the corpus; both bound what a task holds.
QUERY_BLOCK = 512
PASS_BLOCKS = 4
# Least and most tasks that multiply the fitted matrix, and documents of a task; each sends a dense matrix of a fixed size.
FIT_TASKS, FIT_DOCS = (2, 64), 20_000
# Halves whose words are multiplied at once.
FIT_HALVES = 128
HASHED_BYTES = 1 << 18  # of stored word buckets that are multiplied at once
RUN = 8  # rows of a word that are added at once
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BUCKETS - 1)


def lcs(masks: dict[bytes, int], length: int, words: list[bytes], least: float) -> int:
    """Longest common subsequence of an item, given as bit masks of its words' places, and ``words``; 0 if under ``least``."""
    shared = [masks[w] for w in words if w in masks]
    if len(shared) < least:
        return 0
    full = v = (1 << length) - 1
    for m in shared:
        u = v & m
        v = (v + u | v - u) & full
    n = length - v.bit_count()
    return n if n >= least else 0


def place_masks(words: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]

    def __post_init__(self):
        self.masks, self.answer_masks = place_masks(self.words), place_masks(self.answer)

    def weigh(self, idf: np.ndarray, common: float) -> None:
        """Buckets of its rare words (under 5 % of documents), and how many of these a window on the item has at least.

        At most (1 - common) of all words may be missing; a window covers 3 * HALF / 2 words of the item or all of it, and
        inserted words may thin it out by ``common``.
        """
        buckets = word_buckets(self.words)
        rare = buckets[idf[buckets] > np.log(20)]
        self.rare = np.unique(rare)
        sure = len(rare) - (1 - common) * len(self.words)
        self.rare_needed = max(0.0, sure) * min(1.0, 1.5 * HALF / len(self.words)) * common


def make_items(rows: Iterable, min_words: int) -> Iterator[Item]:
    """Benchmark rows as items; without a column ``answer``, or words in it, the item's own words decide."""
    for row in rows:
        words = words_of((row["text"] or "").encode())
        if len(words) >= min_words:
            yield Item(row["item_id"], words, words_of((row["answer"] or "").encode()))


class Texts:
    """Some texts as halves of ``HALF`` word buckets; a window is a half and the one after it in the same text."""

    def __init__(self, texts: list[bytes]):
        self.words = [words_of(t) for t in texts]
        self._deal(np.array([len(w) for w in self.words], np.int64), word_buckets([w for words in self.words for w in words]))

    @classmethod
    def hashed(cls, parts: list[bytes]) -> Texts:
        """Texts of which only the buckets of their words are known, as unsigned 16-bit numbers."""
        self = cls.__new__(cls)
        self._deal(np.array([len(p) // 2 for p in parts], np.int64), np.frombuffer(b"".join(parts), np.uint16))
        return self

    def _deal(self, sizes: np.ndarray, buckets: np.ndarray) -> None:
        pieces = np.maximum(-(-sizes // HALF), 1)  # halves of each text, the last one padded
        ends = np.cumsum(pieces)
        self.first = ends - pieces
        self.owner = np.repeat(np.arange(len(sizes)), pieces)
        flat = np.full((int(ends[-1]) + 1) * HALF, BUCKETS)  # a half of padding at the end
        where = np.repeat(self.first * HALF - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        flat[where] = buckets
        self.halves = flat.reshape(-1, HALF)
        last = np.zeros(len(self.owner), bool)
        last[ends - 1] = True
        only = last & (pieces[self.owner] == 1)
        self.opens = ~last | only  # halves at which a window begins
        self.leads = np.zeros(len(self.owner), bool)  # halves with none before them in their text
        self.leads[self.first] = True
        self.second = np.where(only, len(self.owner), np.arange(1, len(self.owner) + 1))

    def buckets(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.halves[windows], self.halves[self.second[windows]]], axis=1)


def completion(basis: np.ndarray, owner: np.ndarray, buckets: np.ndarray, values: np.ndarray, n: int, keep: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions to add to ``basis`` until it keeps ``keep`` of the squared length of each of ``n`` sparse rows.

    The rows are given as entries sorted by ``owner``. They are the leading directions D of what the basis loses of the rows R: with the returned ``mix`` and
    ``inside`` (the rows in the basis) D = R.T @ mix - basis @ (inside.T @ mix). Also returns the rows in the whole space.
    Only products of rows with one another are formed, never a row as wide as the vocabulary.
    """
    used, place = np.unique(buckets, return_inverse=True)
    gram, inside = np.zeros((n, n)), np.zeros((n, basis.shape[1]))
    for a in range(0, len(used), 1_024):
        mine = (place >= a) & (place < a + 1_024)
        part = np.zeros((n, min(1_024, len(used) - a)))
        np.add.at(part, (owner[mine], place[mine] - a), values[mine])
        gram += part @ part.T
        inside += part @ basis[used[a:a + 1_024]]
    whole, kept = gram.diagonal(), (inside * inside).sum(axis=1)
    lost, u = np.linalg.eigh(gram - inside @ inside.T)
    lost, u = np.maximum(lost[::-1], 0), u[:, ::-1]
    gained = kept[:, None] + np.cumsum(u * u * lost, axis=1)
    short = int((gained < keep * whole[:, None]).any(axis=0).sum())  # gains never fall, so these are the first
    more = 0 if (kept >= keep * whole).all() else min(short + 1, int((lost > 1e-5).sum()))
    mix = u[:, :more] / np.sqrt(lost[:more])
    return mix, inside, np.concatenate([inside, u[:, :more] * np.sqrt(lost[:more])], axis=1)


class LatentIndex:
    """Passages of a block of items in the latent space, and the search through texts.

    The space of the whole matrix may keep next to nothing of a passage; for each block it is completed until it keeps
    ``keep`` of every passage, so scores stay meaningful for any number of items. A window with fewer rare words of an item
    than any match must have is no candidate for it, which is told from an inverted list of rare words before anything is projected.
    """

    def __init__(self, items: list[Item], idf: np.ndarray, basis: np.ndarray, cosine: float, common: float, keep: float):
        self.items, self.cosine, self.common = items, cosine, common
        for item in items:
            item.weigh(idf, common)
        self.needed = np.array([item.rare_needed for item in items])
        entries = sorted((int(b), n) for n, item in enumerate(items) for b in item.rare)
        held = np.array([b for b, _ in entries], np.int64)
        self.begin = np.searchsorted(held, np.arange(BUCKETS + 2))  # of each bucket, padding included
        self.holders = np.array([n for _, n in entries], np.int64)

        text = Texts([b" ".join(item.words) for item in items])
        at = np.flatnonzero(text.opens)
        self.owner = text.owner[at]
        buckets = text.buckets(at)
        weights = np.append(idf, 0.0).astype(np.float32)
        length = np.sqrt(np.maximum((weights[buckets] ** 2).sum(axis=1), 1e-9))
        owner, held = np.repeat(np.arange(len(at)), buckets.shape[1]), buckets.ravel()
        real = held < BUCKETS
        owner, held = owner[real], held[real]
        mix, inside, z = completion(basis, owner, held, weights[held] / length[owner], len(at), keep)
        # What ``rows`` is made of travels; the matrix itself is as wide as the vocabulary and is made by the tasks.
        self.weights, self.basis, self.entries = weights, basis, (owner, held, (weights[held] / length[owner]).astype(np.float32))
        self.mix, self.inside, self._rows = mix.astype(np.float32), (inside.T @ mix).astype(np.float32), None
        # What the space keeps of a benchmark passage is the cosine it has with itself; scaled so that this is 1.
        self.kept = (z * z).sum(axis=1)
        self.passages = (z / np.maximum(self.kept, 1e-9)[:, None]).astype(np.float32)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_rows": None}

    @property
    def rows(self) -> np.ndarray:
        """The projection of one occurrence of a word, and its share of a passage's squared TF-IDF length."""
        if self._rows is None:
            rank, width = self.basis.shape[1], self.mix.shape[1]
            rows = np.zeros((BUCKETS + 1, rank + width + 1), np.float32)  # the last row is padding
            owner, held, values = self.entries
            for a in range(0, len(held), 1_024):
                np.add.at(rows[:, rank:-1], held[a:a + 1_024], values[a:a + 1_024, None] * self.mix[owner[a:a + 1_024]])
            for a in range(0, BUCKETS, 4_096):
                part = slice(a, a + 4_096)
                rows[a:min(a + 4_096, BUCKETS), :rank] = self.basis[part]
                rows[a:min(a + 4_096, BUCKETS), rank:-1] -= self.basis[part] @ self.inside
            rows[:, :-1] *= self.weights[:, None]
            rows[:, -1] = self.weights ** 2
            self._rows = rows
        return self._rows

    def project(self, texts: Texts, windows: np.ndarray) -> np.ndarray:
        """Latent vectors of windows, by their TF-IDF length."""
        z = self.rows.take(texts.buckets(windows), axis=0).sum(axis=1)
        return z[:, :-1] / np.sqrt(np.maximum(z[:, -1:], 1e-9))

    def reachable(self, texts: Texts) -> np.ndarray:
        """Sorted keys window * items + item of windows that hold as many rare words of the item as a match must."""
        flat = texts.halves[:-1].ravel()
        n = self.begin[flat + 1] - self.begin[flat]
        at = np.flatnonzero(n)
        n, start = n[at], self.begin[flat[at]]
        item = self.holders[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        half = np.repeat(at // HALF, n)
        # A half is the first of one window and the second of the one before.
        own, before = texts.opens[half], ~texts.leads[half]
        keys = np.concatenate([half[own] * len(self.items) + item[own], (half[before] - 1) * len(self.items) + item[before]])
        keys, counts = np.unique(keys, return_counts=True)
        keys = keys[counts >= self.needed[keys % len(self.items)]]
        free = np.flatnonzero(self.needed <= 0)  # items of common words only are compared with every window
        if len(free):
            keys = np.union1d(keys, (np.flatnonzero(texts.opens)[:, None] * len(self.items) + free).ravel())
        return keys

    def search(self, texts: Texts) -> list[list[tuple[int, int, float, float]]]:
        """For each text its (item_id, first word, cosine, share of the item in order), one row an item."""
        found: list[dict[int, tuple[int, float, float]]] = [{} for _ in texts.words]
        keys = self.reachable(texts)
        windows = np.unique(keys // len(self.items))
        for a in range(0, len(windows), 256):
            part = windows[a:a + 256]
            score = self.project(texts, part) @ self.passages.T
            w, p = np.nonzero(score >= self.cosine)
            near = part[w] * len(self.items) + self.owner[p]
            place = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
            both = keys[place] == near
            # The same item through several of its passages is read once a window.
            close = {}
            for key, s in zip(near[both].tolist(), score[w[both], p[both]].tolist()):
                close[key] = max(s, close.get(key, 0.0))
            for key, s in close.items():
                i, n = divmod(key, len(self.items))
                d = int(texts.owner[i])
                self._read(found[d], self.items[n], texts.words[d], (i - int(texts.first[d])) * HALF, s)
        return [[(k, *v) for k, v in sorted(f.items(), key=lambda e: (e[0] is None, e[0] or 0))] for f in found]

    def _read(self, found: dict, item: Item, words: list[bytes], start: int, score: float) -> None:
        length = len(item.words)
        if item.item_id in found and found[item.item_id][2] == 1.0:
            return
        low = max(0, start - length)
        region = words[low:start + 2 * HALF + length]
        common = lcs(item.masks, length, region, self.common * length) / length
        if not common or item.answer and not lcs(item.answer_masks, len(item.answer), region, self.common * len(item.answer)):
            return
        if item.item_id not in found or found[item.item_id][2] < common:
            found[item.item_id] = (low, score, common)


def _document_frequencies(hashed: DataFrame) -> np.ndarray:
    """Documents that hold each bucket, from the buckets of their words; the last place counts all documents."""

    def run(batches):
        df = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            for a, b in by_size([len(w) for w in words], HASHED_BYTES):
                flat = np.frombuffer(b"".join(words[a:b]), np.uint16)
                owner = np.repeat(np.arange(b - a), [len(w) // 2 for w in words[a:b]])
                df[:BUCKETS] += np.bincount(np.unique(owner * BUCKETS + flat) % BUCKETS, minlength=BUCKETS)
                df[BUCKETS] += b - a
        yield vector_blocks(df)

    return vector_sum(hashed.select("words").mapInArrow(run, "block int, part binary"), BUCKETS + 1, np.int64)


def _multiply(texts: Texts, weights: np.ndarray, scaled: np.ndarray, idf: np.ndarray, total: np.ndarray) -> None:
    """Adds A.T @ (A @ thin) of the windows of some texts to ``total``, given the thin matrix scaled by ``idf``; both have a row of padding.

    A half lies in two windows, so its words are summed once, and take what both windows give back at once.
    """
    n, halves, begin = len(texts.owner), texts.halves, np.flatnonzero(texts.opens)
    second, squares = texts.second[begin], (idf * idf)[halves].sum(axis=1)
    sums = np.empty((n + 1, scaled.shape[1]), np.float32)
    for a in range(0, n + 1, FIT_HALVES):
        sums[a:a + FIT_HALVES] = scaled.take(halves[a:a + FIT_HALVES], axis=0).sum(axis=1)
    length = squares[begin] + squares[second]  # rows of A have unit length before their weight
    found = (sums[begin] + sums[second]) * (weights[texts.owner[begin]] / np.where(length > 0, length, 1.0)).astype(np.float32)[:, None]
    sums[:] = 0
    sums[begin] += found
    sums[second] += found  # each half is the second of one window at most, but for the padding, which gives nothing
    sums[n] = 0
    _give_back(sums, halves[:n].ravel().astype(np.uint16), idf, total)


def _give_back(sums: np.ndarray, buckets: np.ndarray, idf: np.ndarray, total: np.ndarray) -> None:
    """Adds to each bucket's row of ``total`` the sums of the halves it occurs in; the last row of ``sums`` is zero.

    Words are sorted by bucket, and the rows of a bucket are added a few at a time, and so are their sums, until one is left.
    """
    order = np.argsort(buckets, kind="stable")  # sorts 16 bits by digits
    held, counts = np.unique(buckets[order], return_counts=True)
    rows, at = sums, order // HALF
    while len(held):
        few = np.minimum(counts, RUN)
        pieces = -(-counts // RUN)
        base = np.cumsum(pieces) - pieces
        inside = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        runs = np.full((int(pieces.sum()), int(few.max())), len(rows) - 1)
        runs[np.repeat(base, counts) + inside // RUN, inside % RUN] = at
        longest = np.ones(len(runs), np.int64)
        longest[base] = few
        longest[np.repeat(pieces > 1, pieces)] = RUN
        # Runs of words that are done go to ``total`` at once, the others are added again.
        done = pieces == 1
        word = np.repeat(np.where(done, np.arange(len(held)), -1), pieces)
        left = np.flatnonzero(word < 0)
        place = np.empty(len(runs), np.int64)
        place[left] = np.arange(len(left))
        added = np.zeros((len(left) + 1, sums.shape[1]), np.float32)
        # Runs of one length together, so that lone words are not added to padding.
        for length in range(1, runs.shape[1] + 1):
            mine = np.flatnonzero(longest == length)
            for a in range(0, len(mine), 4 * FIT_HALVES):
                part = mine[a:a + 4 * FIT_HALVES]
                add = rows.take(runs[part, 0], axis=0)
                for k in range(1, length):
                    add += rows.take(runs[part, k], axis=0)
                last = word[part] >= 0
                named = held[word[part[last]]]
                total[named] += add[last] * idf[named][:, None]
                added[place[part[~last]]] = add[~last]
        rows, at, held, counts = added, np.arange(len(left)), held[~done], pieces[~done]


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    """The buckets of the words of texts (null: none), with any other columns."""
    for batch in batches:
        words = [word_buckets(words_of(t)).astype(np.uint16).tobytes() for t in text_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *batch.columns[1:]], ["words", *batch.schema.names[1:]])


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, extra: int = 8, powers: int = 2, seed: int = 7, tasks: int = 8,
                   words: DataFrame | None = None) -> np.ndarray:
    """An orthonormal basis (buckets x rank) of the leading right singular vectors of the TF-IDF matrix of ``passages``.

    ``passages`` has columns text and weight; a weight stands for so many repeats of its rows.

    Each round multiplies a thin matrix by A and then by its transpose. Executors hold rows of A only as
    word buckets, which are stored once for all rounds; their partial products have a fixed size and are summed before they reach
    the driver. ``tasks`` make them. ``words`` are the same passages as stored buckets (words, weight), where the caller has them.
    """
    width = rank + extra
    shelf = Shelf(passages.sparkSession)
    if words is None:
        words = shelf.put(passages.select("text", "weight").mapInArrow(_hashed, "words binary, weight double"), "hashed")
    hashed = words.coalesce(tasks)
    # Single precision throughout: the driver holds a few matrices of this size and no more.
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, width), dtype=np.float32))[0]
    for _ in range(powers + 1):
        # Broadcast by name, so that its copies on the disks of executors go after each round.
        sent = passages.sparkSession.sparkContext.broadcast(idf.astype(np.float32)[:, None] * thin)

        def run(batches, sent=sent):
            scaled, rare = np.append(sent.value, np.zeros((1, width), np.float32), axis=0), np.append(idf, 0.0).astype(np.float32)
            total = np.zeros_like(scaled)
            for batch in batches:
                words, weights = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for a, b in by_size([len(w) for w in words], HASHED_BYTES):
                    _multiply(Texts.hashed(words[a:b]), weights[a:b], scaled, rare, total)
            yield vector_blocks(total[:BUCKETS])

        product = vector_sum(hashed.mapInArrow(run, "block int, part binary"), BUCKETS * width, np.float32)
        sent.destroy(blocking=True)
        thin, small = np.linalg.qr(product.reshape(BUCKETS, width))
        thin = thin @ np.linalg.svd(small)[0]
    shelf.free("hashed")
    return thin[:, :rank]


def index_passes(docs: DataFrame, benchmark: DataFrame, rank: int = 128, cosine: float = 0.4, common: float = 0.8,
                 min_words: int = 5, corpus_weight: float = 1_000.0, query_weight: float = 8.0, keep: float = 0.5) -> Iterator[list[LatentIndex]]:
    """Indexes over blocks of benchmark items, a few blocks at a time: what one pass over the corpus holds.

    Document frequencies and the latent space cover all documents and whole texts. Benchmark passages weigh ``query_weight`` each,
    those of the corpus alike and together as much as ``corpus_weight`` documents, so that a large corpus does not take the whole
    space; then each block completes it for its own passages.
    Items are streamed in order, so the driver holds those of one pass, whatever their number.
    """
    spark = docs.sparkSession
    ship(spark)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = stored(spark, benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
                                          answer.alias("answer")), "items")
    total = rows.count()
    if not total:
        return
    # The corpus is split into words once, for its document frequencies and for every round of the fit.
    shelf = Shelf(spark)
    text = F.col("text").cast("string").alias("text")
    hashed = shelf.put(docs.select(text).mapInArrow(_hashed, "words binary"), "hashed")
    df = _document_frequencies(hashed)
    idf = np.log((1.0 + df[BUCKETS]) / (1.0 + df[:BUCKETS])) + 0.01
    weighed = F.lit(corpus_weight / max(corpus_weight, float(df[BUCKETS]))).alias("weight")
    asked = rows.select("text", F.lit(query_weight).alias("weight"))
    passages = asked.union(docs.select(text, weighed)).filter("text is not null")
    words = asked.mapInArrow(_hashed, "words binary, weight double").union(hashed.select("words", weighed))
    basis = randomised_svd(passages, idf, rank, tasks=min(FIT_TASKS[1], FIT_TASKS[0] + int(df[BUCKETS]) // FIT_DOCS), words=words)
    shelf.free("hashed")
    # An item of one window has at least one passage, so blocks of items bound the passages by their words.
    blocks, block, held = [], [], 0
    for item in make_items(rows.orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator(), min_words):
        n = max(1, len(item.words) // HALF)
        if block and held + n > QUERY_BLOCK:
            blocks.append(LatentIndex(block, idf, basis, cosine, common, keep))
            block, held = [], 0
            if len(blocks) == PASS_BLOCKS:
                yield blocks
                blocks = []
        block.append(item)
        held += n
    if block:
        blocks.append(LatentIndex(block, idf, basis, cosine, common, keep))
    if blocks:
        yield blocks


def _matches(indexes: list[LatentIndex], texts: list[bytes]) -> Iterator[tuple[int, int, list]]:
    """(first, after the last, matches of each text) of ranges of texts of bounded size."""
    for a, b in by_size([len(t) for t in texts]):
        held = Texts(texts[a:b])
        yield a, b, [sum(found, []) for found in zip(*(index.search(held) for index in indexes))]


def find_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, first_word, cosine, share.

    ``share`` is the part of the item's words found in order near ``first_word``. Items under ``min_words`` words,
    null and empty texts match nothing; rows that repeat are searched and returned as often as they come.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word long, cosine double, share double"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], schema)
    for indexes in index_passes(docs, benchmark, **settings):

        def run(batches, indexes=indexes):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, b, matches in _matches(indexes, text_bytes(batch.column(1))):
                    rows = [(d, *m) for d, ms in zip(ids[a:b], matches) for m in ms]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                         ["doc_id", "item_id", "first_word", "cosine", "share"])

        # Written before the next pass is built, so that its indexes can go.
        found = found.union(stored(spark, slim.mapInArrow(run, schema), "leaks"))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; every other row is unchanged."""
    at, whole, n = docs.columns.index("text"), docs, 0
    for n, indexes in enumerate(index_passes(whole, benchmark, **settings)):

        def run(batches, indexes=indexes):
            for batch in batches:
                for a, b, matches in _matches(indexes, text_bytes(batch.column(at))):
                    yield batch.slice(a, b - a).filter(pa.array([not ms for ms in matches], pa.bool_()))

        docs = (stored(docs.sparkSession, docs, "clean") if n else docs).mapInArrow(run, docs.schema)
    return docs
