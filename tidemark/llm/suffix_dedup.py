"""Removal of long repeated passages with a suffix-array interval tree.

A repeat of at least ``length`` bytes is found where it is anchored. Every stretch of ``length``
bytes holds the smallest hash of its ``GRAM``-byte windows, and equal stretches hold it at the same
place, so only anchors that occur twice need be looked at: around each, the bytes that a stretch with
this anchor can reach are its context. Contexts are grouped by anchor, equal ones as one row.
In each group the suffixes of all contexts that begin with a repeated stretch whose left
neighbours differ form an enhanced suffix array; a stack scan over its common prefix lengths lists
the interval tree, and each interval of at least ``length`` bytes that is extended neither by one right
nor by one left byte is a maximal repeat with all its occurrences. A repeat that leaves its context
comes as overlapping ones, which are joined per document; the edge of a context counts as
diverse, so none is lost.

No group has to fit in one task: an anchor with more than ``GROUP_ROWS`` different contexts is dealt by
parts and stretches instead, where counting the members of a class needs no task to see them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import Shelf, by_size, ship, stored, text_bytes

LENGTH = 200  # bytes of the shortest repeat
GRAM = 32  # bytes of an anchor
SEGMENT = 1 << 20  # bytes of a text hashed at once
# Different contexts of one anchor that a task holds; with more, the anchor is dealt by stretch.
GROUP_ROWS = 1_024
RANGE = 1 << 32  # more than the bytes of any text
PART = 13  # neighbouring stretches of a crowded anchor that are first looked at together
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each ``width`` bytes (a power of two), by doubling, well mixed."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _ODD
    h ^= h >> np.uint64(32)
    size, factor = 1, np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        while size < width:
            h = h[:-size] * factor + h[size:]
            factor = factor * factor + np.uint64(2)
            h ^= h >> np.uint64(29)
            size *= 2
        h *= _ODD
        h ^= h >> np.uint64(32)
    return h


def _sliding(h: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over every ``width`` neighbours."""
    out, size = h, 1
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    if size < width:
        out = best(out[: len(out) - (width - size)], out[width - size:])
    return out


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are the smallest of some stretch of ``length`` bytes."""
    window = length - gram + 1
    places, hashes = [], []
    for at in range(0, max(0, len(text) - length + 1), SEGMENT):
        # Stretches that start in [at, at + SEGMENT) need so many bytes.
        part = np.frombuffer(text[at:at + SEGMENT + length - 1], np.uint8)
        h = gram_hashes(part, gram)
        low = _sliding(h, window, np.minimum)
        # A gram is an anchor if the largest minimum of the stretches around it is its own hash.
        edge = np.zeros(window - 1, np.uint64)
        reach = _sliding(np.concatenate([edge, low, edge]), window, np.maximum)
        found = np.flatnonzero(reach == h)
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    p, first = np.unique(p, return_index=True)
    return p, h[first]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Every anchor with the hash and extent of its context; ``docs`` has d, mark and text."""
    reach = length - GRAM

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in by_size([len(t) for t in texts]):
                rows, counts = [], []
                for text in texts[a:b]:
                    p, h = anchors(text, length)
                    counts.append(len(p))
                    start, stop = np.maximum(p - reach, 0), np.minimum(p + length, len(text))
                    c = [xxhash.xxh3_64_intdigest(text[x:y]) for x, y in zip(start.tolist(), stop.tolist())]
                    rows.append((p - start, start, stop - start, h.view(np.int64), np.array(c, np.uint64).view(np.int64)))
                if not sum(counts):
                    continue
                before, start, size, h, c = (np.concatenate(x) for x in zip(*rows))
                take = pa.array(np.repeat(np.arange(a, b), counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(before.astype(np.int16)), pa.array(start.astype(np.int32)),
                     pa.array(size.astype(np.int16)), pa.array(h), pa.array(c)],
                    ["d", "mark", "before", "start", "size", "anchor", "context"])

    return docs.mapInArrow(run, "d long, mark long, before short, start int, size short, anchor long, context long")


def interval_tree(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, low, high) of every interval of a suffix array with a common prefix of ``least`` or more bytes.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i. A stack holds the open intervals; one closes when a
    smaller value comes, and its parent opens where it began, so intervals come inside out.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp[1:], -1], 1):
        low = i - 1
        while stack and stack[-1][0] > value:
            depth, low = stack.pop()
            yield depth, low, i - 1
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, low))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def stretch_classes(bodies: list[bytes], before: list[int], length: int):
    """(context, offset, first key, second key, left byte) of every stretch that holds its context's anchor.

    Two overlapping hashes name a stretch. The left byte is 256 at a context's edge.
    """
    buffer = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(x) for x in bodies])
    counts = np.minimum(np.array(before), sizes - length) + 1
    owner = np.repeat(np.arange(len(bodies)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
    half = 1 << (length.bit_length() - 1)
    h = gram_hashes(buffer, half)
    left = np.where(offset > 0, buffer[at - 1].astype(np.int32), 256)
    return owner, offset, h[at], h[at + length - half], left


def _once(group: np.ndarray, doc: np.ndarray, start: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Which stretches to keep so that overlapping contexts of one anchor in one document give no place twice."""
    pairs, pair, count = np.unique(np.stack([group, doc]), axis=1, return_inverse=True, return_counts=True)
    keep = np.ones(len(owner), bool)
    at = np.flatnonzero(count[pair][owner] > 1)
    if len(at):
        place = start[owner[at]] + offset[at]
        # The context that starts last reaches furthest.
        order = np.lexsort((-start[owner[at]], place, pair[owner[at]]))
        same = (pair[owner[at]][order][1:] == pair[owner[at]][order][:-1]) & (place[order][1:] == place[order][:-1])
        keep[at[order[1:][same]]] = False
    return keep


def maximal_repeats(group: np.ndarray, doc: np.ndarray, start: np.ndarray, bodies: list[bytes], before: list[int], many: list[bool],
                    length: int = LENGTH):
    """The enhanced suffix arrays of a batch of groups: yields (group, suffixes, intervals).

    ``suffixes`` lists (context, offset, reach) in suffix order, reach being the depth of the innermost maximal
    repeat around it; ``intervals`` lists (low, high, depth) of maximal repeats. A context that occurs ``many``
    times stands in the array twice, so that it is a repeat by itself.
    """
    owner, offset, a, b, left = stretch_classes(bodies, before, length)
    keep = _once(group, doc, start, owner, offset)
    owner, offset, a, b, left = owner[keep], offset[keep], a[keep], b[keep], left[keep]
    with np.errstate(over="ignore"):
        key = (a * _ODD) ^ b ^ (group[owner].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    count = np.diff(np.append(first, len(ranked)))
    low, high = np.minimum.reduceat(left[order], first), np.maximum.reduceat(left[order], first)
    # A class that one byte always precedes lies inside a repeat that begins earlier, and so does all below it.
    chosen = order[np.repeat((count > 1) & ((low != high) | (high == 256)), count)]
    members: dict[int, list[tuple[bytes, int, int]]] = {}
    for k, o in zip(owner[chosen].tolist(), offset[chosen].tolist()):
        members.setdefault(int(group[k]), []).append((bodies[k][o:], k, o))
    for k in np.flatnonzero(many).tolist():
        members.setdefault(int(group[k]), []).extend([(bodies[k], k, 0)] * (1 if (bodies[k], k, 0) in members.get(int(group[k]), ()) else 2))
    for g, suffixes in members.items():
        suffixes.sort()
        lcp = [0, *(common_prefix(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:]))]
        reach, intervals = [0] * len(suffixes), []
        following = list(range(len(suffixes) + 1))  # the next suffix without a reach
        for depth, lo, hi in interval_tree(lcp, length):
            lefts = {bodies[k][o - 1] if o else 256 for _, k, o in suffixes[lo:lo + 1]}
            for _, k, o in suffixes[lo:hi + 1]:
                lefts.add(bodies[k][o - 1] if o else 256)
                if len(lefts) > 1 or 256 in lefts:
                    break
            if len(lefts) < 2 and 256 not in lefts:
                continue
            intervals.append((lo, hi, depth))
            i = lo
            while (i := _find(following, i)) <= hi:
                reach[i], following[i] = depth, i + 1
        yield g, [(k, o, r) for (_, k, o), r in zip(suffixes, reach)], intervals


def _find(following: list[int], i: int) -> int:
    while following[i] != i:
        following[i] = following[following[i]]
        i = following[i]
    return i


def _whole_groups(batches) -> Iterator[tuple]:
    """Columns of rows that are sorted by anchor, some groups at a time, none of them cut."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) > 2 * GROUP_ROWS:
            cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
            if cut:
                yield tuple(zip(*held[:cut]))
                held = held[cut:]
    if held:
        yield tuple(zip(*held))


_TREE = "anchor long, low int, high int, depth int, rank int, context long, offset int, reach int"


def _trees(contexts: DataFrame, length: int) -> DataFrame:
    """Suffix rows (anchor, rank, context, offset, reach) and interval rows (anchor, low, high, depth)."""

    def run(batches):
        for anchor, context, doc, start, before, many, body in _whole_groups(batches):
            names, group = np.unique(np.array(anchor), return_inverse=True)
            rows = []
            for g, suffixes, intervals in maximal_repeats(group, np.array(doc), np.array(start), body, before, many, length):
                name = int(names[g])
                rows += [(name, lo, hi, depth, None, None, None, None) for lo, hi, depth in intervals]
                rows += [(name, None, None, None, i, context[k], o, r) for i, (k, o, r) in enumerate(suffixes)]
            if rows:
                kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in _TREE.split(", ")])

    columns = contexts.select("anchor", "context", "doc", "start", "before", "many", "body")
    return columns.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _TREE)


def _parts(before: int, size: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(part, low, high): the distances from a stretch's start to the anchor that a context has, in parts of ``PART``."""
    low, high = before - min(before, size - length), before
    for part in range(low // PART, high // PART + 1):
        yield part, max(low, part * PART), min(high, part * PART + PART - 1)


def _part_rows(contexts: DataFrame, length: int) -> DataFrame:
    """A row for each part of the contexts of crowded anchors.

    ``core`` hashes the bytes that all stretches of the part share, ``sub`` all bytes that they reach; ``left`` is the byte
    before those, 256 at a context's edge.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for anchor, context, before, many, body in zip(*(c.to_pylist() for c in batch.columns)):
                for part, low, high in _parts(before, len(body), length):
                    core = xxhash.xxh3_64_intdigest(body[before - part * PART:before - min(part * PART + PART - 1, length - GRAM) + length])
                    sub = xxhash.xxh3_64_intdigest(body[before - high:before - low + length], (low << 16) + high)
                    left = body[before - high - 1] if before > high else 256
                    rows.append((anchor, part, core - (1 << 63), sub - (1 << 63), context, before, low, high, many, left))
            if rows:
                kinds = [pa.int64(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int16(), pa.bool_(), pa.int16()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["anchor", "part", "core", "sub", "context", "before", "low", "high", "many", "left"])

    schema = "anchor long, part short, core long, sub long, context long, before short, low short, high short, many boolean, left short"
    return contexts.select("anchor", "context", "before", "many", "body").mapInArrow(run, schema)


def _stretch_rows(bodies: DataFrame, length: int) -> DataFrame:
    """(anchor, k1, k2, context, part, away, many, l, r) of every stretch of the given parts of contexts.

    ``away`` is the distance to the anchor, so equal rows but for the context are different places. ``l`` and ``r`` are the
    smallest and largest byte before the stretch in all contexts that share its part; only a part's first stretch can have several.
    """

    def run(batches):
        for batch in batches:
            anchor, context, before, wanted, body = (c.to_pylist() for c in batch.columns)
            for a, b in by_size([len(x) for x in body], 1 << 18):
                owner, offset, x, y, left = stretch_classes(body[a:b], before[a:b], length)
                away = np.array(before[a:b], np.int64)[owner] - offset
                table = np.zeros((3, b - a, (length - GRAM) // PART + 1), np.int16)  # 0: not wanted, 1: one place, 2: many; l; r
                for i, parts in enumerate(wanted[a:b]):
                    for w in parts:
                        table[:, i, w["part"]] = 1 + w["many"], w["l"], w["r"]
                state, l, r = table[:, owner, away // PART]
                opens = away == np.minimum(np.array(before[a:b], np.int64)[owner], away // PART * PART + PART - 1)
                l, r = np.where(opens, l, left), np.where(opens, r, left)
                k = np.flatnonzero(state)
                take = lambda v: pa.array(np.array(v[a:b], np.int64)[owner[k]])
                yield pa.RecordBatch.from_arrays(
                    [take(anchor), pa.array(x[k].view(np.int64)), pa.array(y[k].view(np.int64)), take(context), pa.array((away[k] // PART).astype(np.int16)),
                     pa.array(away[k].astype(np.int16)), pa.array(state[k] > 1), pa.array(l[k].astype(np.int16)), pa.array(r[k].astype(np.int16))],
                    ["anchor", "k1", "k2", "context", "part", "away", "many", "l", "r"])

    schema = "anchor long, k1 long, k2 long, context long, part short, away short, many boolean, l short, r short"
    return bodies.select("anchor", "context", "before", "wanted", "body").mapInArrow(run, schema)


class RepeatIndex:
    """Maximal repeats of a corpus.

    ``places``: (d, mark, start, anchor, context) of every context with a repeated anchor; ``trees``: suffixes and
    intervals of the anchors with several contexts; ``whole``: (anchor, context, size) of contexts that occur more than once;
    ``crowded`` and ``dealt``: repeated ranges, and left-diverse repeated stretches, of anchors with very many contexts.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, length: int = LENGTH):
        ship(spark)
        self.length = length
        self.docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns(
            {"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "mark": F.xxhash64("text")})
        shelf = Shelf(spark)
        found = shelf.put(_anchor_rows(self.docs.select("d", "mark", "text"), length), "anchors")
        twice = shelf.put(found.groupBy("anchor").count().filter("count > 1").select("anchor"), "twice")
        self.places = stored(spark, found.join(twice, "anchor"), "places")
        shelf.free("anchors", "twice")
        at = F.struct("d", "mark", "start", "size")
        # Equal grams of one text may have the same context; repeated rows have the same gram at the same place.
        many = (F.min(at) != F.max(at)) | (F.count(F.lit(1)) > F.size(F.collect_set("before")))
        contexts = self.places.groupBy("anchor", "context").agg(F.min(at).alias("at"), F.max("before").alias("before"), many.alias("many"))
        contexts = shelf.put(contexts, "contexts")
        self.whole = stored(spark, contexts.filter("many").select("anchor", "context", F.col("at.size").cast("int").alias("size")), "whole")
        crowd = shelf.put(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowd")
        several = contexts.join(crowd, "anchor")
        wanted = several.groupBy("at.d", "at.mark").agg(F.collect_list(F.struct(
            "anchor", "context", "n", "many", F.xxhash64("at.d", "at.mark").alias("doc"), "at.start", "at.size", "before")).alias("cuts"))
        body = F.col("text").cast("binary")
        cut = F.transform("cuts", lambda c: F.struct(
            c["anchor"].alias("anchor"), c["context"].alias("context"), c["n"].alias("n"), c["many"].alias("many"), c["doc"].alias("doc"),
            c["start"].alias("start"), c["before"].alias("before"),
            F.substring(body, c["start"].cast("int") + 1, c["size"].cast("int")).alias("body")))
        # Rows that repeat both doc_id and text cut their contexts twice; those occur many times anyway.
        texts = self.docs.select("d", "mark", "text").join(wanted, ["d", "mark"]).select(F.inline(cut))
        bodies = shelf.put(texts, "bodies")
        shelf.free("contexts", "crowd")
        self.trees = stored(spark, _trees(bodies.filter(F.col("n") <= GROUP_ROWS), length), "trees")
        self._split_crowds(spark, shelf, bodies.filter(F.col("n") > GROUP_ROWS))
        shelf.free("bodies")

    def _split_crowds(self, spark: SparkSession, shelf: Shelf, bodies: DataFrame) -> None:
        """Repeats of anchors with very many contexts, without a task that sees a whole anchor.

        Stretches are taken in parts of neighbours. A part whose common core occurs once holds no repeat and goes;
        parts that are equal become one, with the range of bytes before them; only the different parts left are opened into
        single stretches.
        """
        name = ["anchor", "part", "core"]
        twice = (F.count(F.lit(1)) > 1) | F.max("many")
        parts = shelf.put(_part_rows(bodies, self.length), "parts")
        cores = parts.groupBy(*name).agg(twice.alias("twice")).filter("twice").drop("twice")
        parts = stored(spark, parts.join(cores, name), "cores")
        shelf.free("parts")
        subs = stored(spark, parts.groupBy(*name, "sub").agg(
            F.min("context").alias("context"), twice.alias("many"), F.min("left").alias("l"), F.max("left").alias("r")), "subs")
        wanted = subs.groupBy("anchor", "context").agg(F.collect_list(F.struct("part", "many", "l", "r")).alias("wanted"))
        key = ["anchor", "away", "k1", "k2"]
        stretches = shelf.put(_stretch_rows(bodies.drop("many").join(wanted, ["anchor", "context"]), self.length), "stretches")
        classes = stretches.groupBy(*key).agg(twice.alias("twice"), F.min("l").alias("l"), F.max("r").alias("r")).filter("twice")
        self.classes = stored(spark, classes.drop("twice"), "classes")
        repeated = stored(spark, stretches.drop("l", "r").join(self.classes, key), "repeated")
        shelf.free("stretches")
        # A stretch of a part stands in all contexts that have the part.
        owners = parts.select(*name, "sub", F.col("context").alias("owner"), "before").join(
            subs.select(*name, "sub", "context"), [*name, "sub"]).select("anchor", "part", "context", "owner", "before")
        self.dealt = repeated.filter("l <> r or r = 256").select("anchor", "part", "context", "away", "k1", "k2").join(
            owners, ["anchor", "part", "context"]).select("anchor", F.col("owner").alias("context"), (F.col("before") - F.col("away")).alias("offset"), "k1", "k2")
        full = parts.join(subs.filter("many").select(*name, "sub"), [*name, "sub"]).select(
            "anchor", "context", F.struct((F.col("before") - F.col("high")).cast("int").alias("a"),
                                          (F.col("before") - F.col("low") + self.length).cast("int").alias("b")).alias("r"))
        at = stored(spark, bodies.select("anchor", "context", "before"), "crowd_contexts")
        single = repeated.filter("not many").select("anchor", "context", "away").join(at, ["anchor", "context"]).select(
            "anchor", "context", F.struct((F.col("before") - F.col("away")).cast("int").alias("a"),
                                          (F.col("before") - F.col("away") + self.length).cast("int").alias("b")).alias("r"))
        self.crowded = full.unionByName(single)

    def groups(self) -> DataFrame:
        """Maximal repeats with all occurrences: anchor, low, high, depth, rank, doc_id, start.

        A repeat is named by its anchor and its interval of the anchor's suffix array. A stretch of a crowded anchor
        is a group of depth ``length``, named by its two hashes.
        """
        null_id = lambda c: F.when(c != -(1 << 63), c)
        place = self.places.select("anchor", "context", "d", "start")
        suffix = self.trees.filter("rank is not null").select("anchor", "rank", "context", "offset")
        interval = self.trees.filter("rank is null").select("anchor", "low", "high", "depth")
        inside = interval.join(suffix, "anchor").filter("rank between low and high")
        named = inside.select("anchor", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), "depth", "context", "offset").distinct()
        lone = self.whole.join(self.trees.select("anchor").distinct(), "anchor", "left_anti").select(
            "anchor", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.col("size").alias("depth"), "context", F.lit(0).alias("offset"))
        dealt = self.dealt.select("anchor", F.col("k1").alias("low"), F.col("k2").alias("high"), F.lit(self.length).alias("depth"), "context", "offset")
        every = named.unionByName(lone).unionByName(dealt)
        return every.join(place, ["anchor", "context"]).select(
            "anchor", "low", "high", "depth", null_id(F.col("d")).alias("doc_id"), (F.col("start") + F.col("offset")).alias("start"))

    def spans(self) -> DataFrame:
        """(d, mark, spans): the ranges of bytes of a text that lie in repeats, in no order and with overlaps.

        A range is one number, ``RANGE`` times its first byte and the byte after its last: a quarter of the bytes of a structure.
        """
        packed = lambda a, b: (a.cast("long") * RANGE + b).alias("r")
        run = packed(F.col("offset"), F.col("offset") + F.col("reach"))
        crowded = self.crowded.select("anchor", "context", packed(F.col("r.a"), F.col("r.b")))
        covered = (self.trees.filter("reach > 0").select("anchor", "context", run).unionByName(crowded)
                   .groupBy("anchor", "context").agg(F.collect_set("r").alias("runs")))
        whole = self.whole.select("anchor", "context", F.array(F.col("size").cast("long")).alias("all"))
        by_context = stored(self.places.sparkSession, whole.join(covered, ["anchor", "context"], "full").select(
            "anchor", "context", F.coalesce("all", "runs").alias("runs")), "runs")
        shifted = F.transform("runs", lambda r: r + F.col("start") * F.lit(RANGE + 1))
        return (self.places.join(by_context, ["anchor", "context"]).select("d", "mark", shifted.alias("runs"))
                .groupBy("d", "mark").agg(F.flatten(F.collect_list("runs")).alias("spans")))


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per document without the bytes that lie in a string of ``length`` bytes that starts anywhere else too.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with ``keep_text`` kept (binary: a
    cut may fall inside a character). A null text is empty. Rows that repeat a text lose it, whether or
    not they share a doc_id; shorter texts have no such string. Other columns are not read.
    """
    index = RepeatIndex(spark, docs, length)
    joined = index.docs.join(index.spans(), ["d", "mark"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            texts, spans = text_bytes(batch.column(1)), batch.column(2)
            rows = []
            for text, found in zip(texts, spans):
                merged: list[list[int]] = []
                if found.is_valid:
                    for a, b in zip(*(v.tolist() for v in np.divmod(np.unique(found.values.to_numpy()), RANGE))):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))] if rows else
                                             [batch.column(0), *(pa.array([], k) for k in kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = joined.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
