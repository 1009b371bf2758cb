"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most ``distance`` bits agree
up to ``distance // segments`` bits in one of them at least, so each segment has an exact-match
table, and a fingerprint looks up the small Hamming ball around its own segment. Ball members are
reached by setting zero bits only, or by clearing only: of two segments one bit apart exactly one
reaches the other by setting, so every pair is met and half the look-ups are saved. Matches are
verified on all 64 bits. Copies share a fingerprint and are one row before any look-up.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import LOWER_ASCII, Shelf, by_size, ship, stored, text_bytes

BITS = 64
HASH_SEED = 42  # seed of the shingle hash, fixed by the contract


def shingle_hashes(text: bytes, width: int, seed: int = HASH_SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words, of the whole sequence if shorter, none if there is no word."""
    words = text.translate(LOWER_ASCII).split()  # splits bytes at space, \t, \n, \v, \f and \r
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - width + 1].tolist()
    stops = (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp long) of whole texts; a text without words, or null, has 0."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in by_size([len(t) for t in texts]):
                fps = np.array([simhash(shingle_hashes(t, width)) for t in texts[a:b]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(fps)], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ball(segment, size: int, radius: int):
    """Arrays of segment values: those reached by setting, and by clearing, up to ``radius`` bits.

    For radius 1 the setting half alone meets every pair. Larger radii mix both and use the whole ball.
    """
    if radius == 0:
        return F.array(segment)
    bits = [1 << b for b in range(size)]
    if radius == 1:
        unset = F.filter(F.array(*[F.lit(b).cast("long") for b in bits]), lambda b: segment.bitwiseAND(b) == 0)
        return F.concat(F.array(segment), F.transform(unset, lambda b: segment.bitwiseOR(b)))
    masks = [sum(c) for r in range(radius + 1) for c in combinations(bits, r)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: segment.bitwiseXOR(m))


def near_pairs(nodes: DataFrame, distance: int, segments: int) -> DataFrame:
    """(a, b): ids of ``nodes`` (id, fp; fp distinct) whose fingerprints differ in at most ``distance`` bits."""
    size = -(-BITS // segments)
    cut = F.array(*[F.struct(F.lit(k).alias("part"), F.shiftrightunsigned("fp", k * size).bitwiseAND(F.lit((1 << min(size, BITS - k * size)) - 1)).alias("value"))
                    for k in range(segments)])
    index = nodes.select(F.col("id").alias("b"), F.col("fp").alias("fp_b"), F.inline(cut))
    looked = F.array(*[F.struct(F.lit(k).alias("part"), _ball(F.shiftrightunsigned("fp", k * size).bitwiseAND(F.lit((1 << min(size, BITS - k * size)) - 1)),
                                                              min(size, BITS - k * size), distance // segments).alias("values"))
                       for k in range(segments)])
    probes = (nodes.select(F.col("id").alias("a"), F.col("fp").alias("fp_a"), F.inline(looked))
              .select("a", "fp_a", "part", F.explode("values").alias("value")))
    met = probes.join(index, ["part", "value"]).filter(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``pairs``, for every id in a pair.

    Alternating large-star and small-star steps: links are moved to ever smaller neighbours until
    they are stars, however many rounds that takes. Links stay distributed; each round is stored in the shared
    folder, where the round before it goes, and only its checksums reach the driver.
    """
    edges = pairs.select("a", "b").filter("a <> b")
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    before, held = None, Shelf(spark)
    while True:
        arcs = both(edges)
        low = arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = arcs.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.select("m", F.col("b").alias("x")).union(low.select("m", F.col("a").alias("x"))).filter("m <> x")
        edges = held.put(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "stars")
        mark = F.xxhash64("a", "b")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(F.shiftright(mark, 20))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, distance: int = 2, segments: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance`` differing
    bits. Texts without words, null ones included, have fingerprint 0 and link like any other.
    A fingerprint that only rows with a null doc_id have links to nothing and its component is null;
    other rows with a null doc_id share the component of their fingerprint. Repeated rows are returned as often as they come; other columns are not read.
    """
    prints = stored(spark, fingerprints(docs, width), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))  # a class is named by its smallest doc_id
    nodes = stored(spark, classes.filter("id is not null").select("id", "fp"), "classes")
    found = components(spark, stored(spark, near_pairs(nodes, distance, segments), "pairs"))
    named = nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    named = stored(spark, named, "named")
    return (prints.join(named, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
