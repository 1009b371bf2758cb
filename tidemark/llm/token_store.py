"""Token ids of a corpus as one concatenated array with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id and sorted; a task encodes its range and writes blocks of
whole documents: the ids as packed little-endian integers (16 bits where the vocabulary allows), the ends of
the documents and their doc_ids as Elias-Fano sequences with select samples. A block is a row of a
Parquet table in the shared folder, so any store that Spark reads holds it, a lost task writes
its blocks again, and a reader fetches single documents by ``select`` without decoding the rest.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.common import LOWER_ASCII, batch_bytes, by_size, ship, text_bytes
from tidemark.llm.elias_fano import EliasFano

BLOCK_TOKENS = 1 << 20
# Bytes of text that a task receives and encodes at once, and words that the tokenizer gets at once; both bound memory.
ENCODED_BYTES, LEARNED_WORDS = 4 << 20, 2_000
# Words whose ids a worker remembers; it bounds memory and changes no result.
REMEMBERED_WORDS = 700_000

_BLOCK = ("part int, seq int, first long, n_docs int, n_tokens long, width int, ids binary, "
          "ends_bits int, ends_low binary, ends_high binary, ends_samples binary, "
          "n_null int, base_id long, doc_bits int, doc_low binary, doc_high binary, doc_samples binary")
# One letter run of the alphabets that case and normal forms leave a single word.
_ONE_WORD = re.compile(r"[a-zß-öø-ÿœ]+\Z")


class WordEncoder:
    """Ids of whole texts through a memory of words.

    Only for tokenizers whose normaliser and pre-tokenizer never join characters across ASCII white
    space and that ignore ASCII case: then the ids of a text are those of its words in order. A text
    that may hold a special token is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.closing = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self.special = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A word's row gives where its ids begin in one flat array, and how many they are.
        self.rows: dict[bytes, int] = {}
        self.begin, self.count, self.flat, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32), 0
        self.marks = {m: self._plain([chr(m)])[0] for m in b".,"}

    def _plain(self, texts: list[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, word: bytes) -> tuple[int, ...]:
        row = self.rows[word]
        return tuple(self.flat[self.begin[row]:self.begin[row] + self.count[row]].tolist())

    def _learn(self, missing: list[bytes]) -> None:
        """Add rows for words that have none."""
        # A last full stop or comma after a letter is always a token run of its own.
        stems = {w: w[:-1] for w in missing if len(w) > 1 and w[-1] in self.marks and 97 <= w[-2] <= 122}
        found: dict[bytes, tuple[int, ...]] = {}
        single, odd = [], []
        for w in dict.fromkeys([*(w for w in missing if w not in stems), *stems.values()]):
            if w not in self.rows:
                (single if _ONE_WORD.match(w.decode()) else odd).append(w)
        for a in range(0, len(single), LEARNED_WORDS):
            part = single[a:a + LEARNED_WORDS]
            ids = np.array(self._plain([b" ".join(part).decode()])[0])
            cuts = np.flatnonzero(self.closing[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("a word did not end with a closing token")
            flat, start = ids.tolist(), 0
            for w, stop in zip(part, cuts.tolist()):
                found[w], start = tuple(flat[start:stop]), stop
        for a in range(0, len(odd), LEARNED_WORDS):
            part = odd[a:a + LEARNED_WORDS]
            found.update(zip(part, self._plain([w.decode() for w in part])))
        for w, stem in stems.items():
            found[w] = (found[stem] if stem in found else self._ids(stem)) + self.marks[w[-1]]
        counts = np.fromiter(map(len, found.values()), np.int64, len(found))
        first, total = len(self.rows), int(counts.sum())
        while first + len(found) > len(self.begin):
            self.begin, self.count = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.count, np.zeros_like(self.count))
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used:self.used + total] = np.fromiter((i for ids in found.values() for i in ids), np.int64, total)
        self.count[first:first + len(found)] = counts
        self.begin[first:first + len(found)] = self.used + np.cumsum(counts) - counts
        self.used += total
        self.rows.update(zip(found, range(first, first + len(found))))

    def _forget(self, kept: int, used: int) -> None:
        """Drop the rows from ``kept`` on, which are the last ones added."""
        for w in list(islice(reversed(self.rows), len(self.rows) - kept)):
            del self.rows[w]
        self.used = used

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """Ids of each text with ``end_id`` appended."""
        split = [() if any(s in t for s in self.special) else t.translate(LOWER_ASCII).split() for t in texts]
        kept, used = len(self.rows), self.used
        self._learn([w for w in set().union(*split) if w not in self.rows])
        words = list(map(len, split))
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(split)), np.int64, sum(words))
        n = self.count[at]
        ends = np.cumsum(n)
        ids = self.flat.take(np.repeat(self.begin[at] - (ends - n), n) + np.arange(int(n.sum())))
        edges = np.concatenate([[0], ends])[np.cumsum([0, *words])].tolist()
        out = []
        for text, row, a, b in zip(texts, split, edges, edges[1:]):
            one = ids[a:b] if row or not text else np.array(self._plain([text.decode()])[0], np.int64)
            out.append(np.append(one, end_id))
        if len(self.rows) > REMEMBERED_WORDS:
            self._forget(kept, used)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _block(part: int, seq: int, first: int, ids: list[np.ndarray], docs: list[int | None], width: int) -> dict:
    numbers = [d for d in docs if d is not None]
    base = numbers[0] if numbers else 0
    ends = EliasFano.encode(np.cumsum([len(x) for x in ids]))
    keys = EliasFano.encode(np.array([d - base for d in numbers], np.uint64))
    return {"part": part, "seq": seq, "first": first, "n_docs": len(ids), "n_tokens": sum(map(len, ids)), "width": width,
            "ids": np.concatenate(ids).astype(f"<u{width}").tobytes(),
            "ends_bits": ends.low_bits, "ends_low": ends.low, "ends_high": ends.high, "ends_samples": ends.samples,
            "n_null": len(docs) - len(numbers), "base_id": base,
            "doc_bits": keys.low_bits, "doc_low": keys.low, "doc_high": keys.high, "doc_samples": keys.samples}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, parts: int | None = None,
                 block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode ``docs`` in ascending doc_id order (null first; ties by text) and write the blocks to ``path``."""
    spark = docs.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in _BLOCK.split(", ")])

    def run(batches):
        encoder = _encoder(tokenizer)
        width = 2 if max(encoder.size - 1, end_id) < 1 << 16 else 4
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        ids, ends, held = [], [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in by_size(pc.binary_length(texts).fill_null(0).to_pylist(), ENCODED_BYTES):
                for key, x in zip(keys[a:b], encoder.encode(text_bytes(texts.slice(a, b - a)), end_id)):
                    if ids and held + len(x) > block_tokens:
                        yield pa.RecordBatch.from_pylist([_block(part, seq, first, ids, ends, width)], schema)
                        seq, first, ids, ends, held = seq + 1, first + held, [], [], 0
                    ids.append(x.astype(f"<u{width}"))
                    ends.append(key)
                    held += len(x)
        if ids:
            yield pa.RecordBatch.from_pylist([_block(part, seq, first, ids, ends, width)], schema)

    with batch_bytes(spark, ENCODED_BYTES):
        (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
         .repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
         .mapInArrow(run, _BLOCK).write.option("compression", "zstd").parquet(path))


def boundaries(row: dict) -> EliasFano:
    """The ends of a block's documents, for ``select``."""
    return EliasFano(row["n_docs"], row["ends_bits"], row["ends_low"], row["ends_high"], row["ends_samples"])


def document(row: dict, i: int) -> np.ndarray:
    """The ids of the i-th document of a block, by two selects."""
    ends = boundaries(row)
    start = ends.select(i - 1) if i else 0
    return np.frombuffer(row["ids"], f"<u{row['width']}", ends.select(i) - start, start * row["width"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = boundaries(row).decode().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                numbers = EliasFano(row["n_docs"] - row["n_null"], row["doc_bits"], row["doc_low"], row["doc_high"], row["doc_samples"]).decode()
                keys = [None] * row["n_null"] + [row["base_id"] + int(d) for d in numbers.tolist()]
                wide = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                sums = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([row["part"]] * len(keys), pa.int32()), pa.array(starts + row["first"]),
                     pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    ship(spark)
    blocks = spark.read.parquet(path)
    # One row per part of the range partitioning, whatever the number of documents.
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rows = blocks.mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
