"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the whole text, weighed by TF-IDF and scaled to unit
length. Document frequencies come from all documents that may be learned from. The model is
fitted on a bounded sample of labelled ones, drawn evenly over the languages, with
follow-the-regularised-leader steps under an elastic net, so most weights are exactly zero;
a temperature fitted on a part set aside makes its probabilities honest. Prediction is one
pass over the documents without a shuffle.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tidemark.llm.common import SAMPLE_RANGE, sample_share, ship, vector_blocks, vector_sum

BUCKETS = 1 << 16
UNDETERMINED = "und"
_SPACE = 32
_LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd, of the golden ratio and of primes


def letters(text: str) -> np.ndarray:
    """Code points in lower case, every run of anything but letters as one space, a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_LETTER[codes], codes, np.uint32(_SPACE))
    gap = codes == _SPACE
    return codes[~gap | ~np.concatenate([[False], gap[:-1]])]


def ngram_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-grams, blanks alone excepted."""
    c = codes.astype(np.uint64)
    one = c * _MULTIPLIERS[0]
    two = one[:-1] + c[1:] * _MULTIPLIERS[1] + np.uint64(1)
    three = two[:-1] + c[2:] * _MULTIPLIERS[2] + np.uint64(2)
    mixed = np.concatenate([one[c != _SPACE], two, three])
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MULTIPLIERS[1]) >> np.uint64(48)).astype(np.int64)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a text, or None if it has no letter."""
    codes = letters(text or "")
    if len(codes) < 2:
        return None
    buckets = ngram_buckets(codes)
    if len(buckets) < 4_000:
        return np.unique(buckets, return_counts=True)
    counts = np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    """FTRL-proximal multinomial regression; ``alpha``, ``beta``, ``l1`` and ``l2`` are its published parameters."""

    languages: list[str]
    idf: np.ndarray
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    temperature: float = 1.0
    weights: np.ndarray = field(default=None)

    def features(self, text: str | None):
        counted = term_counts(text)
        if counted is None:
            return None
        at, counts = counted
        x = (1.0 + np.log(counts)) * self.idf[at]
        return at, x / (np.sqrt((x * x).sum()) or 1.0)

    def fit(self, examples: list[tuple[str, str]], passes: int = 4, seed: int = 0) -> LanguageModel:
        """Fit on (text, language); every eighth example only sets the temperature."""
        place = {x: i for i, x in enumerate(self.languages)}
        rows = [(f, place[y]) for t, y in examples if (f := self.features(t)) is not None]
        order = np.random.default_rng(seed).permutation(len(rows))
        aside = [rows[i] for i in order[::8]]
        learn = [rows[i] for n, i in enumerate(order) if n % 8] or aside
        k = len(self.languages)
        z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
        for p in range(passes):
            for i in np.random.default_rng(seed + 1 + p).permutation(len(learn)):
                (at, x), y = learn[i]
                at, x = np.append(at, BUCKETS), np.append(x, 0.1)  # the last row is the intercept
                w = self._solve(z[at], n[at])
                g = x[:, None] * (_softmax(x @ w) - (np.arange(k) == y))
                s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha
                z[at] += g - s * w
                n[at] += g * g
        self.weights = self._solve(z, n).astype(np.float32)
        logits = np.array([self._logits(f) for f, _ in aside or learn])
        truth = np.array([y for _, y in aside or learn])
        grid = np.exp(np.linspace(math.log(0.02), math.log(5), 120))
        losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])
        return self

    def _solve(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def _logits(self, f):
        at, x = f
        return x @ self.weights[at] + 0.1 * self.weights[BUCKETS]

    def predict(self, text: str | None) -> tuple[str, float]:
        f = self.features(text)
        if f is None or not self.languages:
            return UNDETERMINED, 0.0
        p = _softmax(self._logits(f).astype(float) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], min(1.0, float(p[best]))


def _softmax(a):
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out():
    """Whether a document's row is only predicted: crc32 of its id as text is divisible by 5. A null id counts as held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that hold each bucket; the last place counts all documents with a letter."""

    def run(batches):
        df = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (counted := term_counts(text)) is not None:
                    df[counted[0]] += 1
                    df[BUCKETS] += 1
        yield vector_blocks(df)

    return vector_sum(docs.select(F.col("text").cast("string")).mapInArrow(run, "block int, part binary"), BUCKETS + 1, np.int64)


def _pieces(text: str) -> list[str]:
    """A document as training examples: whole, a stretch of a dozen words, and a few words."""
    words = text.split()
    middle = len(words) // 2
    return [text] + [" ".join(words[middle:middle + n]) for n in (12, 3) if len(words) > n]


def fit_language_model(docs: DataFrame, per_language: int = 400, max_languages: int = 512, max_chars: int = 20_000) -> LanguageModel:
    """Fit on rows that are not held out and have a language.

    Document frequencies use all of those rows and their whole texts. The regression uses at most
    ``per_language`` documents of each language, those with the smallest hash, and of each at most ``max_chars``
    characters; these bounds hold only for fitting. More than ``max_languages`` languages are refused.
    """
    ship(docs.sparkSession)
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df = _document_frequencies(labelled)
    idf = np.log((1.0 + df[BUCKETS]) / (1.0 + df[:BUCKETS])) + 0.05
    counts = labelled.groupBy("lang").count()
    if counts.count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    # One row a language, at most ``max_languages``: small enough to broadcast.
    # A first cut by each language's expected share, so that a task offers few rows however many tasks there are.
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE_RANGE))
    few = labelled.withColumn("_place", place).join(F.broadcast(counts), "lang").filter(F.col("_place") < sample_share(per_language, F.col("count")))
    slim = few.select("doc_id", "lang", "_place", F.substring("text", 1, max_chars).alias("text"))
    place = W.partitionBy("lang").orderBy("_place", "doc_id", "text")
    sample = slim.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= per_language).orderBy("lang", "place").collect()
    examples = [(p, r["lang"]) for r in sample for p in _pieces(r["text"])]
    return LanguageModel(languages, idf.astype(np.float64)).fit(examples) if examples else LanguageModel([], idf)


def identify(docs: DataFrame, model: LanguageModel, prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns: a learned language and its probability.

    A text that is null or has no letter is ``und`` with score 0. Only the text is looked at. Columns of
    ``docs`` that bear the new names are replaced; rows are independent, so repeated ones agree.
    """
    ship(docs.sparkSession)
    docs = docs.drop(prediction, score)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, prediction, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)
