"""License scans with a positional index of rare words.

Templates are short notices. Their words are weighed by how few documents of the corpus hold
them, and each template is indexed by its rarest words: word -> (template, offset). In a file every
occurrence of an indexed word proposes a place, its position less the offset. Places proposed by
all index words of a template are intersected, then verified: a base phrase must stand there word for
word; a notice must have its mandatory key phrases at their relative positions, give or take a
few words, and enough of its other words in order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import by_size, ship, text_bytes

# A word is a run of bytes other than these; A-Z are lower-cased on the way.
_SEPARATORS = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)}
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256))

# Phrases that give a label wherever they stand.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Openings of published licenses; the phrases in the list are mandatory.
NOTICES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            ["permission is hereby granted free of charge"]),
    "apache-2": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
                 ["licensed under the apache license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            ["redistribution and use in source and binary forms"]),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
            ["gnu general public license"]),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
             ["gnu lesser general public license"]),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            ["permission to use copy modify"]),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # mandatory phrases with their offsets
    exact: bool


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def make_templates(base=BASE_PHRASES, notices=NOTICES) -> list[Template]:
    found = [Template(label, w := tuple(words_of(p.encode())), ((0, w),), True) for p, label in base.items()]
    for label, (text, keys) in notices.items():
        words = tuple(words_of(text.encode()))
        places = []
        for key in keys:
            k = tuple(words_of(key.encode()))
            places.append((next(i for i in range(len(words)) if words[i:i + len(k)] == k), k))
        found.append(Template(label, words, tuple(places), False))
    return found


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each template word stands; one count for each word of the templates."""

    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = defaultdict(int)
            for text in text_bytes(batch.column(0)):
                for w in vocabulary.intersection(words_of(text)):
                    seen[w] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}


class PositionalIndex:
    """Postings of each template's rarest words, and the search through one document."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], rare: int = 3, drift: int = 2, least: float = 0.8):
        self.templates, self.drift, self.least = templates, drift, least
        self.vocabulary = {w for t in templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for n, t in enumerate(templates):
            # Only words of the mandatory phrases can be relied on; equal words count once.
            sure = sorted({w for _, k in t.keys for w in k}, key=lambda w: (frequency.get(w, 0), w))[:rare]
            self.needed.append(set(sure))
            for at, w in enumerate(t.words):
                if w in sure and any(o <= at < o + len(k) for o, k in t.keys):
                    self.postings[w].append((n, at))

    def find(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words found) of every verified place."""
        at: dict[bytes, list[int]] = defaultdict(list)
        indexed = self.postings.keys()
        if not indexed & set(words):
            return []
        for i, w in enumerate(words):
            if w in self.vocabulary:
                at[w].append(i)
        proposed: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for w in indexed & at.keys():
            for i in at[w]:
                for n, offset in self.postings[w]:
                    proposed[n, i - offset].add(w)
        found = []
        for (n, start), by in proposed.items():
            t = self.templates[n]
            # Key phrases of a notice may have drifted apart; then each proposes its own place.
            whole = len(by) == len(self.needed[n]) or len(t.keys) > 1
            if whole and (score := self._verify(t, start, words, at)):
                found.append((n, start, score))
        return sorted(found)

    def _verify(self, t: Template, start: int, words: list[bytes], at) -> float:
        stands = lambda o, k: o >= 0 and tuple(words[o:o + len(k)]) == k
        if t.exact:
            return float(stands(start, t.words))
        for offset, key in t.keys:
            if not any(stands(start + offset + d, key) for d in range(-self.drift, self.drift + 1)):
                return 0.0
        matched, last = 0, max(start - self.drift, 0) - 1
        for i, w in enumerate(t.words):
            places = at.get(w, ())
            k = bisect_left(places, max(last + 1, start + i - self.drift))
            if k < len(places) and places[k] <= start + i + self.drift:
                matched, last = matched + 1, places[k]
        share = matched / len(t.words)
        return share if share >= self.least else 0.0


def scan_licenses(spark: SparkSession, docs: DataFrame, base=BASE_PHRASES, notices=NOTICES, rare: int = 3) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of base phrases, overlapping ones included; ``score`` is the largest share of a
    template's words that was found, 1 for a base phrase, 0 where nothing was. A null text is
    empty: no words, no places, empty label strings. Rows are independent, so repeated ones
    give repeated results. The index holds the templates only, never the corpus.
    """
    ship(spark)
    templates = make_templates(base, notices)
    index = PositionalIndex(templates, document_frequencies(docs, {w for t in templates for w in t.words}), rare)

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in by_size([len(t) for t in texts]):
                rows = []
                for text in texts[a:b]:
                    words = words_of(text)
                    found = index.find(words)
                    starts = [s for n, s, _ in found if templates[n].exact]
                    labels = sorted({templates[n].label for n, _, _ in found})
                    based = sorted({templates[n].label for n, _, _ in found if templates[n].exact})
                    rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None),
                                 ",".join(based), ",".join(labels), max((x for *_, x in found), default=0.0)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns],
                                                 ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
