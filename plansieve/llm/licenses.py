"""Licence scans with a positional index of rare words.

The index holds the licence templates' words with their positions. How rare a word is, is counted over all documents
(one small aggregate: only words of the index are counted). Of each template's mandatory key phrase the rarest word is its
anchor: without the phrase the template is not accepted, so no match is missed, whatever other words are altered. An anchor at word p of the document that stands at word q
of a template proposes that the template begins at p - q. A proposal is accepted if the key phrase stands there word by word and the IDF weight of the
template words that stand at their relative positions, or within ``DRIFT`` words of them on the same side of the phrase (words may have been put in or left out), makes up
``MIN_SCORE`` of the template's. The base phrases are templates of which every word is mandatory; they are found wherever they stand.

Finding anchors is done on the word arrays in the JVM; only documents that hold an anchor hand their words to Python. Nothing is
shuffled but the word counts.

Defined results: a null or wordless text has no words, no places, empty labels and score 0; repeated rows each get their
own result; overlapping places all count; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import NOT_ALNUM, lower_ascii, split_words, table

MIN_SCORE = 0.8
DRIFT = 3

# The base phrases, and the notices that licences ask to be placed in a work, as lower-case words.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]  # stands in words, once


def _template(label: str, words: str, key: str) -> Template:
    return Template(label, tuple(words.split()), tuple(key.split()))


TEMPLATES = [
    _template("mit", "released under the mit license", "mit license"),
    _template("mit", "licensed under the mit license", "mit license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    _template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    _template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    _template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    _template("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    _template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    _template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    _template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    _template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    _template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    _template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    _template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0 the license"),
    _template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    _template("bsd", "available under the terms of the bsd license", "the bsd license"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    _template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    _template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license"),
    _template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "the eclipse public license 2 0"),
    _template("epl-2.0", "made available under the terms of the eclipse public license v 2 0", "the eclipse public license v 2 0"),
    _template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "all copyright and related or neighboring rights"),
    _template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "the terms of the gnu free documentation license"),
    *(
        # Names by which a licence is told without a notice.
        _template(label, name, name)
        for label, name in [
            ("bsd-3-clause", "bsd 3 clause license"), ("bsd-2-clause", "bsd 2 clause license"), ("boost-1.0", "boost software license version 1 0"),
            ("artistic-2.0", "artistic license 2 0"), ("cddl-1.0", "common development and distribution license"), ("wtfpl", "do what the fuck you want to public license"),
        ]
    ),
    *(
        _template(label, f"spdx license identifier {words}", f"license identifier {words}")
        for label, words in [
            ("mit", "mit"), ("apache-2.0", "apache 2 0"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-2-clause", "bsd 2 clause"), ("gpl-2.0", "gpl 2 0"),
            ("gpl-3.0", "gpl 3 0"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl-2.0", "mpl 2 0"), ("isc", "isc"), ("cc0-1.0", "cc0 1 0"), ("unlicense", "unlicense"),
        ]
    ),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]


class Index:
    """Postings of the templates' words, weighted by inverse document frequency."""

    def __init__(self, templates: list[Template], base: dict[str, str], n_docs: int, doc_counts: dict[str, int]):
        self.templates, self.base = templates, [(tuple(p.split()), label) for p, label in base.items()]
        self.idf = {w: math.log((1 + n_docs) / (1 + doc_counts.get(w, 0))) for w in self.vocabulary(templates, base)}
        self.proposals: dict[str, list[tuple[int, int]]] = {}
        self.phrases: dict[str, list[tuple[int, int]]] = {}
        for t, template in enumerate(templates):
            # One place of the word is enough, here and below: it finds the whole phrase.
            word = self._rarest(template.key)
            self.proposals.setdefault(word, []).append((t, self._key_at(template) + template.key.index(word)))
        for b, (words, _) in enumerate(self.base):
            word = self._rarest(words)
            self.phrases.setdefault(word, []).append((b, words.index(word)))

    @staticmethod
    def vocabulary(templates: list[Template], base: dict[str, str]) -> set[str]:
        return {w for t in templates for w in t.words} | {w for p in base for w in p.split()}

    def _rarest(self, words: tuple[str, ...]) -> str:
        return min(words, key=lambda w: (-self.idf[w], w))

    @staticmethod
    def _key_at(template: Template) -> int:
        n = len(template.key)
        return next(q for q in range(len(template.words)) if template.words[q : q + n] == template.key)

    def anchors(self) -> list[str]:
        return sorted(self.proposals.keys() | self.phrases.keys())

    def _score(self, template: Template, words: list[str], start: int) -> float:
        """The share of the template's weight that stands around its key phrase, 0 if the phrase does not stand in its place."""
        key, n = self._key_at(template), len(template.key)
        begin = start + key
        if begin < 0 or tuple(words[begin : begin + n]) != template.key:
            return 0.0
        whole = found = 0.0
        for q, w in enumerate(template.words):
            low, high = start + q - DRIFT, start + q + DRIFT + 1
            if q < key:
                near = words[max(low, 0) : max(min(high, begin), 0)]
            elif q < key + n:
                near = (w,)
            else:
                near = words[max(low, begin + n) : high]
            whole += self.idf[w]
            found += self.idf[w] if w in near else 0.0
        return min(1.0, found / whole) if whole > 0 else 1.0

    def scan(self, words: list[str], places: list[int]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, method labels, best score; ``places`` are those of the anchor words."""
        starts, base_labels, labels, best, proposed = [], set(), set(), 0.0, set()
        for p in places:
            for b, q in self.phrases.get(words[p], ()):
                phrase, label = self.base[b]
                if p >= q and tuple(words[p - q : p - q + len(phrase)]) == phrase:
                    starts.append(p - q)
                    base_labels.add(label)
            proposed.update((t, p - q) for t, q in self.proposals.get(words[p], ()))
        for t, start in proposed:
            score = self._score(self.templates[t], words, start)
            if score >= MIN_SCORE:
                labels.add(self.templates[t].label)
                best = max(best, score)
        return starts, base_labels, labels, best


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_SCANNED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def build_index(words: DataFrame, templates: list[Template] = TEMPLATES, base: dict[str, str] = BASE_PHRASES) -> Index:
    """The index with word counts over all rows of ``words`` (column words); at most one row per index word is collected."""
    known = F.array(*map(F.lit, sorted(Index.vocabulary(templates, base))))
    # Every document also counts for the word '', so one pass gives the number of documents.
    found = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(known, "words"))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return Index(templates, base, counts.pop("", 0), counts)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), split_words(lower_ascii(F.col("text")), NOT_ALNUM).alias("words")
    )
    index = build_index(words)
    places = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(index.anchors()), i)), lambda i: i.isNotNull()
    )
    anchored = words.withColumn("places", places).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "places", F.when(F.size("places") > 0, F.col("words")).alias("words")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_base, first, last, base_labels, labels, scores = [], [], [], [], [], []
            for where, text_words in zip(batch.column("places").to_pylist(), batch.column("words")):
                starts, base, more, score = index.scan(text_words.as_py(), where) if where else ([], set(), set(), 0.0)
                n_base.append(len(starts))
                first.append(min(starts, default=None))
                last.append(max(starts, default=None))
                base_labels.append(",".join(sorted(base)))
                labels.append(",".join(sorted(base | more)))
                scores.append(score)
            columns = [batch.column("doc_id"), batch.column("n_words"), n_base, first, last, base_labels, labels, scores]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCANNED_ARROW)], schema=_SCANNED_ARROW
            )

    return anchored.mapInArrow(run, SCANNED)


# --- query ---------------------------------------------------------------------------------------------


def op9_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
