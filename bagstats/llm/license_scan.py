"""License scans: an exact set-similarity join of text blocks with license templates, and places of license phrases.

A template of m words is looked for in blocks of 2 * L consecutive words, one every L words, where L is the power of
two that holds the template (``LEAST`` or more): a passage of up to L words lies whole in a block.  A block meets a
template if it holds at least ``threshold`` of the template's distinct words.  The join finds every such pair:

* only words of templates count, and they are ordered by their frequency in the whole corpus, rarest first;
* *prefix*: a pair with ``needed`` words in common shares one of the first ``m - needed + 1`` words of the template and one
  of the first ``b - needed + 1`` template words of the block, so only blocks that hold such a word are built;
* *length*: blocks with fewer than ``needed`` template words are left out;
* *position*: at the k-th word in common, what may follow on both sides must still reach ``needed``;
* what is left is counted in full.

Phrases are found through the same order: only places of a phrase's rarest word are compared with the whole phrase.
Templates are parameters, so they, their index and the frequencies of their words (the only thing that is
gathered) do not grow with the input; ``Join`` refuses more than ``MOST_CELLS`` pairs of template and word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bagstats.llm.memo import concat_ranges, text_slices

LEAST = 8
SLICE_BYTES = 4_000_000
MOST_CELLS = 50_000_000

# Phrases and labels of the base scan.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# Customary license statements and the opening clauses of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

# Digits, a-z and everything outside ASCII make words; A-Z count as a-z; all else divides words.
_FOLD = np.full(256, ord(" "), np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _first, _last, _to in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
    _FOLD[ord(_first) : ord(_last) + 1] = np.arange(ord(_to), ord(_to) + ord(_last) - ord(_first) + 1)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the place of each text's first word (one more place at the end); null is empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2] if len(texts) and offsets[-1] else None
    folded = _FOLD[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.uint8)
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(folded)])
    lists = pc.ascii_split_whitespace(plain)
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    return words.filter(pa.array(filled)), before[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int64)


def _words(text: str) -> list[str]:
    return split_words(pa.array([text]))[0].to_pylist()


def frequencies(docs: DataFrame, text_col: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often each word of a small vocabulary stands in all texts: one row a word reaches the driver."""
    wanted = pa.array(sorted(set(vocabulary)), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for texts in text_slices(batch.column(0), SLICE_BYTES):
                codes = pc.index_in(split_words(texts)[0], value_set=wanted).drop_null().to_numpy()
                total += np.bincount(codes, minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([wanted, pa.array(total)], names=["word", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    found = {r.word: r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in wanted.to_pylist()}


class Join:
    """Phrases and templates by ranks of their words in the order of frequency (ties by the word), held by every worker."""

    def __init__(self, templates, phrases, threshold: float, counts: dict[str, int]):
        order = sorted(counts, key=lambda w: (counts[w], w))
        rank = {w: r for r, w in enumerate(order)}
        self.vocabulary = pa.array(order, pa.string())
        self.phrases = [np.array([rank[w] for w in _words(text)]) for _, text in phrases]
        self.phrase_labels = [label for label, _ in phrases]
        self.labels = [label for label, _ in templates]
        words = [_words(text) for _, text in templates]
        if len(words) * len(order) > MOST_CELLS:
            raise ValueError(f"{len(words)} templates of {len(order)} words are more than {MOST_CELLS} pairs")
        if not all(words) or not all(len(p) for p in self.phrases):
            raise ValueError("A template or phrase without words would be in every text")
        self.has = np.zeros((len(words), len(order)), bool)
        for t, w in enumerate(words):
            self.has[t, [rank[x] for x in w]] = True
        self.sizes = self.has.sum(1)
        self.needed = np.array([max(1, math.ceil(round(threshold * m, 9))) for m in self.sizes], np.int64)
        self.spans = np.array([max(LEAST, 1 << (len(w) - 1).bit_length()) for w in words], np.int64)

    def phrase_places(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(phrase, places of its first word): its rarest word is looked up, the others compared."""
        for number, phrase in enumerate(self.phrases):
            rarest = int(np.argmin(phrase))
            at = np.flatnonzero(codes == phrase[rarest]) - rarest
            at = at[(at >= 0) & (at + len(phrase) <= len(codes))]
            for k, code in enumerate(phrase):
                at = at[codes[at + k] == code]
            text = np.searchsorted(starts, at, "right") - 1
            yield number, at[at + len(phrase) <= starts[text + 1]]

    def pairs(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, first word of the block in it, template, words in common) of all pairs that meet the threshold."""
        hits = np.flatnonzero(codes >= 0)
        text = np.searchsorted(starts, hits, "right") - 1
        place, ranks = hits - starts[text], codes[hits].astype(np.int64)
        lengths = np.diff(starts)
        for span in np.unique(self.spans):
            group = np.flatnonzero(self.spans == span)
            yield from self._pairs(group, int(span), text, place, ranks, lengths)

    def _pairs(self, group, span, text, place, ranks, lengths):
        width = self.has.shape[1]
        listed, entry = np.nonzero(self.has[group])  # rows by template, ranks rising: the frequency order
        entry_place = np.arange(len(entry)) - np.searchsorted(listed, listed)
        early = entry_place <= (self.sizes - self.needed)[group][listed]
        by_rank = np.argsort(entry[early], kind="stable")
        keys, owners, places = entry[early][by_rank], listed[early][by_rank], entry_place[early][by_rank]
        starting, in_group = np.zeros(width, bool), self.has[group].any(0)
        starting[keys] = True

        last = np.maximum(-(-lengths // span) - 2, 0)  # number of the last block of each text
        base = np.concatenate([[0], np.cumsum(last + 1)])

        def blocks(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Blocks of words, two for most: (block, index of the word)."""
            index = np.flatnonzero(chosen)
            own = place[index] // span
            right, left = own <= last[text[index]], own > 0
            both = np.concatenate([base[text[index]][right] + own[right], base[text[index]][left] + own[left] - 1])
            return both, np.concatenate([index[right], index[left]])

        wanted = np.unique(blocks(starting[ranks])[0])
        if not len(wanted):
            return
        block, index = blocks(in_group[ranks])
        spot = np.minimum(np.searchsorted(wanted, block), len(wanted) - 1)
        kept = wanted[spot] == block
        entries = np.unique(spot[kept] * width + ranks[index[kept]])  # distinct words of each block, rarest first
        block, rank = entries // width, entries % width
        first = np.searchsorted(block, np.arange(len(wanted)))
        sizes = np.bincount(block, minlength=len(wanted))
        position = np.arange(len(entries)) - first[block]

        left, right = np.searchsorted(keys, rank), np.searchsorted(keys, rank, "right")
        source = np.repeat(np.arange(len(entries)), right - left)
        found = concat_ranges(left, right - left)
        b, t, i, j = block[source], owners[found], places[found], position[source]
        needed = self.needed[group][t]
        fits = (sizes[b] >= needed) & (j <= sizes[b] - needed)  # length and prefix
        b, t, i, j, needed = (x[fits] for x in (b, t, i, j, needed))
        order = np.lexsort((i, t, b))
        b, t, i, j, needed = (x[order] for x in (b, t, i, j, needed))
        if not len(b):
            return
        fresh = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (t[1:] != t[:-1])]))
        met = np.arange(len(b)) - np.repeat(fresh, np.diff(np.append(fresh, len(b))))
        hope = met + np.minimum(self.sizes[group][t] - i, sizes[b] - j) >= needed  # position
        alive = np.logical_and.reduceat(hope, fresh)
        b, t = b[fresh][alive], t[fresh][alive]
        if not len(b):
            return
        inside = concat_ranges(first[b], sizes[b])
        shared = np.add.reduceat(
            self.has[group[np.repeat(t, sizes[b])], rank[inside]].astype(np.int64), np.cumsum(sizes[b]) - sizes[b]
        )
        enough = shared >= self.needed[group][t]
        number = wanted[b[enough]]
        owner = np.searchsorted(base, number, "right") - 1
        yield owner, (number - base[owner]) * span, group[t[enough]], shared[enough]


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = 0.9,
) -> DataFrame:
    """License labels of every row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    ``templates`` and ``phrases`` are (label, text).  ``n_base`` counts the places of phrases, ``first_word`` and
    ``last_word`` are the first and last of them (null without).  ``matches`` lists every block that meets a template:
    ``label, template`` (its number), ``first_word`` and ``n_words`` of the block, and ``containment``, in this order of the block.
    ``labels`` are those of phrases and templates, distinct, sorted, with commas; ``score`` is 1 with a phrase, else the largest
    containment, else 0.  A null or empty text has no words and no labels; null ids and repeated rows stay;
    other columns are ignored; an empty table gives an empty result.
    """
    vocabulary = [w for _, text in [*templates, *phrases] for w in _words(text)]
    join = Join(templates, phrases, threshold, frequencies(docs, text_col, vocabulary))
    match = pa.list_(
        pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for texts in text_slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(begin, len(texts))
                begin += len(texts)
                words, starts = split_words(texts)
                codes = pc.fill_null(pc.index_in(words, value_set=join.vocabulary), -1).to_numpy(zero_copy_only=False)
                count = np.zeros(len(texts), np.int64)
                least, most = np.full(len(texts), len(words)), np.full(len(texts), -1)
                base: dict[int, set[str]] = {}
                for number, at in join.phrase_places(codes, starts):
                    text = np.searchsorted(starts, at, "right") - 1
                    count += np.bincount(text, minlength=len(texts))
                    np.minimum.at(least, text, at - starts[text])
                    np.maximum.at(most, text, at - starts[text])
                    for k in np.unique(text).tolist():
                        base.setdefault(k, set()).add(join.phrase_labels[number])
                lengths = np.diff(starts)
                met: dict[int, list[dict]] = {}
                for found in join.pairs(codes, starts):
                    for k, first, t, shared in zip(*(x.tolist() for x in found), strict=True):
                        span = 2 * int(join.spans[t])
                        size = min(span, int(lengths[k]) - first)
                        row = {"label": join.labels[t], "template": t, "first_word": first, "n_words": size, "containment": shared / int(join.sizes[t])}
                        met.setdefault(k, []).append(row)
                for rows in met.values():
                    rows.sort(key=lambda r: (r["first_word"], r["template"]))
                labels = [base.get(k, set()) | {r["label"] for r in met.get(k, ())} for k in range(len(texts))]
                score = [1.0 if count[k] else max((r["containment"] for r in met.get(k, ())), default=0.0) for k in range(len(texts))]
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(lengths), pa.array(count), pa.array(least, pa.int64(), mask=none), pa.array(most, pa.int64(), mask=none),
                        pa.array([",".join(sorted(base.get(k, ()))) for k in range(len(texts))], pa.string()),
                        pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()),
                        pa.array([met.get(k, []) for k in range(len(texts))], match),
                    ],
                    names=names,
                )

    rest = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<label: string, template: int, first_word: long, n_words: long, containment: double>>"
    )
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *StructType.fromDDL(rest).fields])
    names = schema.names
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema)
