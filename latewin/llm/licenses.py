"""License texts by an exact set-similarity join of text blocks with templates.

A block is a run of as many consecutive words as a template has (the whole text where it has
fewer). A block matches if it holds at least ``threshold`` of the template's distinct words.
All blocks are considered, one at every word; most are never looked at:

* **Order.** Words of templates are counted over all texts and ordered from rare to frequent.
  The order is the same for every text and template.
* **Prefix filter.** Of a template's m words a match needs c; so it holds one of the m - c + 1
  rarest. Only blocks around such a word are candidates.
* **Length filter.** Candidates that overlap form one region; it needs c words and c distinct
  words of the template.
* **Positional filter.** The template's words are looked up in that order, from the rarest; at
  each place those found plus those still to come must reach c.
* Regions that are left are verified block by block with a sliding count.

Phrases are templates whose words must stand consecutively: the place of the rarest word gives
the only start possible, which is then compared.

Templates are given by the caller and travel with the function; their number of words is
checked against ``MOST_TEMPLATE_WORDS``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewin.llm.byte_words import STRETCH, stretches, words_of
from latewin.llm.tables import text_of

THRESHOLD = 0.8
MOST_TEMPLATE_WORDS = 200_000

# The phrases of the base and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices and opening passages of public licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
     " software and associated documentation files (the \"Software\"), to deal in the Software"
     " without restriction, including without limitation the rights to use, copy, modify, merge,"
     " publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a"
     " copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms"
     " of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms"
     " of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms"
     " of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are"
     " permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
     " without fee is hereby granted, provided that the above copyright notice and this permission"
     " notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
     " If a copy of the MPL was not distributed with this file, You can obtain one at"
     " http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is"
     " free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event"
     " will the authors be held liable for any damages arising from the use of this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0"
     " International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
     " International License"),
)


@dataclass
class Template:
    """One side of the join; ``order`` holds its distinct words from rare to frequent."""

    label: str
    words: list[bytes]
    least: int
    phrase: bool = False
    order: list[bytes] = field(default_factory=list)

    def prefix(self) -> list[bytes]:
        return self.order[: len(self.order) - self.least + 1]


def make_templates(
    texts: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
) -> list[Template]:
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold} is not above 0 and at most 1")
    made = []
    for label, text in texts:
        words = words_of(text.encode())
        made.append(Template(label, words, ceil(round(threshold * len(set(words)), 9))))
    for label, text in phrases:
        words = words_of(text.encode())
        made.append(Template(label, words, len(set(words)), phrase=True))
    if any(not t.words for t in made):
        raise ValueError("a template without words matches nothing")
    if sum(len(t.words) for t in made) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"more than {MOST_TEMPLATE_WORDS} words in templates")
    return made


def word_counts(docs: DataFrame, wanted: frozenset[bytes]) -> DataFrame:
    """(word, n) of the wanted words over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in stretches(text):
                    seen.update(filter(wanted.__contains__, words))
        arrays = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["word", "n"])

    texts = docs.select(text_of().cast("binary").alias("text"))
    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def order_templates(docs: DataFrame, templates: list[Template]) -> list[Template]:
    """The templates with their words in the corpus's order; at most their words are gathered."""
    wanted = frozenset(w for t in templates for w in t.words)
    counts = {bytes(r.word): r.n for r in word_counts(docs, wanted).collect()}
    return [
        Template(
            t.label, t.words, t.least, t.phrase,
            sorted(set(t.words), key=lambda w: (counts.get(w, 0), w)),
        )
        for t in templates
    ]


class Join:
    """Finds the blocks of a text that match ordered templates."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.longest = max((len(t.words) for t in templates), default=1)
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for k, t in enumerate(templates):
            for word in t.order[:1] if t.phrase else t.prefix():
                self.by_word[word].append(k)
        self.offset = [t.words.index(t.order[0]) for t in templates]
        self.sets = [frozenset(t.words) for t in templates]

    def text(self, data: bytes, size: int = STRETCH) -> tuple[int, list[tuple], list[tuple]]:
        """(words, phrase places, matching blocks) of a whole text.

        Stretches overlap by the longest template, and what both see is found once. Places are
        (label, start), blocks (label, start, end, containment), in words from 0, end exclusive;
        matching blocks of a template that overlap are joined and keep the best containment,
        and a block ends at its outermost matching words.
        """
        places: set[tuple] = set()
        blocks: list[list] = []
        before: list[bytes] = []
        base = 0
        for fresh in stretches(data, size):
            words = before + fresh
            self._stretch(words, base, places, blocks)
            keep = min(len(words), 2 * self.longest)
            base += len(words) - keep
            before = words[len(words) - keep :]
        return base + len(before), sorted(places, key=lambda p: (p[1], p[0])), self._joined(blocks)

    def _stretch(self, words: list[bytes], base: int, places: set, blocks: list) -> None:
        if self.by_word.keys().isdisjoint(words):
            return
        near: dict[int, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            for k in self.by_word.get(word, ()):
                near[k].append(at)
        for k, hits in near.items():
            t = self.templates[k]
            size = len(t.words)
            if t.phrase:
                for at in hits:
                    start = at - self.offset[k]
                    if start >= 0 and words[start : start + size] == t.words:
                        places.add((t.label, base + start))
                continue
            low = high = 0
            for at in [*hits, None]:
                if at is not None and at - size + 1 < high:
                    high = at + size
                    continue
                if high:
                    self._region(k, words, low, min(high, len(words)), base, blocks)
                if at is not None:
                    low, high = max(0, at - size + 1), at + size

    def _region(self, k: int, words: list[bytes], low: int, high: int, base: int, out: list):
        t, wanted = self.templates[k], self.sets[k]
        if high - low < t.least:
            return
        held, found = set(words[low:high]), 0
        for place, word in enumerate(t.order):
            found += word in held
            if found + len(t.order) - place - 1 < t.least:
                return
        size = len(t.words)
        at = [i for i in range(low, high) if words[i] in wanted]
        inside: Counter[bytes] = Counter()
        end = 0
        mine: list[list] = []
        # Blocks that begin at a word of the template; all others hold no more than one of these.
        for first in at:
            while end < len(at) and at[end] < first + size:
                inside[words[at[end]]] += 1
                end += 1
            if len(inside) >= t.least:
                start, stop = base + first, base + at[end - 1] + 1
                share = len(inside) / len(t.order)
                if mine and start < mine[-1][2]:
                    mine[-1][2:] = [stop, max(share, mine[-1][3])]
                else:
                    mine.append([k, start, stop, share])
            inside[words[first]] -= 1
            if not inside[words[first]]:
                del inside[words[first]]
        out += mine

    def _joined(self, blocks: list[list]) -> list[tuple]:
        out: list[list] = []
        for k, start, end, share in sorted(blocks):
            if out and out[-1][0] == k and start < out[-1][2]:
                out[-1][2], out[-1][3] = max(end, out[-1][2]), max(share, out[-1][3])
            else:
                out.append([k, start, end, share])
        return sorted((self.templates[k].label, a, b, share) for k, a, b, share in out)


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_BLOCKS = pa.list_(
    pa.struct(
        [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]
    )
)


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, places array<struct<label, start>> of phrases and blocks
    array<struct<label, start, end, containment>> of matching blocks, for every row.

    Null text counts as empty; texts without words match nothing. Rows are treated one by one,
    so repeated rows repeat their result. Other columns of the table are ignored.
    """
    ordered = order_templates(docs, make_templates() if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Join(ordered)
        for batch in batches:
            found = [join.text(t) for t in batch.column(1).to_pylist()]
            places = [[{"label": a, "start": s} for a, s in f[1]] for f in found]
            blocks = [
                [{"label": a, "start": s, "end": e, "containment": c} for a, s, e, c in f[2]]
                for f in found
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array(places, _PLACES),
                    pa.array(blocks, _BLOCKS),
                ],
                ["doc_id", "n_words", "places", "blocks"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().cast("binary").alias("text"))
    return texts.mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, places array<struct<label:string,start:long>>,"
        " blocks array<struct<label:string,start:long,end:long,containment:double>>",
    )


def license_labels(found: DataFrame) -> DataFrame:
    """The scan's rows with counts, first and last places, labels and score.

    ``score`` is 1 where a phrase stands, else the best containment of a matching block, else 0.
    """

    def listed(*names):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*names))), ",")

    starts = F.col("places.start")
    base, own = F.col("places.label"), F.col("blocks.label")
    any_base = F.size("places") > 0
    return found.withColumns(
        {
            "n_base": F.size("places").cast("long"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "base_labels": listed(base),
            "labels": listed(base, own),
            "score": F.when(any_base, 1.0).otherwise(
                F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0))
            ),
        }
    )
