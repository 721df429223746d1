"""License scans: matching statistics of every text against an automaton of licence wording, chained to template spans.

All maximal matches of at least MIN_MATCH words are anchors; anchors of one template in the same order and
with small gaps form a chain. A chain that covers enough of its template's words yields the template's label
and a span. Beside that, short phrases yield their labels wherever they stand word for word.

Null and empty texts have no words, places or labels, and score 0. Matches are found in one pass; a chain only
looks back MAX_GAP words, so long texts that repeat a notice cost no more than their length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import slices, utf8
from docsleuth.llm.suffix_automaton import SuffixAutomaton, runs, words

# Phrases with their labels, and the public wording of licence notices.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]
MIN_MATCH = 4
MAX_GAP = 6
COVERAGE = 0.8


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, coverage: float = COVERAGE):
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        split = [words(t.encode()) for t in [*phrases, *(t for _, t in templates)]]
        self.sizes = [len(s) for s in split]
        self.n_phrases, self.min_match, self.max_gap, self.coverage = len(phrases), min_match, max_gap, coverage
        self.auto = SuffixAutomaton(split)
        self.least = min([min_match, *self.sizes[: self.n_phrases]])
        #: for each state, where in which sequence its words end
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.auto.length]
        for k, seq in enumerate(split):
            state = 0
            for at, w in enumerate(seq, 1):
                state = self.auto.next[state][self.auto.ids[w]]
                self.places[state].add((k, at))
        order = self.auto.by_length()
        for s in reversed(order[1:]):
            self.places[self.auto.link[s]] |= self.places[s]
        #: for each state, the phrases that end a match there
        self.phrase_ends: dict[int, tuple[tuple[int, int], ...]] = {}
        for s in order:
            if ends := tuple((k, self.sizes[k]) for k, at in sorted(self.places[s]) if k < self.n_phrases and at == self.sizes[k] and self.sizes[k] <= self.auto.length[s]):
                self.phrase_ends[s] = ends
            elif (up := self.phrase_ends.get(self.auto.link[s])) is not None:
                self.phrase_ends[s] = up

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Phrase places (start, end, label) and template spans (start, end, label, coverage)."""
        phrases, anchors = [], defaultdict(list)
        for start, end in runs(ids := self.auto.known(text), self.least):
            before = (0, 0)
            for at, (state, size) in enumerate([*self.auto.walk(ids[start:end].tolist()), (0, 0)], start + 1):
                if before[1] >= self.min_match and size != before[1] + 1:  # a maximal match ended at the word before
                    for k, stop in self.places[before[0]]:
                        if k >= self.n_phrases:
                            anchors[k].append((at - 1 - before[1], at - 1, stop - before[1], stop))
                for k, n in self.phrase_ends.get(state, ()):
                    if n <= size:
                        phrases.append((at - n, at, self.labels[k]))
                before = (state, size)
        spans = []
        for k, found in anchors.items():
            spans += self.chain(k, sorted(found))
        return phrases, sorted(spans)

    def chain(self, k: int, anchors: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, str, float]]:
        """The best chain that ends in each anchor, by covered words; the chains that cover enough and aren't part of a better one."""
        best: list[tuple[int, int]] = []  # covered words, start in the text
        first = 0
        for i, (a, b, c, d) in enumerate(anchors):
            own = (b - a, a)
            while anchors[first][1] + self.max_gap + self.sizes[k] < a:
                first += 1
            for j in range(first, i):
                _, b2, _, d2 = anchors[j]
                if d2 < d and b2 < b and a - b2 <= self.max_gap and c - d2 <= self.max_gap:
                    lap = max(0, b2 - a, d2 - c)
                    if lap < b - a:
                        own = max(own, (best[j][0] + b - a - lap, best[j][1]))
            best.append(own)
        spans: list[list] = []
        for (covered, start), (_, end, _, _) in zip(best, anchors, strict=True):
            share = min(1.0, covered / self.sizes[k])
            if share >= self.coverage:
                if spans and spans[-1][1] > start:
                    if share >= spans[-1][3]:
                        spans[-1] = [start, end, self.labels[k], share]
                else:
                    spans.append([start, end, self.labels[k], share])
        return (tuple(s) for s in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """id, n_words, phrases and spans (arrays of start, end, label, and for spans coverage): one row per input row, without a shuffle."""
    inner = df.select(F.col(id_col).alias("__id"), utf8(text_col).alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))  # the size of the wording, not of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        place = [("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]
        for batch in slices(batches):
            n, found, spans = [], [], []
            for t in batch.column(1).to_pylist():
                text = words(t)
                a, b = scanner.scan(text)
                n.append(len(text))
                found.append([{"start": x, "end": y, "label": z} for x, y, z in a])
                spans.append([{"start": x, "end": y, "label": z, "coverage": c} for x, y, z, c in b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.struct(place))), pa.array(spans, pa.list_(pa.struct([*place, ("coverage", pa.float64())])))], names=["__id", "n_words", "phrases", "spans"])

    schema = f"__id {inner.schema['__id'].dataType.simpleString()}, n_words bigint, phrases array<struct<start: bigint, end: bigint, label: string>>, spans array<struct<start: bigint, end: bigint, label: string, coverage: double>>"
    return inner.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def digests(found: DataFrame) -> DataFrame:
    """scan() as one line of figures a document; the score is 1 where a phrase stands, else the best coverage."""
    labels = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    starts = F.transform("phrases", lambda x: x["start"])
    return found.withColumns(
        {
            "n_base": F.size("phrases").cast("long"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "base_labels": joined(labels("phrases")),
            "labels": joined(F.array_union(labels("phrases"), labels("spans"))),
            "score": F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))),
        }
    )
