"""Benchmark decontamination: matching statistics of every document against an automaton of the test items.

A window is 13 consecutive words of an item, or a whole shorter item. Where the longest match that ends at a
word has 13 words or more, the windows that end there occur; where it has a shorter item as its end, that
item's window does. All words inside an occurrence are hit.

Items are broadcast in blocks of at most BLOCK_WORDS words, each block an automaton of bounded size. A pass over the
documents takes PASS_BLOCKS blocks at most; a larger benchmark takes more passes, each adding to what the one before
has written, so no worker ever holds more than one pass's automata.

Null and empty documents have no words, no hits and are not contaminated; items without words have no window.
Items that share an id count as one, and each one's windows as its own; repeated documents give repeated rows. An item's null id counts as the text "null".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import slices, unused, utf8, written
from docsleuth.llm.suffix_automaton import SuffixAutomaton, runs, words

WINDOW = 13
BLOCK_WORDS = 50_000
PASS_BLOCKS = 4
#: A document is contaminated if this share of its words, in percent, is hit.
COVERAGE_PERCENT = 5


class Matcher:
    """One block of items: the automaton, where items of a window's length stand in it, and where shorter ones end."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        split = [(name, w) for name, text in items if (w := words(text))]
        self.window = window
        self.names = [name for name, _ in split]
        self.auto = SuffixAutomaton([w for _, w in split])
        self.full = self.auto.occurrences(window)
        short: dict[int, dict[int, set[int]]] = {}  # state, length, items
        for k, (_, w) in enumerate(split):
            if len(w) < window:
                short.setdefault(self.auto.ends[k], {}).setdefault(len(w), set()).add(k)
        #: for each state the short items that end a match there, longest first: its own and those of all suffixes
        self.short: dict[int, tuple[tuple[int, frozenset[int]], ...]] = {}
        for s in self.auto.by_length():
            above = self.short.get(self.auto.link[s], ())
            here = tuple(sorted(((n, frozenset(ks)) for n, ks in short.get(s, {}).items()), reverse=True))
            if here or above:
                self.short[s] = here + above
        self.least = min((min(window, len(w)) for _, w in split), default=window)
        self.auto.own = []  # built upon, not needed any more

    def spans(self, text: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """A mark for each word that is hit, and the items with an occurring window."""
        marks, found = np.zeros(len(text) + 1, np.int64), set()
        link, length = self.auto.link, self.auto.length
        for start, end in runs(ids := self.auto.known(text), self.least):
            for at, (state, size) in enumerate(self.auto.walk(ids[start:end].tolist()), start + 1):
                if size >= self.window:
                    marks[at - size] += 1
                    marks[at] -= 1
                    while length[link[state]] >= self.window:
                        state = link[state]
                    found |= self.full[state]
                for n, ks in self.short.get(state, ()):
                    if n <= size:
                        marks[at - n] += 1
                        marks[at] -= 1
                        found |= ks
        return np.cumsum(marks[:-1]) > 0, found


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, streamed through the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), utf8(text_col).alias("t")).toLocalIterator():
        n = len(words(bytes(row.t)))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.i, bytes(row.t)))
        size += n
    yield block


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, n_words, n_hit, items (array of item ids as text, sorted), spans (array of hit word spans, start and end): one row per input row."""
    state = df.select(F.col(id_col).alias("__id"), utf8(text_col).alias("__text"))
    group: list[list[tuple[str, bytes]]] = []
    for block in blocks(benchmark, item_col, item_text_col, block_words):
        if len(group) == PASS_BLOCKS:
            shared = _broadcast(state, group, window)
            state = written(_pass(state, shared, True))
            for b in shared:
                b.destroy()
            group = []
        group.append(block)
    return _pass(state, _broadcast(state, group, window), False).withColumnRenamed("__id", id_col)


def _broadcast(state: DataFrame, group: list[list[tuple[str, bytes]]], window: int) -> list:
    """A matcher for each block, of block_words at most."""
    return [state.sparkSession.sparkContext.broadcast(Matcher(p, window)) for p in group]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(state: DataFrame, shared: list, more: bool) -> DataFrame:
    """One pass over the documents; spans and items of an earlier pass, if there was one, are added to. The texts go on if more follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.value for b in shared]
        for batch in slices(batches):
            before = list(zip(*(batch.column(k).to_pylist() for k in (4, 5)), strict=True)) if batch.num_columns > 2 else [([], [])] * batch.num_rows
            n, hit, items, spans = [], [], [], []
            for t, (old_items, old_spans) in zip(batch.column(1).to_pylist(), before, strict=True):
                text, names = words(t), list(old_items)
                marks = np.zeros(len(text), bool)
                for x in old_spans:
                    marks[x["start"] : x["end"]] = True
                for m in own:
                    here, found = m.spans(text)
                    marks |= here
                    names += [m.names[k] for k in found]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
                n.append(len(text))
                hit.append(int(marks.sum()))
                items.append(sorted(set(names)))
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + more], pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)], names=["__id", *more * ["__text"], "n_words", "n_hit", "items", "spans"])

    schema = f"__id {state.schema['__id'].dataType.simpleString()}, {'__text binary, ' * more}n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"
    return state.mapInArrow(run, schema)


def contaminated(found: DataFrame, percent: int = COVERAGE_PERCENT):
    """Whether enough of a document's words are hit."""
    return (found["n_hit"] > 0) & (100 * found["n_hit"] >= percent * found["n_words"])


def without_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = WINDOW, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """df with the hit spans of at least so many words cut out of its texts, for corpora that keep the rest of such documents.

    Larger benchmarks take more passes, as in matches(); each adds the spans it finds, and the last one's cut is made from all of them.
    """
    own = unused(df, "spans")
    state = df.withColumn(own, F.array().cast("array<struct<start: bigint, end: bigint>>"))
    group: list[list[tuple[str, bytes]]] = []
    for block in blocks(benchmark, item_col, item_text_col, block_words):
        if len(group) == PASS_BLOCKS:
            shared = _broadcast(state, group, window)
            state = written(_spanned(state, shared, text_col, own))
            for b in shared:
                b.destroy()
            group = []
        group.append(block)
    state = _spanned(state, _broadcast(state, group, window), text_col, own)
    at, spans_at = state.columns.index(text_col), state.columns.index(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else cut(t, [(x["start"], x["end"]) for x in s], least) for t, s in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True)]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return state.mapInArrow(run, state.schema).drop(own)


def _spanned(state: DataFrame, shared: list, text_col: str, own: str) -> DataFrame:
    """state, whose spans have those of one more group of blocks."""
    at, spans_at = state.columns.index(text_col), state.columns.index(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [b.value for b in shared]
        for batch in slices(batches):
            out = []
            for t, old in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                tokens = words((t or "").encode())
                marks = np.zeros(len(tokens), bool)
                for x in old:
                    marks[x["start"] : x["end"]] = True
                for m in matchers:
                    marks |= m.spans(tokens)[0]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))).tolist()
                out.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            yield batch.set_column(spans_at, own, pa.array(out, _SPANS))

    return state.mapInArrow(run, state.schema)


def cut(text: str, spans: list[tuple[int, int]], least: int) -> str:
    """The text without its spans (of word numbers, the end after the last) of at least so many words."""
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    out, last = [], 0
    for a, b in spans:
        if b - a >= least:
            out.append(raw[last : places[a][0]])
            last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def digests(found: DataFrame) -> DataFrame:
    """matches() as the figures that are compared: item lists as a hash."""
    return found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": contaminated(found)})
