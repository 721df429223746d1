"""Substring deduplication by content-defined chunks.

A gear rolling hash over a text's characters other than white space cuts it into chunks at word ends, so an insertion moves
only the cuts beside it. A chunk and those after it, until LEAST_WORDS words are full, have one digest; the next such group
starts with the next chunk. A group is repeated if a document with a smaller id has it too. Groups that follow each other
both here and in the first document that has them make one run; a run's two ends are extended word by word against that
document. Runs of at least MIN_WORDS words are cut out, so every word that goes lies in a run that stands word for word
in one earlier document. White space doesn't count; in scripts without spaces a character is a word's half.

The first document, by id, keeps a passage. Repeats inside one document are its own matter and stay. Documents
with a null id neither lose nor claim passages. Null texts stay null, empty ones empty; repeated rows get the
same result. Digests have 64 bits. Columns of any other name are carried along, internal names give way to them.

Shuffles carry digests and ids: one to find the digests that several documents have (combined before the shuffle, so
a group in every document is one row a task), one to mark them. Texts are shuffled twice: to look up the words around
the ends of runs, and to meet the marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsleuth.llm.common import slices, unused, utf8, written

#: One word end in so many ends a chunk; no chunk is longer than MOST_WORDS, which only matters where hardly a hash differs.
WORDS_PER_CHUNK = 5
MOST_WORDS = 64
#: Chunks have a digest together with those after them until so many words are full.
LEAST_WORDS = 8
#: The shortest run that is cut: passages of over 50 words, less the words at their ends that touch other text.
MIN_WORDS = 48
#: How far a run's ends are extended; a passage begins further away from its first chunk once in ten thousand times.
REACH = 48
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: For hashes of words: a value of each byte, an odd factor of each place.
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)
_PLACES = np.array([xxhash.xxh64_intdigest(b"%d" % i, 13) | 1 for i in range(1024)], np.uint64)
#: The first two UTF-8 bytes of characters in scripts without spaces: Thai to Myanmar, Khmer, Han and kana to Yi, full width.
_WIDE = np.zeros(65536, bool)
for _a, _b in ((0xE0B8, 0xE0BF), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE2BA, 0xE9BF), (0xEA80, 0xEA93), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBE), (0xF0A0, 0xF0BF)):
    _WIDE[_a : _b + 1] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit its first byte, a hash without white space, and twice the words it counts for.

    A unit is a word between ASCII white space; a character of a script without spaces is one too, and counts half a word.
    """
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    wide = None
    if len(raw) > 2 and raw.max() >= 0xE0:
        wide = np.zeros(len(raw), bool)
        wide[:-1] = _WIDE[raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]]
        if wide.any():
            at = np.flatnonzero(wide)
            after = at + np.where(raw[at] >= 0xF0, 4, 3)
            after = after[after < len(raw)]
            begins[at] = True
            begins[after[~space[after]]] = True
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    a = starts[0]
    offset = np.arange(a, len(raw)) - starts[np.cumsum(begins[a:]) - 1]
    values = _BYTES[raw[a:]] * _PLACES[offset & 1023]
    values[space[a:]] = 0
    weight = np.full(len(starts), 2) if wide is None else np.where(wide[starts], 1, 2)
    return starts, _mixed(np.add.reduceat(values, starts - a)), weight


def boundaries(text: bytes, starts: np.ndarray, words_per_chunk: int = WORDS_PER_CHUNK, most: int = MOST_WORDS) -> np.ndarray:
    """Numbers of the units that begin a chunk, from 0, and the number of units: cuts of a gear hash over 16 bytes that aren't white space."""
    raw = np.frombuffer(text, np.uint8)
    own = np.flatnonzero(~_SPACE[raw])
    h = _GEAR[raw[own]]
    for step in (1, 2, 4, 8):  # doubles the window: 16 bytes of 16-bit sums
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    last = np.append(np.searchsorted(own, starts[1:]), len(own)) - 1
    at = np.concatenate(([0], np.flatnonzero(h[last] < 65536 // words_per_chunk) + 1, [len(starts)]))
    gaps = np.diff(at)
    if (gaps > most).any():
        at = np.concatenate([at, *(np.arange(at[k] + most, at[k + 1], most) for k in np.flatnonzero(gaps > most))])
    return np.unique(at)


def groups(text: bytes, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """units(), then of each group of chunks its first unit, the unit after its last one, and its digest."""
    starts, words, weight = units(text)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return starts, words, weight, none, none, none
    at = boundaries(text, starts)
    full = np.searchsorted(at, at[:-1] + least)
    a = np.flatnonzero(full < len(at))
    ends = at[full[a]]
    a = at[a]
    # a digest is a sum over the units, each mixed with its place in the group
    sizes = ends - a
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = words[np.repeat(a, sizes) + place] * _PLACES[place & 1023]
    h = _mixed(np.add.reduceat(values, np.cumsum(sizes) - sizes)) if len(a) else np.zeros(0, np.uint64)
    return starts, words, weight, a, ends, h.view(np.int64)


def first_of_each(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands first, in order, and whether it stands again."""
    _, at, n = np.unique(h, return_index=True, return_counts=True)
    order = np.argsort(at)
    return at[order], n[order] > 1


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """digest, id, k, again: a row for each digest of a document with an id; k: the number of the group where it stands first; again: whether it stands more than once."""
    inner = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, ordinals, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
            for t in batch.column(1).to_pylist():
                own = groups(t, least)[5]
                at, again = first_of_each(own)
                more.append(again)
                found.append(own[at])
                ordinals.append(at.astype(np.int32))
            sizes = [len(x) for x in found[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.concatenate(ordinals)), pa.array(np.concatenate(more))], names=["digest", "id", "k", "again"])

    return inner.mapInArrow(run, f"digest bigint, id {inner.schema['id'].dataType.simpleString()}, k int, again boolean")


def duplicates(parts: DataFrame) -> DataFrame:
    """id, marks: for each document that has any, its digests that a document with a smaller id has too: k, digest, the first such document, the number there, and again."""
    first = parts.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("k", "id").alias("at")).where("first < last").select("digest", "first", "at")
    return parts.join(first, "digest").where(F.col("id") > F.col("first")).groupBy("id").agg(F.collect_list(F.struct("k", "digest", "first", "at", "again")).alias("marks"))


def borders(marks: DataFrame) -> DataFrame:
    """id, digest, first: the marks that don't continue to a side by one of the same first document that follows there too, and those that stand again elsewhere."""
    kind = marks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, found, firsts = [], [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                by_k = {m["k"]: (m["first"], m["at"]) for m in own}
                asked = {(m["digest"], m["first"]) for m in own for d in (-1, 1) if m["again"] or by_k.get(m["k"] + d) != (m["first"], m["at"] + d)}
                for d, f in sorted(asked):
                    at.append(i)
                    found.append(d)
                    firsts.append(f)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64()), pa.array(firsts, batch.schema.field(0).type)], names=["id", "digest", "first"])

    return marks.mapInArrow(run, f"id {kind}, digest bigint, first {kind}")


def contexts(df: DataFrame, asked: DataFrame, id_col: str, text_col: str, least: int, reach: int = REACH) -> DataFrame:
    """digest, before, after: of each group asked for the words around it in its first document, as 32 bits each, nearest first."""
    wanted = asked.groupBy("first").agg(F.collect_set("digest").alias("digests"))
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("first"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for t, digests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, words, _, begins, ends, own = groups(t, least)
                low, wanted_here = words.astype(np.uint32).view(np.int32), set(digests)
                for k in first_of_each(own)[0].tolist():
                    if (d := int(own[k])) in wanted_here:
                        out[0].append(d)
                        out[1].append(low[max(0, begins[k] - reach) : begins[k]][::-1].tolist())
                        out[2].append(low[ends[k] : ends[k] + reach].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in out[1:])], names=["digest", "before", "after"])

    found = texts.join(wanted, "first").select("text", "digests").mapInArrow(run, "digest bigint, before array<int>, after array<int>")
    return found.groupBy("digest").agg(F.min(F.struct("before", "after")).alias("c")).select("digest", "c.*")  # an id may have several rows


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values the two have in common from their start."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def repeated(begins: np.ndarray, ends: np.ndarray, own: np.ndarray, low: np.ndarray, marks: dict[int, tuple], around: dict[int, tuple[list[int], list[int]]], reach: int = REACH) -> tuple[list[tuple[int, int]], int]:
    """Runs of units that one earlier document has word for word, and the number of marked groups."""
    runs, n_marked = [], 0
    chain: list[int] = []  # the numbers of the groups of a run

    def close() -> None:
        if chain:
            a, b = int(begins[chain[0]]), int(ends[chain[-1]])
            if (c := around.get(int(own[chain[0]]))) is not None:
                a -= agreeing(low[max(0, a - reach) : a][::-1], np.array(c[0], np.int32))
            if (c := around.get(int(own[chain[-1]]))) is not None:
                b += agreeing(low[b : b + reach], np.array(c[1], np.int32))
            runs.append((a, b))
            chain.clear()

    before = None
    for k, d in enumerate(own.tolist()):
        mark = marks.get(d)
        if mark is None or before is None or mark != (before[0], before[1] + 1):
            close()
        if mark is not None:
            n_marked += 1
            chain.append(k)
        before = mark
    close()
    return runs, n_marked


def cut(text: bytes, marks: dict[int, tuple], around: dict[int, tuple[list[int], list[int]]], min_words: int = MIN_WORDS, least: int = LEAST_WORDS) -> tuple[bytes, int, int, int]:
    """The text without its long repeated runs; numbers of groups, of repeated ones, of words removed."""
    if not text:
        return text, 0, 0, 0
    starts, words, weight, begins, ends, own = groups(text, least)
    runs, n_marked = repeated(begins, ends, own, words.astype(np.uint32).view(np.int32), marks, around) if marks else ([], 0)
    total = np.concatenate(([0], np.cumsum(weight)))
    kept, last, removed, done = [], 0, 0, 0
    for a, b in sorted(runs):
        if total[b] - total[a] >= 2 * min_words and b > done:
            a = max(a, done)  # runs of several sources may overlap
            kept.append(text[last : max(last, starts[a])])
            last = int(starts[b]) if b < len(starts) else len(text)
            removed += int(total[b] - total[a])
            done = b
    return b"".join([*kept, text[last:]]), len(own), n_marked, removed // 2


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """df with passages cut out of its texts, and n_chunks, n_duplicate_chunks (groups), n_removed_words: one row per input row.

    Columns of df that are called like the three new ones are replaced.
    """
    fresh = ["n_chunks", "n_duplicate_chunks", "n_removed_words"]
    df = df.drop(*(c for c in fresh if c not in (id_col, text_col)))
    marks = written(duplicates(written(chunks(df, id_col, text_col, least))))
    asked = written(borders(marks))
    around = asked.join(written(contexts(df, asked, id_col, text_col, least)), "digest").groupBy("id").agg(F.collect_list(F.struct("digest", "before", "after")).alias("around"))
    found = marks.join(around, "id", "left").select(F.col("id").alias(own_id := unused(df, "id")), F.col("marks").alias(unused(df, "marks")), F.col("around").alias(unused(df, "around")))
    joined = df.join(found, df[id_col] == found[own_id], "left").drop(own_id)
    at, last = df.columns.index(text_col), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n, dup, gone = [], [], [], []
            for t, m, c in zip(*(batch.column(i).to_pylist() for i in (at, last, last + 1)), strict=True):
                out, x, y, z = cut((t or "").encode(), {r["digest"]: (r["first"], r["at"]) for r in m or ()}, {r["digest"]: (r["before"], r["after"]) for r in c or ()}, min_words, least)
                texts.append(None if t is None else out.decode())
                n.append(x)
                dup.append(y)
                gone.append(z)
            columns = list(batch.columns[:last])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n, dup, gone))], names=[*batch.schema.names[:last], *fresh])

    return joined.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in fresh)]))
