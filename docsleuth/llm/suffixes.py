"""Removal of every byte that lies in a string of `length` bytes which also begins earlier: distributed prefix doubling.

Prefix doubling ranks all positions by a short string that begins there, then by pairs of ranks at growing offsets, until a
position is unique or the threshold is reached. Only positions that can still have an equal need a rank, and most can be ruled
out before any is sent: of the grams in a string of `length` bytes the one with the least hash, the leftmost of equals, is the same wherever the string
stands, so it suffices to start at those (about one position in forty), each standing for the strings whose least gram it is. The rounds are

1. rank by the gram; a unique gram drops out with all its strings;
2. pairs of that rank and the whole context, from the first to the last of the position's strings: equal contexts are settled
   at once, all but the first go; contexts alone in their gram's class drop out, the others go on;
3. in steps of 16 offsets, pairs of the gram's rank and the bytes all strings of the step have in common (85 of 100); unique ones drop out;
4. pairs of that rank and the whole string, for every offset that is left; a string's rank is its first place, and it goes if that
   isn't its own.

Classes are counted before their shuffle, so one that a third of all rows share costs a row a task, and rows meet their class in
joins that Spark can split. Contexts and strings are told apart by 128 bits. Texts travel twice: to give the contexts
of round 3, and to meet what is cut.

Places are ordered by document id, then by byte. Texts are taken as UTF-8 bytes, null as empty; matches never cross
documents. What goes is judged on the input, and overlaps count. Documents with a null id lose and claim nothing. Rows
that share an id count as one document whose texts lie over one another: what goes from one goes, at the same bytes, from the others; repeated rows get the same result.
Other columns of any name are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import slices, utf8, written

LENGTH = 100
#: Offsets that a name of the third round covers.
STEP = 16
#: Bytes that are hashed at a time; shorter texts are joined up to that.
BLOCK = 1 << 20
#: A position is lo << 20 | d << 10 | n: its first string's place, how far the gram is from there, and its number of strings.
_BITS = 10
_TABLES = [np.array([xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)], np.uint64) for seed in (17, 19)]
_FACTOR = np.uint64(0xD1342543DE82EF95)
_OTHER = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


def gram_of(length: int) -> int:
    return max(1, length * 8 // 25)


def _grams(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place: doubled windows, joined by the binary digits of k."""
    out, size = None, 0
    part, n = _TABLES[0][raw], 1
    while True:
        if k & n:
            out = part if out is None else out[: len(part) - size] * _power(_FACTOR, n) + part[size:] if size else part
            size += n
        if 2 * n > k:
            return out[: len(raw) - k + 1]
        part = part[:-n] * _power(_FACTOR, n) + part[n:]
        n *= 2


@functools.lru_cache(maxsize=256)
def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values that follow one another."""
    n = 1
    while 2 * n <= w:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: n - w], values[w - n :]) if w > n else values


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 to the 64, and of its inverse."""
    out = []
    for base in (_OTHER, pow(_OTHER, -1, 1 << 64)):
        own = np.full(n, base, np.uint64)
        own[0] = 1
        out.append(np.multiply.accumulate(own))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_OTHER)
    return h ^ (h >> np.uint64(29))


def _positions(buffer: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, lo, d, n, gram, context of each position of the texts that lie in the buffer between starts and ends; lo counts from the text's start."""
    raw, k = np.frombuffer(buffer, np.uint8), gram_of(length)
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = _grams(raw, k)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    at = (_least(key, length - k + 1) & _LOW).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int8)
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    at[np.cumsum(inside, dtype=np.int8)[: len(at)] == 0] = -1
    lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(lo, len(at)))
    own = at[lo] >= 0
    lo, n = lo[own], n[own]
    power, inverse = _powers(2 * BLOCK)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLES[1][raw] * power[: len(raw)], out=total[1:])
    d = at[lo] - lo
    context = (total[lo + n + length - 1] - total[lo]) * inverse[lo]
    context = _mixed(context + (d.astype(np.uint64) << np.uint64(32)) * _FACTOR + n.astype(np.uint64))
    text = np.searchsorted(starts, lo, "right") - 1
    return text, lo - starts[text], d, n, _mixed(h[at[lo]]).view(np.int64), context.view(np.int64)


def positions(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """text, lo, d, n, gram, context, first: of all positions of the texts, some texts at a time; first: no position before in the text has the same gram and context."""

    def marked(text, lo, d, n, gram, context):
        order = np.lexsort((lo, context, gram, text))
        same = np.ones(len(order), bool)
        for c in (text, gram, context):
            c = c[order]
            same[1:] &= c[1:] == c[:-1]
        same[:1] = False
        first = np.empty(len(order), bool)
        first[order] = ~same
        return text, lo, d, n, gram, context, first

    def joined(some: list[int]):
        sizes = np.array([len(texts[i]) for i in some], np.int64)
        starts = np.cumsum(sizes) - sizes
        text, *rest = _positions(b"".join([texts[i] for i in some]), starts, starts + sizes, length)
        return marked(np.array(some, np.int64)[text] if len(text) else text, *rest)

    some, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > BLOCK:
            # blocks begin at the text's start, whatever lies beside it; a position's strings may be split between two, which costs a round but no match
            parts = []
            for a in range(0, len(t) - length + 1, BLOCK):
                piece = t[a : a + BLOCK + length - 1]
                text, lo, *rest = _positions(piece, np.zeros(1, np.int64), np.array([len(piece)]), length)
                parts.append((text + i, lo + a, *rest))
            yield marked(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            continue
        if size + len(t) > BLOCK:
            yield joined(some)
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield joined(some)


def sampled(docs: DataFrame, length: int) -> DataFrame:
    """g, c, id, at: gram, context and place of the positions that are the first of their kind in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, lo, d, n, gram, context, first in positions(batch.column(1).to_pylist(), length):
                at = lo << 2 * _BITS | d << _BITS | n
                yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(context[first]), batch.column(0).take(pa.array(text[first])), pa.array(at[first])], names=["g", "c", "id", "at"])

    return docs.mapInArrow(run, f"g bigint, c bigint, id {docs.schema['id'].dataType.simpleString()}, at bigint")


def contexts(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """g, id, lo, d, n, piece: of each position asked for the bytes of all its strings."""
    wanted = asked.groupBy("id").agg(F.collect_list(F.struct("g", "at")).alias("asked"))
    kind, mask = docs.schema["id"].dataType.simpleString(), (1 << _BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            listed = batch.column(2)
            g, at = listed.flatten().flatten()
            row = np.repeat(np.arange(len(texts)), np.diff(listed.offsets.to_numpy()))
            at = at.to_numpy()
            lo, d, n = at >> 2 * _BITS, at >> _BITS & mask, at & mask
            pieces = [texts[i][a : a + size] for i, a, size in zip(row.tolist(), lo.tolist(), (n + length - 1).tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays([g, batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (lo, d, n)), pa.array(pieces, pa.binary())], names=["g", "id", "lo", "d", "n", "piece"])
            whole = np.array([len(p) for p in pieces], np.int64) == n + length - 1  # another row of the id may have a shorter text
            yield out if whole.all() else out.filter(pa.array(whole))

    return docs.join(wanted, "id").select("id", "text", "asked").mapInArrow(run, f"g bigint, id {kind}, lo bigint, d bigint, n bigint, piece binary")


def earlier(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, lo, n: places from which n strings, one byte on from each other, stand earlier too; all of them, but for those that a text repeats as whole contexts in itself."""
    found = sampled(docs, length)
    # 1: the gram
    shared = found.groupBy("g").agg(F.count("*").alias("many"), F.min("c").alias("least"), F.max("c").alias("most")).where("many > 1").selectExpr("g", "least <> most AS several")
    found = written(found.join(shared, "g"))
    # 2: the gram and its context
    firsts = written(found.groupBy("g", "c").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("many"), F.first("several").alias("several")).where("many > 1 OR several"))
    again = found.join(firsts.where("many > 1").select("g", "c", "first"), ["g", "c"]).where(F.struct("id", "at") > F.col("first")).select("id", F.shiftright("at", 2 * _BITS).alias("lo"), F.col("at").bitwiseAND((1 << _BITS) - 1).alias("n"))
    # 3: the gram and what the strings of a step of offsets have in common
    known = written(contexts(docs, firsts.where("several").select("g", "first.*"), length))
    steps = known.withColumn("j", F.explode(F.sequence(F.expr(f"(d - n + 1) div {STEP}"), F.expr(f"d div {STEP}"))))
    steps = steps.selectExpr("*", f"least(d, {STEP} * j + {STEP - 1}) AS far", f"greatest(d - n + 1, {STEP} * j) AS near")
    steps = steps.selectExpr(f"xxhash64(g, j, substring(piece, int(d - {STEP} * j + 1), {length - STEP + 1})) AS name", "id", "lo + d - far AS lo", "far - near + 1 AS n", f"substring(piece, int(d - far + 1), int(far - near + {length})) AS piece")
    names = steps.groupBy("name").agg(F.count("*").alias("many")).where("many > 1").select("name")
    steps = written(steps.join(names, "name", "left_semi"))
    # 4: that and the whole string
    strings = steps.withColumn("t", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).selectExpr("name", f"xxhash64(substring(piece, t + 1, {length})) AS string", "id", "lo + t AS lo")
    ranks = strings.groupBy("name", "string").agg(F.min(F.struct("id", "lo")).alias("first"), F.count("*").alias("many")).where("many > 1").select("name", "string", "first")
    more = strings.join(ranks, ["name", "string"]).where(F.struct("id", "lo") > F.col("first"))
    return again.unionByName(more.select("id", "lo", F.lit(1).cast("bigint").alias("n")))


def removed(n_bytes: int, lo: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """The maximal stretches that so many strings from each place cover, as rows of start and end."""
    edges = np.zeros(n_bytes + 1, np.int32)
    own = lo < n_bytes
    np.add.at(edges, lo[own], 1)
    np.subtract.at(edges, np.minimum(lo + n + length - 1, n_bytes)[own], 1)
    covered = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
    return np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (start and end of each), kept (the bytes that stay): one row per input row."""
    if not 25 <= length <= 1000:
        raise ValueError("length must lie between 25 and 1000")
    docs = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    own = docs.where(F.col("id").isNotNull())
    kind, mask = docs.schema["id"].dataType.simpleString(), (1 << _BITS) - 1
    found = earlier(own, length).groupBy("id").agg(F.collect_list(F.shiftleft("lo", _BITS).bitwiseOR(F.col("n"))).alias("found"))
    joined = docs.join(found, "id", "left").select("id", "text", "found")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            inner: dict[int, list[np.ndarray]] = {}
            for text, lo, _, n, _, _, first in positions(texts, length):
                again = np.flatnonzero(~first)
                for i, at in zip(text[again].tolist(), (lo << _BITS | n)[again].tolist(), strict=True):
                    inner.setdefault(i, []).append(at)
            rows, listed, kept = [], [], []
            for i, t in enumerate(texts):
                if not ids[i].is_valid:
                    spans = np.zeros((0, 2), np.int64)
                else:
                    at = batch.column(2)[i].values
                    at = np.concatenate([np.array(inner.get(i, ()), np.int64), at.to_numpy() if at is not None else np.zeros(0, np.int64)])
                    spans = removed(len(t), at >> _BITS, at & mask, length) if len(at) else np.zeros((0, 2), np.int64)
                rows.append((len(t), int((spans[:, 1] - spans[:, 0]).sum()), len(spans)))
                listed.append([{"start": a, "end": b} for a, b in spans.tolist()])
                edges = [0, *spans.ravel().tolist(), len(t)]
                kept.append(b"".join([t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if len(spans) else t)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(listed, span_type), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
