"""Periodic runs of words inside documents, by seeds on diagonals and their extension.

A run is a stretch of words in which words one period apart are equal, of at least `exponent` periods and `least` words,
that can't be extended. A pair of equal k-grams that stand q words apart is a seed on the diagonal of lag q. Periods are
searched in ranges: all runs whose periods lie in a range overlap their own shift by at least k words, where k is the
largest period of the range, so each holds a seed of that length. As k covers a period, the next place of a run's k-gram is
exactly one period on: pairs of neighbouring places are enough, and pairs of all places are never made. A table keeps for every lag
how far its diagonal has been covered, so that no stretch is extended twice.

Words are what stands between ASCII white space. Null and empty texts have no words and no runs. Repeated rows give repeated
results. Every document is one task's row, and what is held of it is a number a word and its distinct words. Other
columns of any name are not read. There is no shuffle.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import slices, utf8

#: A run has at least so many periods, and at least so many words.
EXPONENT = 4
LEAST = 6
_PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The text's words as numbers, and the word of each number."""
    known: dict[bytes, int] = {}
    out, at, add = array("l"), 0, known.setdefault
    while at < len(text):
        stop = at + _PIECE
        while stop < len(text) and text[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        out.extend([add(w, len(known)) for w in text[at:stop].split()])
        at = stop
    return np.frombuffer(out, np.int64) if out else np.zeros(0, np.int64), list(known)


@functools.lru_cache(maxsize=64)
def _levels(n: int, exponent: int, least: int) -> tuple[tuple[int, int], ...]:
    out, low = [], 1
    while exponent * low <= n:
        k, most = low, max(least, exponent * low) - low
        while (most_then := min(most, max(least, exponent * (k + 1)) - k - 1)) > k:
            k, most = k + 1, most_then
        out.append((low, k))
        low = k + 1
    return tuple(out)


def levels(n: int, exponent: int = EXPONENT, least: int = LEAST) -> tuple[tuple[int, int], ...]:
    """Ranges of periods, for texts of n words: the least one and the greatest, which is the seeds' length too. Every run overlaps its shift by so many words."""
    return _levels(1 << max(4, n - 1).bit_length(), exponent, least)


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place."""
    power = np.full(len(ids) + 1, _STEP, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate(([np.uint64(0)], np.add.accumulate(mixed * np.uint64(0xBF58476D1CE4E5B9) * power[:-1])))
    n = len(ids) - k + 1
    # brought to one place by the power still missing at the end
    return (total[k:] - total[:n]) * power[: n][::-1]


def repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value stands again later, and the next such place."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    return order[:-1][same], order[1:][same]


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values the two have in common from their start; looked at in growing pieces."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        other = a[at : at + size] != b[at : at + size]
        if (k := int(other.argmax())) or other[0]:
            return at + k
        at, size = min(n, at + size), 2 * size
    return n


def runs(ids: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, period of all runs, by start and period; exponent is 2 at least, and from 3 on the ranges of periods grow by a factor."""
    found, n, total, first = [], len(ids), None, 0
    for low, k in levels(n, exponent, least):
        if n < k + low:
            break
        h = grams(ids, k)
        if total is None:
            at, again = repeats(h)
            # a longer k-gram can only stand again where all the first ones in it do
            again_too, first = np.zeros(len(h), np.int64), k
            again_too[at] = again_too[again] = 1
            total = np.concatenate(([0], np.cumsum(again_too)))
        else:
            size = k - first + 1
            own = np.flatnonzero(total[size:] - total[:-size] == size)
            at, again = (own[x] for x in repeats(h[own]))
        if not len(at):
            break
        lag = again - at
        near = np.flatnonzero((lag >= low) & (lag <= k))
        near = near[np.argsort(at[near])]
        covered: dict[int, int] = {}
        for i, q in zip(at[near].tolist(), lag[near].tolist(), strict=True):
            if i < covered.get(q, -1):
                continue
            a = i - agreeing(ids[:i][::-1], ids[q : i + q][::-1])
            b = i + agreeing(ids[i : n - q], ids[i + q :])
            covered[q] = b
            if b + q - a >= max(least, exponent * q):
                found.append((a, b + q - a, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The places that stay if every run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.flatnonzero(np.cumsum(edges[:-1]) == 0)


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length/period; of equal ones that with the smallest start, then period."""
    best = None
    for r in found:  # by start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST, alter: Callable[[object, np.ndarray], np.ndarray] | None = None, outputs: bool = True) -> DataFrame:
    """id, n_runs, start, length, period, exponent_milli (of the strongest run), runs_sha256, collapsed_sha256, and with outputs also runs (array of structs) and collapsed (text).

    alter(id, words as numbers) may exchange a document's words before the search.
    """
    inner = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, listed, texts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, names = numbered(t)
                if alter:
                    ids = alter(i, ids)
                found = runs(ids, exponent, least)
                digest, out = hashlib.sha256(), []
                own = ids[kept(len(ids), found)] if found else ids
                for a in range(0, len(own), 1 << 16):
                    piece = (b" " if a else b"") + b" ".join([names[w] for w in own[a : a + (1 << 16)].tolist()])
                    digest.update(piece)
                    if outputs:
                        out.append(piece)
                best = strongest(found)
                said = "".join(f"{a},{n},{q}\n" for a, n, q in found)
                rows.append((len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said.encode()).hexdigest(), digest.hexdigest()))
                if outputs:
                    listed.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    texts.append(b"".join(out).decode("utf-8", "replace"))
            columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
            if outputs:
                columns += [pa.array(listed, run_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names_of)

    schema = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string" + ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" * outputs
    names_of = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *outputs * ["runs", "collapsed"]]
    return inner.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
