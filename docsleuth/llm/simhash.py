"""SimHash near-duplicates: 64-bit fingerprints, links within a Hamming radius, connected groups.

Candidates: fingerprints within three bits agree in one of four 16-bit blocks, and there, of the other
48 bits, in one of four 12-bit blocks. So each distinct fingerprint goes to 16 tables with 28-bit keys,
which keeps buckets small for billions of documents, and no link is lost. A bucket with too many distinct
fingerprints is dealt out once more, by one of four 9-bit blocks of what is left: 37-bit keys.

Within buckets the comparison is bit-sliced: bit i of all fingerprints of a run lies in plane i, 64
fingerprints to a machine word; the exclusive or of a plane and the same plane moved by d rows feeds
carry-save counters, which update 64 distances at once. Words in which every distance has passed the radius
are given up.

Documents without words have fingerprint zero. Exact copies share a fingerprint, so all heavy work is on
distinct fingerprints; a group of copies of any size is one row there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import map_texts, written
from docsleuth.operators.graph import components

SEED = 42
WIDTH = 3
RADIUS = 3
#: Buckets with more distinct fingerprints are dealt out by nine more bits.
HOT = 512
#: A bucket larger than this is compared tile by tile instead of by moving planes.
TILE = 256
ROWS = 1 << 16


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Of one text in UTF-8; each bit by the majority of the shingles' hashes, repeats included."""
    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - width] + 1).tolist()]
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64, n - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), ROWS):
        ones += np.unpackbits(hashes[at : at + ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """id and bits (the fingerprint as a signed long), without a shuffle."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64), pa.int64())]

    return map_texts(df, id_col, text_col, make, "bits bigint", ["bits"])


def planes(bits: np.ndarray) -> np.ndarray:
    """64 rows of words: bit j of word w in row i is bit i of fingerprint 64 w + j; 63 or fewer zero rows are added."""
    full = np.zeros(-(-len(bits) // 64) * 64, np.uint64)
    full[: len(bits)] = bits
    flat = np.unpackbits(full.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(flat.T, axis=1, bitorder="little")).view("<u8")


def within(differ, words: np.ndarray, radius: int) -> np.ndarray:
    """Of the pairs that words marks (a bit each), those at most radius apart; differ(i, at) gives plane i's differing bits in the words numbered at.

    ones, twos and over count by carry-save addition up to 3, and beyond once and for all; every eight planes the
    words in which no pair is left are given up.
    """
    assert 0 <= radius <= 3
    at = np.flatnonzero(words)
    alive, out = words[at].copy(), np.zeros_like(words)
    ones, twos = np.zeros_like(alive), np.zeros_like(alive)
    for i in range(64):
        x = differ(i, at)
        carry = ones & x
        ones ^= x
        over = twos & carry
        twos ^= carry
        # distances stay below four, and are compared with the radius as far as they have come
        alive &= ~over
        if radius < 3:
            alive &= ~(twos & ones if radius == 2 else twos if radius == 1 else ones | twos)
        if i % 8 == 7 and len(at):
            keep = alive != 0
            if not keep.all():
                at, alive, ones, twos = at[keep], alive[keep], ones[keep], twos[keep]
        if not len(at):
            break
    out[at] = alive
    return out


def moved(plane: np.ndarray, d: int) -> np.ndarray:
    """The plane whose bit k is the given one's bit k + d, along the last axis."""
    w, b = divmod(d, 64)
    low = np.zeros_like(plane)
    low[..., : plane.shape[-1] - w] = plane[..., w:] if w else plane
    if not b:
        return low
    high = np.zeros_like(plane)
    high[..., : max(0, plane.shape[-1] - w - 1)] = plane[..., w + 1 :]
    return (low >> np.uint64(b)) | (high << np.uint64(64 - b))


def bits_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def neighbours(keys: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i < j) with equal keys and fingerprints within the radius; keys are sorted, and no key has more than TILE rows."""
    left, right = [], []
    if len(keys) > 1:
        own = planes(bits)
        d = 1
        while True:
            same = np.zeros(own.shape[1] * 64, np.uint8)
            same[: len(keys) - d] = keys[d:] == keys[:-d]
            if not same.any():
                break
            shifted = moved(own, d)
            found = bits_of(within(lambda i, at, s=shifted: own[i, at] ^ s[i, at], np.packbits(same, bitorder="little").view("<u8"), radius))
            left.append(found)
            right.append(found + d)
            d += 1
            if d >= len(keys):
                break
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows 0 to n - 1, the least row of each one's component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def large_bucket(bits: np.ndarray, radius: int) -> np.ndarray:
    """Roots of one bucket of any size: each tile's planes against every earlier fingerprint in turn, rows of the same component left out."""
    n = len(bits)
    root = np.arange(n)
    for at in range(0, n, 64 * TILE):
        tile = planes(bits[at : at + 64 * TILE])
        rows = min(64 * TILE, n - at)
        for k in range(at + rows - 1):
            base = max(0, k + 1 - at)  # only rows after k
            todo = np.zeros(tile.shape[1] * 64, np.uint8)
            todo[base:rows] = root[at + base : at + rows] != root[k]
            if not todo.any():
                continue
            mine = np.where((bits[k] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
            found = bits_of(within(lambda i, w, m=mine, t=tile: t[i, w] ^ m[i], np.packbits(todo, bitorder="little").view("<u8"), radius)) + at
            if len(found):
                met = np.unique(np.append(root[found], root[k]))
                root[np.isin(root, met)] = met[0]
    return root


def stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that join each bucket's near fingerprints into stars; rows come sorted by key, and buckets may span batches."""

    def edges(keys: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(cuts, len(keys)))
        root = np.arange(len(keys))
        small = np.repeat((sizes > 1) & (sizes <= TILE), sizes)
        at = np.flatnonzero(small)
        root[at] = at[forest(len(at), *neighbours(keys[at], bits[at], radius))]
        for cut, size in zip(cuts[sizes > TILE].tolist(), sizes[sizes > TILE].tolist(), strict=True):
            root[cut : cut + size] = cut + large_bucket(bits[cut : cut + size], radius)
        linked = np.flatnonzero(root != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(bits[linked].view(np.int64)), pa.array(bits[root[linked]].view(np.int64))], names=["a", "b"])

    keys, bits = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.append(keys, batch.column(0).to_numpy(zero_copy_only=False))
        bits = np.append(bits, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
        if whole >= ROWS:
            yield edges(keys[:whole], bits[:whole])
            keys, bits = keys[whole:], bits[whole:]
    if len(keys):
        yield edges(keys, bits)


def _blocks(value, widths: list[int], start: int = 0):
    """value's low bits, cut into blocks of these widths: (block, the other bits, its number)."""
    at, total = 0, sum(widths)
    for k, w in enumerate(widths):
        block = F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
        low = value.bitwiseAND(F.lit((1 << at) - 1).cast("long"))
        high = F.shiftleft(F.shiftrightunsigned(value, at + w), at) if at + w < total else F.lit(0).cast("long")
        yield block, low.bitwiseOR(high), start + k
        at += w


def candidate_keys(distinct: DataFrame) -> DataFrame:
    """key, bits, rest: each fingerprint in its 16 tables; key holds the table's number and 28 bits, rest the other 36 bits."""
    rows = []
    for block, rest, i in _blocks(F.col("bits"), [16] * 4):
        for inner, left, j in _blocks(rest, [12] * 4):
            key = F.shiftleft(F.lit(4 * i + j).cast("long"), 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(inner)
            rows.append(F.struct(key.alias("key"), left.alias("rest")))
    return distinct.select("bits", F.explode(F.array(*rows)).alias("k")).select("k.key", "bits", "k.rest")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b between distinct fingerprints (column bits), enough to join all that are within the radius directly or by others."""
    if not 0 <= radius <= 3:
        raise ValueError("the tables of keys are exact for a radius of 0 to 3")
    keyed = candidate_keys(distinct)
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    marked = keyed.join(hot, "key", "left")
    finer = F.array(*[F.shiftleft(F.lit(1 + j).cast("long"), 50).bitwiseXOR(F.shiftleft(F.col("key"), 9)).bitwiseOR(block) for block, _, j in _blocks(F.col("rest"), [9] * 4)])
    # a cold key's table number and bits take 32 bits; a hot one's with nine more 41, below the number of the finer table
    dealt = marked.select(F.explode(F.when(F.col("hot"), finer).otherwise(F.array("key"))).alias("key"), "bits")
    run = lambda batches: stars(batches, radius)
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """id, bits, component_id (the least id reachable, the document's own included): one row per input row.

    Rows that repeat an id and text repeat in the result; a null id takes part, but no component is named after it
    unless it has no other.
    """
    marked = written(fingerprints(df, id_col, text_col, width, seed))
    distinct = marked.groupBy("bits").agg(F.min(id_col).alias("least"))
    distinct = written(distinct)
    joined = components(links(distinct.select("bits"), radius))
    named = distinct.join(joined, distinct["bits"] == joined["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("bits", "root").join(least, "root").select("bits", "component_id")
    return marked.join(classes, "bits").select(id_col, "bits", "component_id")
