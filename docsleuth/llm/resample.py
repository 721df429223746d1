"""Importance resampling towards a target distribution of hashed word n-grams.

Every text is a bag of features: its runs of `low` to `high` consecutive words, hashed into a fixed number of buckets. The
counts of all documents and of all target texts give each bucket a gain, an array of one number a bucket. A document's
weight is the sum of the gains of its features; a Gumbel number made from its id turns the highest scores into a draw
without replacement.

The draw takes a share of the documents that have enough words. Its cutoff is found by numeric bisection: exact count jobs
over the written scores, first over the score, then over the tied ids. Rows beyond the cutoff are partitioned by range and
ranked by the counts of the ranges before them, so no task sorts them all and none reaches the driver.

Null and empty texts have no features and weight 0. Documents with a null id count in the buckets but can't be drawn: their
score and rank are null. Ids are whole numbers. Repeated rows are documents of their own with equal scores; where the draw ends among rows
of one id, some of them are drawn. An empty table gives an empty result, an empty target or corpus counts of 0. Other
columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import slices, utf8, written
from docsleuth.llm.suffix_automaton import words

BUCKETS = 10_000
SHARE_PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Thresholds that one count job tests: it narrows the range to a sixteenth.
SECTIONS = 16
#: At so many distinct features a worker's memo is emptied.
MAX_MEMO = 400_000
#: Selected rows in a partition of the ranking, about.
RANKED_ROWS = 200_000


def features(own: list[bytes], low: int, high: int) -> Iterator[bytes]:
    """All runs of low to high consecutive words, joined by one space."""
    for n in range(low, high + 1):
        yield from own if n == 1 else (b" ".join(own[i : i + n]) for i in range(len(own) - n + 1))


def bucket_counts(df: DataFrame, text_col: str, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task sends one row for each bucket at most; so many reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            found: Counter[bytes] = Counter()
            for t in batch.column(0).to_pylist():
                found.update(features(words(t), low, high))
                if len(found) > MAX_MEMO:
                    total += counted(found, buckets)
                    found.clear()
            total += counted(found, buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(utf8(text_col)).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def counted(found: Counter[bytes], buckets: int) -> np.ndarray:
    at = np.fromiter((zlib.crc32(f) % buckets for f in found), np.int64, len(found))
    return np.bincount(at, np.fromiter(found.values(), np.float64, len(found)), buckets).astype(np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the log ratio of its smoothed shares in the target and in the corpus, in thousandths, rounded down."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(map(float, corpus), map(float, target), strict=True)], np.int64)


def gumbel(doc_id: int, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gains(dict):
    """The gain of each feature met so far."""

    def __init__(self, of: np.ndarray):
        super().__init__()
        self.of = of.tolist()

    def __missing__(self, feature: bytes) -> int:
        if len(self) > MAX_MEMO:
            self.clear()
        gain = self[feature] = self.of[zlib.crc32(feature) % len(self.of)]
        return gain


def weighted(df: DataFrame, of: np.ndarray, id_col: str = "doc_id", text_col: str = "text", low: int = 1, high: int = 1, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score: one row per input row, without a shuffle."""
    inner = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Gains(of)
        for batch in slices(batches):
            ids, n, n_features, weight = batch.column(0).to_pylist(), [], [], []
            for t in batch.column(1).to_pylist():
                own = words(t)
                n.append(len(own))
                n_features.append(sum(max(0, len(own) - k + 1) for k in range(low, high + 1)))
                weight.append(sum(map(memo.__getitem__, features(own, low, high))))
            score = [None if i is None else w + gumbel(i, seed) for i, w in zip(ids, weight, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, n_features, weight, score))], names=["id", "n_words", "n_features", "weight", "score"])

    kind = inner.schema["id"].dataType.simpleString()
    return inner.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _highest(df: DataFrame, value: Column, low: int, high: int, wanted: int) -> int:
    """The greatest x for which at least so many rows have value >= x, from low (where they do) to high: repeated exact counts of rows beyond several thresholds."""
    while low < high:
        step = max(1, -(-(high - low) // SECTIONS))
        at = [low + step * k for k in range(1, SECTIONS + 1) if low + step * k <= high]
        beyond = df.agg(*(F.count_if(value >= x) for x in at)).first()
        full = [x for x, n in zip(at, beyond, strict=True) if n >= wanted]
        low, high = max(full, default=low), min((x - 1 for x, n in zip(at, beyond, strict=True) if n < wanted), default=high)
    return low


def cutoff(scores: DataFrame, wanted: int) -> tuple[int, int]:
    """score, id: the rows with a higher score, or this score and no greater id, are the wanted ones, and rows of that last id beside them."""
    ends = scores.agg(F.min("score"), F.max("score")).first()
    score = _highest(scores, F.col("score"), ends[0], ends[1], wanted)
    tied = scores.where(F.col("score") == score)
    more = wanted - scores.where(F.col("score") > score).count()
    ends = tied.agg(F.min("id"), F.max("id")).first()
    return score, -_highest(tied, -F.col("id").cast("bigint"), -ends[1], -ends[0], more)


def ranked(drawn: DataFrame, n: int, wanted: int) -> DataFrame:
    """The rows with their rank by score, downwards, and id; beyond the wanted number null. Ranges of rows are sorted apart, each counts on from those before."""
    ranges = drawn.repartitionByRange(max(1, n // RANKED_ROWS + 1), F.col("score").desc(), F.col("id")).sortWithinPartitions(F.col("score").desc(), "id")
    # the number in the partition is taken where the partition is sorted, and both are written: later jobs see the same ranges
    numbered = written(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before, start = 0, []
    for r in sorted(numbered.groupBy("_range").count().collect()):
        start.append((r["_range"], before))
        before += r["count"]
    # one row for each range
    starts = drawn.sparkSession.createDataFrame(start, "_range int, _start bigint")
    rank = F.col("_start") + F.col("_at") + 1
    return numbered.join(F.broadcast(starts), "_range").withColumn("rank", F.when(rank <= wanted, rank)).drop("_range", "_at", "_start")


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score, rank (null: not drawn): one row per input row."""
    of = gains(bucket_counts(df, text_col, low, high, buckets), bucket_counts(target, target_col, low, high, buckets))
    scores = written(weighted(df, of, id_col, text_col, low, high, seed))
    may = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    eligible = scores.where(may)
    wanted = share_percent * eligible.count() // 100
    undrawn = F.lit(None).cast("bigint")
    if not wanted:
        return scores.withColumn("rank", undrawn).withColumnRenamed("id", id_col)
    score, last = cutoff(eligible, wanted)
    inside = may & ((F.col("score") > score) | (F.col("score") == score) & (F.col("id") <= last))
    out = ranked(scores.where(inside), wanted, wanted).unionByName(scores.where(~F.coalesce(inside, F.lit(False))).withColumn("rank", undrawn))
    return out.withColumnRenamed("id", id_col)
