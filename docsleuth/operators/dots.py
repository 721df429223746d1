"""J12's inner step: pairs of vectors whose dot product reaches a threshold, block against block as matrix products in tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Vectors to a block, about, and rows of a product held at a time.
BLOCK, STRIP = 4096, 512


def _hits(left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left, rows of right and their dot product. What the matrix product leaves in question is summed value by value, in order, as scalars.dot() does."""
    found = []
    longest = np.sqrt((right * right).sum(axis=1)).max()
    for at in range(0, len(left), STRIP):
        strip = left[at : at + STRIP]
        slack = 1e-9 * (1 + np.sqrt((strip * strip).sum(axis=1)).max() * longest)
        x, y = np.nonzero(~(strip @ right.T < least - slack))  # not a number counts as large, as in Spark
        for part in range(0, len(x), 1 << 16):
            p, q = x[part : part + (1 << 16)], y[part : part + (1 << 16)]
            score = np.zeros(len(p))
            for k in range(left.shape[1]):
                score += strip[p, k] * right[q, k]
            keep = ~(score < least)
            found.append((p[keep] + at, q[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _matched(keys: list[str], least: float, same: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            sizes = [df["v"].map(len).to_numpy() for df in (left, right)]
            for size in np.intersect1d(*sizes):
                a, b = left[sizes[0] == size], right[sizes[1] == size]
                x, y, score = _hits(*(np.array(df["v"].tolist(), float).reshape(len(df), size) for df in (a, b)), least)
                p, q = a["a"].to_numpy()[x], b["b"].to_numpy()[y]
                if same:  # a block against itself has each pair twice, two blocks have it in either order
                    keep = p < q if left["i"].iloc[0] == left["j"].iloc[0] else np.ones(len(p), bool)
                    p, q, score = np.where(p < q, p, q)[keep], np.where(p < q, q, p)[keep], score[keep]
                else:
                    keep = p != q
                    p, q, score = p[keep], q[keep], score[keep]
                out.append(pd.DataFrame({**{k: [left[k].iloc[0]] * len(p) for k in keys}, "a": p, "b": q, "score": score}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*keys, "a", "b", "score"])

    return matched


def matches(left: DataFrame, right: DataFrame | None, key: str, least: float, block: int | None = None) -> DataFrame:
    """key, a, b, score: pairs of one key whose dot product reaches the threshold, but for a row with itself. Exact.

    left: key, a, v; right: key, b, v. Without right, the pairs of left with a < b. The rows of a key are dealt to blocks by a hash of their id; each two
    blocks meet in one group, so a task holds two blocks and a strip of their product, however many rows a key has.
    """
    block, same = block or BLOCK, right is None
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & F.col(key).isNotNull()
    left = left.where(whole)
    right = left.withColumnRenamed("a", "b") if same else right.where(whole)
    blocks = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    n, m = blocks(left, "n"), blocks(right, "m")
    number = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    x = left.join(n.join(m, key), key).withColumn("i", number("a", "n"))
    y = right.join(n.join(m, key), key).withColumn("j", number("b", "m"))
    x = x.withColumn("j", F.explode(F.sequence("i" if same else F.lit(0), F.col("m") - 1)))
    y = y.withColumn("i", F.explode(F.sequence(F.lit(0), "j" if same else F.col("n") - 1)))
    kind = StructType([left.schema[key], left.schema["a"], StructField("b", right.schema["b"].dataType), StructField("score", DoubleType())])
    by = lambda df, name: df.select(*[F.col(c).alias(c) for c in (key, "i", "j", name, "v")]).groupBy(key, "i", "j")
    return by(x, "a").cogroup(by(y, "b")).applyInPandas(_matched([key], least, same), kind)
