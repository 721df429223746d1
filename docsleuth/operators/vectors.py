"""J12 by an index: cells of unit vectors, searched by the nearest cells, with a measured recall and an exact mode.

Centres are fitted on a bounded sample, but every row is indexed. A row lies in the cell of its nearest centre; a query looks at the
cells whose centres are nearest to it, and what it meets there is scored exactly. How many cells that takes is measured, not guessed: a sample of queries is
searched in all cells, and the number of cells grows until the wanted share of their matches is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.operators import dots
from docsleuth.operators.identity import MATCH
from docsleuth.sources.shared import written

#: Rows that the centres are fitted on, about; queries by which the recall is measured, about.
SAMPLE_ROWS, MEASURED = 20_000, 200
#: Rows to a cell, about, and cells at most: the centres travel with every task.
CELL_ROWS, MOST_CELLS = 64, 4096


@dataclass
class Index:
    """rows: id, vector, cell; centres: one unit vector a cell."""

    rows: DataFrame
    centres: np.ndarray

    def nearest_cells(self, vector: Column, n: int | None = None) -> Column:
        """The cells, the nearest centre first: matrix products of some rows of each batch. The centres, a bounded table, travel with the function."""
        centres, n = self.centres, n or len(self.centres)

        @F.pandas_udf("array<int>")
        def nearest(batch: pd.Series) -> pd.Series:
            order = []
            for at in range(0, len(batch), dots.STRIP):  # a strip's products at a time: a batch has 10,000 rows, and there may be 4096 cells
                near = np.stack([np.asarray(v, float) for v in batch[at : at + dots.STRIP]]) @ centres.T
                order += list(near.argmax(axis=1).astype(np.int32)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32))
            return pd.Series(order)

        return nearest(vector)


def fitted(sample: np.ndarray, cells: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Spherical k-means: centres of so many cells, each the mean direction of its vectors."""
    rng = np.random.default_rng(seed)
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centres = unit[rng.choice(len(unit), min(cells, len(unit)), replace=False)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, total / np.maximum(size, 1e-12), centres)  # an empty cell keeps its centre
    return centres


def build(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cell_rows: int = CELL_ROWS) -> Index:
    """An index of every row that has a vector. The sample is chosen by a hash of the id, so it is the same each time."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    n = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    sample = np.array([r["vector"] for r in picked.select("vector").collect()], float)
    if not len(sample):
        return Index(written(rows.withColumn("cell", F.lit(0))), np.zeros((1, 1)))
    index = Index(rows, fitted(sample, max(1, min(MOST_CELLS, n // cell_rows))))
    index.rows = written(rows.withColumn("cell", F.get(index.nearest_cells(F.col("vector"), 1), 0)))
    return index


def search(index: Index, queries: DataFrame, probes: int | None = None, least: float = MATCH) -> DataFrame:
    """query, match, score: rows in the query's nearest cells whose cosine reaches the threshold. probes None: all cells, so exact.

    A query is a row for each cell it looks at. A cell's queries meet its rows as matrix products, large cells in blocks (dots.matches). queries: id, vector.
    """
    at = F.explode(index.nearest_cells(F.col("vector"), probes) if probes else F.sequence(F.lit(0), F.lit(len(index.centres) - 1)))
    asked = queries.select(at.alias("cell"), F.col("id").alias("a"), F.col("vector").alias("v"))
    rows = index.rows.select("cell", F.col("id").alias("b"), F.col("vector").alias("v"))
    return dots.matches(asked, rows, "cell", least).select(F.col("a").alias("query"), F.col("b").alias("match"), F.round("score", 4).alias("score"))


def enough_probes(index: Index, recall: float = 0.9, least: float = MATCH, measured: int = MEASURED) -> tuple[int, float]:
    """How many cells a query has to look at, and the recall measured with so many; all cells if fewer don't do.

    Some indexed rows are searched in all cells; for every match the place of its cell in the query's order says from how many cells on it is found.
    """
    cells = len(index.centres)
    n = index.rows.count()
    share = min(1.0, measured / max(1, n))
    some = index.rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("id").alias("query"), F.col("vector").alias("vq"), index.nearest_cells(F.col("vector")).alias("order"))
    asked = written(some.select("query", "vq", F.posexplode("order").alias("place", "cell")))
    hits = dots.matches(asked.select("cell", F.col("query").alias("a"), F.col("vq").alias("v")), index.rows.select("cell", F.col("id").alias("b"), F.col("vector").alias("v")), "cell", least)
    places = hits.select("cell", F.col("a").alias("query")).join(asked.select("cell", "query", "place"), ["cell", "query"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()
    found = np.zeros(cells, np.int64)
    for r in places:
        found[r["place"]] = r["n"]
    if not found.sum():
        return cells, 1.0
    reached = np.cumsum(found) / found.sum()
    probes = int(np.argmax(reached >= recall)) + 1
    return probes, float(reached[probes - 1])
