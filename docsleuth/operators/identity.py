"""Identity cross-checks, embedding similarity and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.functions import scalars as X
from docsleuth.operators import dots

MATCH = 0.40


def name_check(a: Column, b: Column) -> Column:
    """Whether first and last names agree; null if either is missing."""
    p, q = X.name_parts(a), X.name_parts(b)
    known = p["first"].isNotNull() & q["first"].isNotNull()
    return F.when(known, (p["first"] == q["first"]) & (p["last"] == q["last"]))


def dob_check(a: Column, b: Column) -> Column:
    """Mode (exact, year_only, missing, unparsed) and passed."""
    p, q = X.dob(a), X.dob(b)
    missing = (p["raw"] == "") | (q["raw"] == "")
    exact = p["full"].isNotNull() & q["full"].isNotNull()
    year = p["year"].isNotNull() & q["year"].isNotNull()
    mode = F.when(missing, "missing").when(exact, "exact").when(year, "year_only").otherwise("unparsed")
    return F.struct(mode.alias("mode"), F.when(missing, None).when(exact, p["full"] == q["full"]).when(year, p["year"] == q["year"]).alias("passed"))


def face_match(a: Column, b: Column) -> Column:
    """J12 for one pair of unit vectors."""
    s = X.dot(a, b)
    return F.struct(s.alias("score"), (s >= MATCH).alias("matched"), X.display_similarity(s).alias("display"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("confidence"))


def embedding_links(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", block: str = "label", least: float = MATCH) -> DataFrame:
    """J12 within blocks: pairs of a block whose cosine reaches the threshold, each once.

    All pairs of a block are compared, as matrix products of some thousand rows by as many (dots.matches), so no task holds a block.
    """
    rows = df.select(F.col(block).alias("block"), F.col(id_col).alias("a"), F.col(vector).alias("v"))
    return dots.matches(rows, None, "block", least).select("block", "a", "b", F.round("score", 4).alias("score"))


def embedding_search(df: DataFrame, wanted: Column, id_col: str = "vec_id", vector: str = "embedding", least: float = MATCH, block: int = 4096) -> DataFrame:
    """J12 as a search: query, match, score of the wanted rows against all others whose cosine reaches the threshold.

    Wanted rows and all rows are dealt to blocks of about so many; each two blocks meet as a matrix product (dots.matches). vectors.search() looks at fewer rows.
    """
    one = F.lit(0).alias("key")
    queries = df.where(wanted).select(one, F.col(id_col).alias("a"), F.col(vector).alias("v"))
    rows = df.select(one, F.col(id_col).alias("b"), F.col(vector).alias("v"))
    return dots.matches(queries, rows, "key", least, block).select(F.col("a").alias("query"), F.col("b").alias("match"), F.round("score", 4).alias("score"))


def kyc_verdict(check_type: Column, matched: Column, live: Column) -> Column:
    """L10."""
    both, one = matched & live, matched | live
    face = check_type == "face_match"
    return F.struct(
        F.when(face, F.when(matched, "pass").otherwise("fail")).otherwise(F.when(both, "pass").when(one, "inconclusive").otherwise("fail")).alias("status"),
        F.when(F.when(face, matched).otherwise(both), "PASS").otherwise("FAIL").alias("verdict"),
    )


def head_turn(nose: Column, left: Column, right: Column) -> Column:
    """L09."""
    ratio = F.try_divide(F.abs(nose - left), F.abs(right - nose))
    return F.when(ratio > 1.6, "right").when(ratio < 0.6, "left").otherwise("center")


def largest_face(faces: DataFrame, keys: list[str], box: str = "bbox") -> DataFrame:
    """Of each frame or image the face with the largest box (x1, y1, x2, y2)."""
    b = F.col(box)
    area = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    rest = [c for c in faces.columns if c not in keys]
    return faces.groupBy(*keys).agg(F.max_by(F.struct(*rest), area).alias("f")).select(*keys, "f.*")
