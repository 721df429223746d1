"""The operators as queries over the driver's tables, with production parameters and results as digests."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.llm import bpe, decontam, html_extract, licenses, periods, quality, resample, sharding, simhash, substring, suffixes, toxicity, warc
from docsleuth.llm.common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.scored(documents, model).select("doc_id", "held_out", "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.digests(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.digests(licenses.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chunks", "n_duplicate_chunks", "n_removed_words", "text")


def planted(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """The contract's repetition in every tenth document, by the checksum of its id: from a word on, the words of one period over and over."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(ids), h // 10
    if h % 10 or not n:
        return ids
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % period]])


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(table(spark, sf_dir, "documents"), alter=planted, outputs=False)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html, op2_bpe, op3_toxicity, op4_decontamination, op5_simhash, op6_sharding, op7_warc, op8_quality, op9_licenses, op10_substring_dedup, op11_periods, op12_suffixes, op13_resampling)
    return {f.__name__: f for f in found}
