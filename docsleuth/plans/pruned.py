"""Queries of joins that don't compare all pairs, of order statistics without a sort, and of rows and files larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.operators import ledger, quantiles, similar, vectors
from docsleuth.plans import views as V
from docsleuth.plans.registry import query
from docsleuth.sources import ranges, sync
from docsleuth.sources.shared import shared_dir

_HEADS = r"v_head AS (SELECT doc_id, list_filter(list_distinct(regexp_split_to_array(lower(trim(left(text, 80))), '\s+')), lambda w: w <> '') AS w FROM documents)"


@query("SELECT a, b, shared, CAST(floor(1000 * shared / (x + y - shared)) AS BIGINT) AS thousandths FROM (SELECT a.doc_id AS a, b.doc_id AS b, CAST(len(list_intersect(a.w, b.w)) AS BIGINT) AS shared, len(a.w) AS x, len(b.w) AS y FROM v_head a JOIN v_head b ON a.doc_id % 2 = 0 AND b.doc_id % 2 = 1) WHERE shared > 0 AND shared / (x + y - shared) >= 0.5", _HEADS)
def word_set_matches(spark: SparkSession, d: str) -> DataFrame:
    """J11 as a set-similarity join: beginnings of even documents against those of odd ones; few pairs match, and few meet."""
    rows = V.table(spark, d, "documents").select("doc_id", F.left("text", F.lit(80)).alias("head"))
    even, odd = rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "a"), rows.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "b")
    return similar.set_join(even, odd, "a", "b", "head", "head", 0.5).select("a", "b", "shared", F.floor(F.col("similarity") * 1000).cast("bigint").alias("thousandths"))


_PRINTS = "v_print AS (SELECT o_orderkey AS id, xor(o_orderkey % 1500 * 4099000012297, CASE (o_orderkey // 1500) % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 4611686018427387904 ELSE 15 END) AS h FROM orders), v_rep AS (SELECT h, min(id) AS id FROM v_print GROUP BY 1)"


def _prints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    turn = F.expr("o_orderkey div 1500 % 4")
    flip = F.when(turn == 0, F.lit(0)).when(turn == 1, F.lit(5)).when(turn == 2, F.lit(1 << 62)).otherwise(F.lit(15))
    return V.table(spark, d, "orders").select(k.alias("id"), (k % 1500 * 4_099_000_012_297).bitwiseXOR(flip.cast("bigint")).alias("h"))


@query("SELECT a.id AS a, b.id AS b FROM v_rep a JOIN v_rep b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 3", _PRINTS)
def near_prints(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of representatives; hot keys are split, here from 64 rows on."""
    return similar.near_templates(_prints(spark, d), "id", "h", most_rows=64)


@query("SELECT p.id, r.id AS representative FROM v_print p JOIN v_rep r ON p.h = r.h", _PRINTS)
def print_members(spark: SparkSession, d: str) -> DataFrame:
    """Whom each representative stands for."""
    return similar.representatives(_prints(spark, d), "id", "h")


@query("SELECT account, txn_no, expected, diff, diff >= 10000 AND diff % 1000 = 0 AS round_number FROM v_error", f"{V.BALANCES}, " + """v_error AS (SELECT account, txn_no, expected, abs(balance - expected) AS diff FROM (
  SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY txn_date, txn_no) + credit - debit AS expected FROM v_balance)
  WHERE abs(balance - expected) > greatest(500, CAST(trunc(abs(expected) * 0.01) AS BIGINT)))""")
def ranged_balance_errors(spark: SparkSession, d: str) -> DataFrame:
    """W02 where an account may hold a third of all rows: ranges of accounts and days, each carrying its last row on."""
    return ledger.balance_errors_in_ranges(V.balances(spark, d), ranges=24).select("account", "txn_no", "expected", "diff", "round_number")


@query("SELECT msg, count(*) AS n, quantile_disc(elapsed_ms, 0.95) AS p95_ms, quantile_disc(elapsed_ms, 0.5) AS median_ms FROM v_log WHERE elapsed_ms IS NOT NULL GROUP BY 1", V.LOGS)
def log_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact 95 % and median times of each operation, from a sketch and one pass."""
    logs = V.logs(spark, d)
    slow = quantiles.quantile(logs, ["msg"], "elapsed_ms", 0.95).select("msg", "n", F.col("value").alias("p95_ms"))
    return slow.join(quantiles.quantile(logs, ["msg"], "elapsed_ms", 0.5).select("msg", F.col("value").alias("median_ms")), "msg")


@query("SELECT lang || '.pdf' AS name, CAST(n AS BIGINT) AS size_bytes, sha256(body) AS sha256, '1.7' AS pdf_version, '/FT/Sig|/Type/Sig' AS markers FROM (SELECT lang, body, strlen(body) AS n FROM (SELECT lang, string_agg('%PDF-1.7 /Type     ' || chr(10) || '   /Sig ' || doc_id || ' /FT   /Sig' || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1))")
def ranged_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A file for each language, read by ranges of 97 bytes, so that markers span two."""
    base = shared_dir(spark)
    docs = V.table(spark, d, "documents").where(F.col("lang").isin("de", "en", "es", "fr"))
    text = F.concat(F.lit("%PDF-1.7 /Type     \n   /Sig "), "doc_id", F.lit(" /FT   /Sig"))
    sync.write_lines(docs.select(F.concat("lang", F.lit(".pdf")).alias("name"), "doc_id", text.alias("value")), f"{base}/files", "doc_id")
    folder = f"{base}/files" if ":" in base else f"file://{base}/files"
    found = ranges.fingerprints(spark, folder, 9_700)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "sha256", "pdf_version", F.array_join("signature_markers", "|").alias("markers"))


_NEAR = "SELECT a.vec_id AS query, b.vec_id AS match FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.40"


@query(_NEAR)
def cell_search(spark: SparkSession, d: str) -> DataFrame:
    """J12 through the index in its exact mode: every vec_id divisible by 100 looks at all cells."""
    index = vectors.build(V.table(spark, d, "embeddings"))
    return vectors.search(index, index.rows.where("id % 100 = 0").select("id", "vector")).select("query", "match")


@query()
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """J12 through the index: every vec_id divisible by 100 looks at as many cells as find nine tenths of the matches of sampled queries. Tests hold it against all pairs."""
    index = vectors.build(V.table(spark, d, "embeddings"))
    probes, _ = vectors.enough_probes(index)
    return vectors.search(index, index.rows.where("id % 100 = 0").select("id", "vector"), probes)
