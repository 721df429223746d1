"""Dashboards, roll-ups and log analytics; each is one pass of conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.operators.cases import rank_name


def dashboard(reports: DataFrame, state: DataFrame) -> DataFrame:
    """Totals, risk split and mean score beside open, cleared and fraud cases; two rows of figures joined to one."""
    level = F.lower("risk_level")
    r = reports.agg(F.count(F.lit(1)).alias("n_scans"), F.count_if(level == "high").alias("n_high"), F.count_if(level == "medium").alias("n_medium"), F.count_if(level == "low").alias("n_low"), F.round(F.avg("truth_score"), 1).alias("avg_score"))
    s = state.agg(F.count_if(~F.coalesce("disposition", F.lit("open")).isin("cleared", "fraud_confirmed")).alias("n_open"), F.count_if(F.col("disposition") == "cleared").alias("n_cleared"), F.count_if(F.col("disposition") == "fraud_confirmed").alias("n_fraud"))
    return r.crossJoin(F.broadcast(s))


def entity_cards(scans: DataFrame, entity: str = "entity_ref", time: str = "generated_at") -> DataFrame:
    """A10: scan count, latest risk and score."""
    return scans.groupBy(F.col(entity).alias("entity_ref")).agg(F.count(F.lit(1)).alias("n_scans"), F.max_by("risk_level", time).alias("latest_risk"), F.max_by("truth_score", time).alias("latest_score"), F.max(time).alias("latest"))


def newest_with_counts(entities: DataFrame, scans: DataFrame, n: int = 20) -> DataFrame:
    """Documents of the newest entities; the limit comes before the join."""
    top = entities.orderBy(F.desc("id")).limit(n)
    counts = scans.join(F.broadcast(top.select("entity_ref")), "entity_ref", "left_semi").groupBy("entity_ref").agg(F.count(F.lit(1)).alias("n_documents"))
    return top.join(counts, "entity_ref")


def bundle(reports: DataFrame, anomalies: DataFrame, key: str = "case_id") -> DataFrame:
    """The worst of document risks and anomaly severities; a severity outside high, medium, low counts as low."""
    rank = lambda c: F.when(F.lower(c) == "high", 2).when(F.lower(c).isin("medium", "review"), 1).otherwise(0)
    both = reports.select(key, rank("risk_level").alias("r")).union(anomalies.select(key, rank("severity").alias("r")))
    return both.groupBy(key).agg(rank_name(F.max("r")).alias("bundle_risk"))


def bundle_header(reports: DataFrame, key: str = "case_id", order: str = "ord") -> DataFrame:
    """The first filled value of each header field."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return reports.groupBy(key).agg(first("applicant"), first("employer"), first("net_pay"), first("bank_name"), F.count_if(F.lower("risk_level") != "low").alias("n_issues"), F.count(F.lit(1)).alias("n_documents"))


def overall_verdict(checks: DataFrame, key: str = "entity_ref") -> DataFrame:
    """A14."""
    v = F.upper("verdict")
    return checks.groupBy(key).agg(F.when(F.count("verdict") == 0, "NO CHECKS").when(F.bool_and(v.isin("PASS", "CLEAR")), "PASSED").when(F.bool_or(v.isin("FAIL", "CRITICAL")), "FAILED").otherwise("REVIEW").alias("overall"))


def log_levels(logs: DataFrame) -> DataFrame:
    """INFO and DEBUG are one."""
    return logs.groupBy(F.when(F.col("level").isin("INFO", "DEBUG"), "INFO").otherwise(F.col("level")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def top_modules(logs: DataFrame, k: int = 10) -> DataFrame:
    """A15, O05."""
    return logs.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("n_errors")).orderBy(F.desc("n"), "module").limit(k)


def log_filter(logs: DataFrame, level: str | None = None, module: str | None = None, pattern: str | None = None) -> DataFrame:
    """F07."""
    for c, v in (("level", level), ("module", module)):
        if v:
            logs = logs.where(F.col(c) == v)
    return logs.where(F.col("msg").rlike(f"(?i){pattern}")) if pattern else logs


def timings(logs: DataFrame, operation: str = "func", elapsed: str = "elapsed_ms") -> DataFrame:
    """A18."""
    return logs.where(F.col(elapsed).isNotNull()).groupBy(operation).agg(F.count(F.lit(1)).alias("n"), F.avg(elapsed).alias("avg_ms"), F.percentile_approx(elapsed, 0.95).alias("p95_ms"))


def counts_by(df: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """A column of counts for each kind."""
    return df.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def table_counts(**tables: DataFrame) -> DataFrame:
    """A11."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.union(one)
    return out


def all_reports(verifications: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Both kinds of report as one list."""
    a = verifications.select("doc_id", F.lit("verification").alias("kind"), "source_name", "generated_at", "risk_level", "truth_score")
    b = comparisons.select("doc_id", F.lit("comparison").alias("kind"), "source_name", "generated_at", F.lit(None).cast("string").alias("risk_level"), F.lit(None).cast("int").alias("truth_score"))
    return a.unionByName(b)


def entity_name(df_first: str = "first_name", df_last: str = "last_name") -> Column:
    return F.trim(F.concat(F.coalesce(df_first, F.lit("")), F.lit(" "), F.coalesce(df_last, F.lit(""))))


def linked_scans(scans: DataFrame, entities: DataFrame) -> DataFrame:
    """Every scan with its entity's reference and name; scans without one are unlinked. entities: entity_ref, first_name, last_name."""
    names = entities.select(F.col("entity_ref").alias("__ref"), entity_name().alias("entity_name"))
    out = scans.join(names, F.col("entity_ref") == F.col("__ref"), "left")
    key = F.concat_ws("::", F.coalesce("document_type", F.lit("generic")), F.coalesce("__ref", F.lit("unlinked")))
    return out.withColumns({"case_key": key, "entity_ref": F.coalesce("__ref", F.lit("unlinked")), "entity_name": F.coalesce("entity_name", F.lit("—"))}).drop("__ref")


def recent_scans(scans: DataFrame, entities: DataFrame, k: int = 200, time: str = "generated_at") -> DataFrame:
    """The newest scans with their entities; the limit comes before the join, so the join's other side may be of any size."""
    return linked_scans(scans.orderBy(F.desc(time), F.desc("doc_id")).limit(k), entities)


def entity_overview(entities: DataFrame, scans: DataFrame, checks: DataFrame, entries: DataFrame, time: str = "generated_at") -> DataFrame:
    """Each entity with its newest scan of every source and type, its newest check of every type, and its layered entries.

    Every side is reduced to one row an entity before its join. scans: source_name, document_type, doc_id, risk_level; checks: check_type,
    verdict, checked_at; entries: screen, section, updated_at.
    """
    last = scans.groupBy("entity_ref", "source_name", F.coalesce("document_type", F.lit("generic")).alias("document_type")).agg(F.max(F.struct(time, "doc_id", "risk_level")).alias("s"))
    s = last.groupBy("entity_ref").agg(F.array_sort(F.collect_list(F.struct("source_name", "document_type", F.col("s.doc_id").alias("doc_id"), F.col("s.risk_level").alias("risk_level")))).alias("scans"))
    c = checks.groupBy("entity_ref", "check_type").agg(F.max(F.struct("checked_at", "verdict")).alias("c"))
    c = c.groupBy("entity_ref").agg(F.array_sort(F.collect_list(F.struct("check_type", F.col("c.verdict").alias("verdict")))).alias("checks"))
    e = entries.groupBy("entity_ref", "screen", "section").agg(F.max("updated_at").alias("updated_at"))
    e = e.groupBy("entity_ref").agg(F.array_sort(F.collect_list(F.struct("screen", "section", "updated_at"))).alias("entries"))
    out = entities
    for side in (s, c, e):
        out = out.join(side, "entity_ref", "left")
    return out


def log_tail(logs: DataFrame, k: int = 15, time: str = "ts", tie: str | None = None) -> DataFrame:
    """The last records, the newest first."""
    return logs.orderBy(F.desc(time), *([F.desc(tie)] if tie else [])).limit(k)


def visible_layers(layers: Column, shown: tuple[int, ...] = (1, 2, 4)) -> Column:
    """of an array of structs with a title those whose title names a shown layer."""
    return F.filter(layers, lambda x: F.substring(x["title"], 1, 7).isin(*[f"Layer {n}" for n in shown]))
