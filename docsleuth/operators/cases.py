"""Review cases: grouping of reports, folding of events to state, queue order, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsleuth.functions import fixed

STATE = ["status", "disposition", "priority", "assignee", "labels"]
DEFAULTS = {"status": "new", "disposition": "open", "priority": "normal"}


def risk_rank(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.RISK_RANK.items() for x in kv])[F.lower(level)], F.lit(0))


def rank_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), rank + 1)


def grouped(reports: DataFrame, key: str = "case_key") -> DataFrame:
    """Worst risk, lowest truth score, latest time, number of documents, and all documents, the newest first.

    A case is one row with its documents, so a task holds those of its largest case.
    """
    docs = F.sort_array(F.collect_list(F.struct("generated_at", "doc_id")), asc=False)
    return reports.groupBy(F.col(key).alias("case_key")).agg(F.max(risk_rank(F.col("risk_level"))).alias("risk_rank"), F.least(F.lit(100), F.min("truth_score")).alias("min_truth_score"), F.max("generated_at").alias("latest"), F.count(F.lit(1)).alias("n_documents"), docs.alias("documents"))


def folded(events: DataFrame, key: str = "case_key", time: str = "ts", columns: list[str] | None = None) -> DataFrame:
    """Of each case and column the last value that isn't null. One aggregation, combined before its shuffle."""
    return events.groupBy(F.col(key).alias("case_key")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns or STATE], F.max(time).alias("updated_at"))


def upserted(current: DataFrame, changes: DataFrame, entities: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cases after changes, of which the last value that isn't null counts in each column.

    A case that is new takes defaults for what is left, and its type and entity from its key (type::BT-..., cut at the last ::); the
    entity only if it is known. changes: case_key, ts and the columns; current: case_key, document_type, entity_ref and the columns.
    """
    own = columns or STATE
    latest = folded(changes, columns=own).withColumnsRenamed({c: f"__{c}" for c in own}).drop("updated_at")
    joined = current.withColumn("__known", F.lit(True)).join(latest, "case_key", "full_outer")
    ref = F.substring_index("case_key", "::", -1)
    has_key = F.contains("case_key", F.lit("::"))
    kind = F.when(has_key, F.left("case_key", F.length("case_key") - F.length(ref) - 2)).otherwise("")
    joined = joined.withColumn("__ref", F.when(F.col("__known").isNull() & has_key & ref.startswith("BT-"), ref))
    joined = joined.join(entities.select(F.col("entity_ref").alias("__entity")).distinct(), F.col("__ref") == F.col("__entity"), "left")
    made = {c: F.coalesce(F.col(f"__{c}"), F.col(c), F.when(F.col("__known").isNull(), F.lit(DEFAULTS[c])) if c in DEFAULTS else F.lit(None)) for c in own}
    new = F.col("__known").isNull()
    return joined.withColumns(made | {"document_type": F.when(new, kind).otherwise(F.col("document_type")), "entity_ref": F.when(new, F.col("__entity")).otherwise(F.col("entity_ref"))}).select("case_key", "document_type", "entity_ref", *own)


def noted(changes: DataFrame) -> DataFrame:
    """The notes that changes bring: case_key, created_at, author, note, where the note isn't blank."""
    return changes.where(F.trim("note") != "").select("case_key", F.col("ts").alias("created_at"), F.coalesce(F.nullif("author", F.lit("")), F.lit("system")).alias("author"), F.trim("note").alias("note"))


def with_defaults(cases: DataFrame, state: DataFrame) -> DataFrame:
    """J02."""
    out = cases.join(state, "case_key", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})


def needs_review(level: Column, disposition: Column) -> Column:
    """F06."""
    return F.lower(level).isin("high", "medium") & ~F.coalesce(disposition, F.lit("open")).isin("cleared", "fraud_confirmed")


def lane(level: Column, disposition: Column) -> Column:
    """one column instead of three scans."""
    return F.when(needs_review(level, disposition), "needs_review").when(F.coalesce(disposition, F.lit("open")).isin("cleared", "fraud_confirmed") & F.lower(level).isin("high", "medium"), "resolved").otherwise("auto_approved")


def queue(cases: DataFrame, limit: int | None = None) -> DataFrame:
    """Cases to review first, then by risk and time."""
    out = cases.orderBy(F.desc("needs_review"), F.desc("risk_rank"), F.desc("latest"), "case_key")
    return out.limit(limit) if limit else out


def filtered(df: DataFrame, **wanted: str | None) -> DataFrame:
    """equal to each given value; None leaves a column free."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def containing(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """F03, F08."""
    return df.where(F.contains(F.lower(F.concat_ws("\u0001", *columns)), F.lit(query.lower())))


def lifecycle(assessments: DataFrame, state: DataFrame) -> DataFrame:
    """Events that new assessments cause; decided cases are left alone, low risk closes only unseen ones."""
    joined = assessments.join(state.select("case_key", "disposition", F.lit(True).alias("seen")), "case_key", "left")
    open_case = ~F.coalesce("disposition", F.lit("open")).isin("cleared", "fraud_confirmed")
    level = F.lower("risk_level")
    event = F.when(level == "high", F.struct(F.lit("triage").alias("status"), F.lit("open").alias("disposition"), F.lit("high").alias("priority"))).when(level == "medium", F.struct(F.lit("new").alias("status"), F.lit("open").alias("disposition"), F.lit("normal").alias("priority"))).when(F.col("seen").isNull(), F.struct(F.lit("closed").alias("status"), F.lit("cleared").alias("disposition"), F.lit("normal").alias("priority")))
    return joined.where(open_case).withColumn("e", event).where("e is not null").select("case_key", "e.*")


def lifecycle_in_order(assessments: DataFrame, state: DataFrame, order: str) -> DataFrame:
    """L15 where a case may have several new assessments: each meets the case as those before it left it.

    Of a case that nobody has seen the first assessment decides: low risk closes it, and a closed one is left alone; any other opens it, and then
    low risk says nothing. So one look at a case's first row takes the place of a loop. Columns: case_key, the event's, and the order's.
    """
    first = assessments.groupBy("case_key").agg(F.min_by(F.lower("risk_level"), order).alias("first_level"), F.min(order).alias("first_at"))
    known = first.join(state.select("case_key", "disposition", F.lit(True).alias("seen")), "case_key", "left").where(~F.coalesce("disposition", F.lit("open")).isin("cleared", "fraud_confirmed"))
    closes = F.col("seen").isNull() & ~F.col("first_level").isin("high", "medium")
    joined = assessments.join(known.select("case_key", closes.alias("closes"), "first_at"), "case_key")
    level = F.lower("risk_level")
    high, medium = level == "high", level == "medium"
    told = joined.where(F.when(F.col("closes"), F.col(order) == F.col("first_at")).otherwise(high | medium))
    closing = F.col("closes")
    return told.select("case_key", F.when(closing, "closed").when(high, "triage").otherwise("new").alias("status"), F.when(closing, "cleared").otherwise("open").alias("disposition"), F.when(~closing & high, "high").otherwise("normal").alias("priority"), order)


def reopened(anomalies: DataFrame, state: DataFrame) -> DataFrame:
    """Cleared cases of entities with an anomaly; matched on the parsed reference."""
    ref = F.substring_index("case_key", "::", -1)
    hit = state.where("disposition = 'cleared'").withColumn("entity_ref", ref).join(anomalies.select("entity_ref").distinct(), "entity_ref", "left_semi")
    return hit.select("case_key", F.lit("triage").alias("status"), F.lit("open").alias("disposition"), F.lit("high").alias("priority"))


def dirty(entries: DataFrame, reports: DataFrame) -> DataFrame:
    """Whether an entity's report is older than its newest entry."""
    newest = entries.groupBy("entity_ref").agg(F.max("updated_at").alias("updated_at"))
    made = reports.groupBy("entity_ref").agg(F.max("generated_at").alias("generated_at"))
    return newest.join(made, "entity_ref", "left").withColumn("report_current", F.coalesce(F.col("generated_at") >= F.col("updated_at"), F.lit(False)))


def detail(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Cases with their notes in order."""
    n = notes.groupBy("case_key").agg(F.array_sort(F.collect_list(F.struct("created_at", "note"))).alias("notes"))
    return cases.join(n, "case_key", "left")


def timeline(reports: DataFrame, state: DataFrame, notes: DataFrame) -> DataFrame:
    """J15 as rows, for cases of any size: what a case's page shows, a row for each report and each note, with the case's state beside it.

    case_key, the state's columns (defaults where nobody has set them), kind (report, note), at, what (the report's source or the note's text), by (risk level or author).
    Reports of cases without any state are open; notes of unknown cases have no place.
    """
    known = with_defaults(reports.select("case_key").distinct(), state)
    shown = reports.select("case_key", F.lit("report").alias("kind"), F.col("generated_at").alias("at"), F.col("source_name").alias("what"), F.col("risk_level").alias("by"))
    said = notes.select("case_key", F.lit("note").alias("kind"), F.col("created_at").alias("at"), F.col("note").alias("what"), F.col("author").alias("by"))
    return known.join(shown.unionByName(said), "case_key")


def fan_out(checks: DataFrame) -> DataFrame:
    """The screens and sections that one check fills."""
    def entry(screen: str, section: str) -> Column:
        return F.struct(F.lit(screen).alias("screen"), F.lit(section).alias("section"))

    face = F.array(*[entry("Identity Verification", s) for s in ("Aadhaar", "PAN Card", "Photo Upload", "Run Verification")])
    kyc = F.array(entry("Video KYC", "In-Person Session"))
    remote = F.array(entry("Video KYC", "Remote Session"))
    scan = F.array(F.struct(F.lit("Document Scan").alias("screen"), F.col("source_name").alias("section")))
    kind = F.col("check_type")
    rows = F.when(kind == "face_match", face).when(kind == "video_kyc", F.when(F.col("remote"), remote).otherwise(kyc)).when(kind == "scan", scan)
    return checks.select("*", F.explode(rows).alias("e")).select("*", "e.*").drop("e")


def labels(v: Column) -> Column:
    """U03."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x != "")))
