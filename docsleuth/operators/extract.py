"""Document text to structured summaries: lines, label/value pairs, typed fields, classification.

A summary is made within its row: no shuffle, and no join that could gather labels on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.functions import fixed
from docsleuth.functions import scalars as X
from docsleuth.operators import ledger


def pages_of_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Pages at form feeds or four line breaks; blank ones go, one always stays."""
    found = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\f|\n{4,}"), lambda p: F.trim(p) != "")
    # as an element of an array, so that the text is split once
    found = F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("")))), 0)
    return df.withColumn("pages", F.transform(found, lambda p, i: F.struct((i + 1).alias("page"), p.alias("text"))))


def lines(df: DataFrame, id_col: str = "doc_id", pages: str = "pages") -> DataFrame:
    """doc_id, page, line_no, line; blank lines are left out."""
    # inner explodes would also filter on the arrays' sizes, which splits every text a second time
    rows = df.select(F.col(id_col).alias("doc_id"), F.explode_outer(pages).alias("p")).select("doc_id", "p.page", F.posexplode_outer(F.split("p.text", r"\R")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).where("line != ''")


def pairs(rows: DataFrame) -> DataFrame:
    """label/value pairs of lines with columns at least two spaces apart."""
    cut = rows.withColumn("seg", _columns(F.col("line")))
    out = cut.select("doc_id", "page", "line_no", F.posexplode_outer(F.when(F.size("seg") >= 2, _paired(F.col("seg")))).alias("pair_no", "p")).where("p is not null")
    return out.select("doc_id", "page", "line_no", "pair_no", "p.label", X.normalize_label(F.col("p.label")).alias("normalized_label"), "p.value")


def _columns(line: Column) -> Column:
    return F.filter(F.split(line, r"\s{2,}"), lambda s: F.trim(s) != "")


def _paired(seg: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(seg) - 2, F.lit(2)), lambda i: F.struct(F.trim(F.get(seg, i)).alias("label"), F.trim(F.get(seg, i + 1)).alias("value")))


def with_named_fields(df: DataFrame, line_list: str = "line_list", cut: str | None = None) -> DataFrame:
    """X04, X13 within each row: named_fields and value_count from its lines, without a shuffle or a join. A document without pairs has an empty map and no count.

    Pairs are sorted by label and place and cut where the label changes, so the work grows with n log n of a document's pairs. cut: a column of the
    lines' columns, where they are known.
    """
    pair = lambda p: F.struct(X.normalize_label(p["label"]).alias("label"), p["value"].alias("value"))
    segs = F.filter(F.col(cut) if cut else F.transform(line_list, _columns), lambda s: F.size(s) >= 2)
    # a column for each step: the next one refers to it more than once, so that it is computed once
    out = df.withColumn("__pairs", F.flatten(F.transform(segs, lambda s: F.transform(_paired(s), pair))))
    out = out.withColumn("__pairs", F.sort_array(F.transform("__pairs", lambda p, i: F.struct(p["label"].alias("label"), i.alias("at"), p["value"].alias("value")))))
    first = F.filter(F.transform("__pairs", lambda p, i: F.when(F.coalesce(F.get("__pairs", i - 1)["label"] == p["label"], F.lit(False)), -1).otherwise(i)), lambda i: i >= 0)
    out = out.withColumn("__first", first)
    of = lambda i, n: F.slice("__pairs", i + 1, F.coalesce(F.get("__first", n + 1), F.size("__pairs")) - i)
    entry = lambda i, n: F.struct(F.get("__pairs", i)["label"].alias("label"), F.array_distinct(F.transform(of(i, n), lambda p: p["value"])).alias("values"))
    out = out.withColumn("named_fields", F.coalesce(F.map_from_entries(F.transform("__first", entry)), F.create_map().cast("map<string,array<string>>"))).drop("__pairs", "__first")
    return out.withColumn("value_count", F.nullif(F.aggregate(F.map_values("named_fields"), F.lit(0).cast("bigint"), lambda a, v: a + F.size(v)), F.lit(0).cast("bigint")))


def named_fields(found: DataFrame) -> DataFrame:
    """Label to its distinct values in the order of the document."""
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "pair_no", "value"))), lambda x: x["value"]))
    by_label = found.groupBy("doc_id", "normalized_label").agg(ordered.alias("values"))
    return by_label.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("normalized_label", "values"))).alias("named_fields"), F.sum(F.size("values")).alias("value_count"))


def classify(name: Column, text: Column, taxonomy: list[tuple[str, list[str]]] = fixed.DOC_TYPES) -> Column:
    """Type, confidence, non-zero scores and matched markers.

    A marker counts once, wherever it stands; a type named by the file counts two more. The first type of the
    best score wins; without any the type is generic.
    """
    name, text = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(text, F.lit(""))

    def marked(whole: Column) -> Column:
        """Of each type its rank and the markers found. A quoted pattern skips along the text by the marker's length, where contains() looks at each byte."""
        quoted = lambda w: F.lit("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E")
        boost = lambda kind: [F.when(F.contains(name, F.lit(kind)), "(filename_boost)")] if kind != "generic" else []
        found = lambda kind, words: F.array_compact(F.array(*[F.when(F.rlike(whole, quoted(w)), w) for w in words], *boost(kind)).cast("array<string>"))
        return F.array(*[F.struct(F.lit(-k).alias("rank"), F.lit(kind).alias("type"), found(kind, words).alias("found")) for k, (kind, words) in enumerate(taxonomy)])

    def scored(types: Column) -> Column:
        hit = F.transform(F.filter(types, lambda m: F.size(m["found"]) > 0), lambda m: F.struct((F.size(m["found"]) + F.when(F.array_contains(m["found"], "(filename_boost)"), 1).otherwise(0)).alias("score"), m["rank"].alias("rank"), m["type"].alias("type"), m["found"].alias("found")))
        return F.struct(F.array_max(F.transform(hit, lambda h: F.struct(h["score"], h["rank"], h["type"]))).alias("best"), hit.alias("hit"))

    def summed(x: Column) -> Column:
        best, hit = x["best"], x["hit"]
        return F.struct(
            F.coalesce(best["type"], F.lit("generic")).alias("type"),
            F.when(best["type"] != "generic", F.least(F.lit(0.98), F.round(0.4 + 0.12 * best["score"], 2))).otherwise(0.2).alias("confidence"),
            F.map_from_entries(F.transform(hit, lambda h: F.struct(h["type"], h["score"]))).alias("scores"),
            F.map_from_entries(F.transform(hit, lambda h: F.struct(h["type"], h["found"]))).alias("markers"),
            F.length(text).alias("text_length"),
            F.left(F.translate(text, "\n", " "), F.lit(300)).alias("preview"),
        )

    # arrays of one element bind what would else be evaluated for every marker, type and result
    once = lambda value, make: F.get(F.transform(F.array(value), make), 0)
    return once(once(once(F.concat(name, F.lit("\n"), F.lower(text)), marked), scored), summed)


def with_type(df: DataFrame, name_col: str, text_col: str, taxonomy: list[tuple[str, list[str]]] = fixed.DOC_TYPES) -> DataFrame:
    """df with doc_type and type_confidence as classify() gives them, from plain columns of scores, so that Spark compiles the search for markers."""
    name, text = F.lower(F.coalesce(name_col, F.lit(""))), F.lower(F.coalesce(text_col, F.lit("")))
    out = df.withColumns({"__name": name, "__low": F.concat(name, F.lit("\n"), text)})
    one = lambda found, points: found.cast("int") * points

    def score(kind: str, words: list[str]) -> Column:
        total = one(F.contains("__name", F.lit(kind)), 2) if kind != "generic" else F.lit(0)
        for w in words:
            total = total + one(F.contains("__low", F.lit(w)), 1)
        return total

    scores = F.array(*[score(*x) for x in taxonomy]).cast("array<int>")
    out = out.withColumn("__scores", scores).drop("__name", "__low").withColumn("__best", F.array_max("__scores"))
    kinds = F.array(*[F.lit(kind) for kind, _ in taxonomy]).cast("array<string>")
    first = F.get(kinds, (F.array_position("__scores", F.col("__best")) - 1).cast("int"))
    out = out.withColumn("doc_type", F.when(F.col("__best") > 0, first).otherwise(F.lit("generic")))
    sure = F.least(F.lit(0.98), F.round(0.4 + 0.12 * F.col("__best"), 2))
    return out.withColumn("type_confidence", F.when(F.col("doc_type") != "generic", sure).otherwise(0.2)).drop("__scores", "__best")


_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"


def candidate_dates(text: Column) -> Column:
    """X10."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_DATE), F.lit(0)))


def is_identifier() -> Column:
    """X11, of a pair."""
    return F.col("normalized_label").rlike("|".join(fixed.IDENTIFIER_LABELS))


def identifiers(found: DataFrame) -> DataFrame:
    """X11."""
    return found.where(is_identifier())


def money() -> Column:
    """X12, of a pair: its amount; null if the label tells of none or the value holds none."""
    named = ~F.col("normalized_label").contains("date") & F.col("normalized_label").rlike("|".join(fixed.MONEY_LABELS))
    return F.when(named, X.parse_amount(F.col("value")))


def monetary(found: DataFrame) -> DataFrame:
    """X12."""
    return found.withColumn("numeric_value", money()).where("numeric_value is not null")


def _alias(*labels: str) -> Column:
    return F.coalesce(*[X.blank_to_null(F.get(F.col("named_fields")[x], 0)) for x in labels])


def _kept(value: Column, that: Callable[[Column], Column]) -> Column:
    """value where that holds, else null; the value is evaluated once, which nullif and when don't do."""
    return F.get(F.filter(F.array(value), that), 0)


def _find(pattern: str, group: int = 1) -> Column:
    return _kept(F.trim(F.regexp_replace(F.regexp_extract("full_text", pattern, group), r"\s+", " ")), lambda v: v != "")


def _amount_over(pattern: str, least: int) -> Column:
    return _kept(X.parse_amount(F.regexp_extract("full_text", pattern, 1)), lambda v: v > least).cast("string")


def payslip_fields() -> dict[str, Column]:
    """X16, V03."""
    out = {k: _alias(*labels) for k, labels in fixed.PAYSLIP_FIELDS.items()}
    out["pay_period"] = _find(r"(?i)payslip for the month of\s+([A-Za-z]+\s+\d{4})")
    out["net_pay_in_words"] = _find(r"(?is)Rupees\s+(.+?)\s+Only")
    return out


def employment_fields() -> dict[str, Column]:
    """What a letter's sentences say; amounts without their commas, dates as written."""
    return {
        "cin": F.upper(_find(fixed.CIN_IN_TEXT)),
        "annual_ctc": _amount_over(fixed.ANNUAL_CTC, 10_000),
        "gross_monthly_salary": _amount_over(fixed.GROSS_MONTHLY, 1_000),
        "date_of_joining": _find(fixed.JOINING_DATE),
        "letter_issue_date": _find(fixed.ISSUE_DATE),
        "employee_name": _find(fixed.EMPLOYEE_NAME),
    }


def bank_fields(ends: Column | None = None) -> dict[str, Column]:
    """A statement's head, and the totals and ends of its ledger (the column transactions)."""
    head = F.filter("line_list", lambda x: (F.length(x) < 70) & F.upper(x).rlike(r"\bBANK\b"))
    balance = lambda labels: F.coalesce(*[X.parse_amount(F.get(F.col("named_fields")[x], 0)) for x in labels]).cast("string")
    return {
        "bank_name": F.get(head, 0),
        "period_from": _find(fixed.STATEMENT_PERIOD, 1),
        "period_to": _find(fixed.STATEMENT_PERIOD, 2),
        "ifsc": F.upper(_find(fixed.IFSC_IN_TEXT)),
        "account_number": _find(fixed.MASKED_ACCOUNT),
        "opening_balance": balance(fixed.OPENING_LABELS),
        "closing_balance": balance(fixed.CLOSING_LABELS),
        **ledger_fields(F.col("transactions"), ends),
    }


def ledger_ends(t: Column) -> Column:
    """First and last day as written; rows whose date can't be read come first. Each date is read once."""
    dated = F.transform(t, lambda x, i: F.struct(F.coalesce(X.bank_date(x["date"]), F.lit("0001-01-01").cast("date")).alias("d"), i.alias("i"), x["date"].alias("date")))
    return F.get(F.transform(F.array(dated), lambda x: F.struct(F.array_min(x)["date"].alias("first"), F.array_max(x)["date"].alias("last"))), 0)


def ledger_fields(t: Column, ends: Column | None = None) -> dict[str, Column]:
    """Totals and ends (ledger_ends(), or a column of it). None of an empty ledger."""
    ends = ledger_ends(t) if ends is None else ends
    total = lambda side: F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + x[side])
    some = F.size(t) > 0
    return {
        "credit_total": F.when(some, total("credit").cast("string")),
        "debit_total": F.when(some, total("debit").cast("string")),
        "earliest_txn_date": ends["first"],
        "latest_txn_date": ends["last"],
    }


def gift_fields() -> dict[str, Column]:
    """X22."""
    return {
        "gift_amount": _amount_over(fixed.GIFT_AMOUNT, 10_000),
        "property_value": _amount_over(fixed.PROPERTY_VALUE, 10_000),
        "donor_pan": _find(fixed.DONOR_PAN),
        "letter_date": _find(fixed.LETTER_DATE),
    }


def transactions(line_list: Column) -> Column:
    """Ledger rows among a statement's lines."""
    return _ledger_rows(F.transform(line_list, _columns))


def _ledger_rows(cut: Column) -> Column:
    """The same from the lines' columns. Each step is an array of its own, so that an amount, a text and a side are read once a row."""
    dated = F.filter(cut, lambda s: (F.size(s) >= 5) & F.get(s, 0).rlike(r"^\d{2}-\d{2}-\d{4}$"))
    read = F.transform(dated, lambda s: F.struct(s.alias("s"), X.parse_amount(F.element_at(s, -2)).alias("amount"), X.parse_amount(F.element_at(s, -1)).alias("balance"), F.array_join(F.slice(s, 2, F.size(s) - 4), " ").alias("desc")))
    kept = F.filter(read, lambda r: (r["balance"] >= 1000) & r["amount"].isNotNull())
    sided = F.transform(kept, lambda r: F.struct(r.alias("r"), F.lower(r["desc"]).rlike("|".join(fixed.CREDIT_WORDS)).alias("credit")))
    zero = F.lit(0).cast("bigint")

    def row(x: Column) -> Column:
        r = x["r"]
        return F.struct(F.get(r["s"], 0).alias("date"), r["desc"].alias("desc"), F.element_at(r["s"], -3).alias("ref"), F.when(x["credit"], zero).otherwise(r["amount"]).alias("debit"), F.when(x["credit"], r["amount"]).otherwise(zero).alias("credit"), r["balance"].alias("balance"))

    return F.transform(sided, row).cast(ledger.TRANSACTIONS)


def rederived_sides(t: Column) -> Column:
    """Debit and credit from the change of balance, where the description alone misleads."""
    zero = F.lit(0).cast("bigint")

    def row(x: Column, i: Column) -> Column:
        step = x["balance"] - F.get(t, i - 1)["balance"]
        amount = F.greatest(x["debit"], x["credit"])
        known = step.isNotNull() & (F.abs(step) == amount)
        return x.withField("debit", F.when(known, F.when(step < 0, amount).otherwise(zero)).otherwise(x["debit"])).withField("credit", F.when(known, F.when(step > 0, amount).otherwise(zero)).otherwise(x["credit"]))

    return F.transform(t, row)


def summaries(df: DataFrame, id_col: str = "doc_id", name_col: str = "source_name", pages: str = "pages", parity: bool = True, taxonomy: list[tuple[str, list[str]]] = fixed.DOC_TYPES) -> DataFrame:
    """One row per document, with the columns that rules.assess() asks for. parity=False also maps labels that rules know by other names and re-derives ledger sides."""
    base = df.select(F.col(id_col).alias("doc_id"), F.col(name_col).alias("source_name"), F.col(pages).alias("pages"))
    full = F.array_join(F.transform("pages", lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    # blank lines go, so a pair of breaks may count as two, which takes a plain class of characters
    listed = F.flatten(F.transform("pages", lambda p: F.filter(F.transform(F.split(F.coalesce(p["text"], F.lit("")), r"[\n\x0B\f\r\x85\u2028\u2029]"), lambda x: F.trim(x)), lambda x: x != "")))
    # lines are cut into their columns once, for pairs and ledger rows
    base = base.select("doc_id", "source_name", full.alias("full_text"), listed.alias("line_list"), F.size("pages").alias("page_count")).withColumn("__cut", F.transform("line_list", _columns))
    kind = classify(F.col("source_name"), F.col("full_text"), taxonomy)
    out = with_type(with_named_fields(base, cut="__cut"), "source_name", "full_text", taxonomy).withColumn("c", kind)
    out = out.withColumns({"classification_scores": F.col("c.scores"), "matched_markers": F.col("c.markers"), "text_length": F.length("full_text"), "text_preview": F.left(F.translate("full_text", "\n", " "), F.lit(300))}).drop("c")
    routed = [("payslip", payslip_fields()), ("employment_letter", employment_fields()), ("bank_statement", bank_fields(F.col("__ends"))), ("gift_letter", gift_fields())]
    as_map = lambda fs: F.map_filter(F.create_map(*[x for k, v in fs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    scalar = F.map_filter(F.transform_values("named_fields", lambda _, v: F.when(F.size(v) == 1, F.get(v, 0))), lambda _, v: v.isNotNull())
    key_fields = None
    for name, fs in routed:
        key_fields = F.when(F.col("doc_type") == name, as_map(fs)) if key_fields is None else key_fields.when(F.col("doc_type") == name, as_map(fs))
    rows = _ledger_rows(F.col("__cut"))
    out = out.withColumn("transactions", F.when(F.col("doc_type") == "bank_statement", rows).otherwise(F.array().cast(ledger.TRANSACTIONS))).drop("__cut")
    if not parity:
        out = out.withColumn("transactions", rederived_sides(F.col("transactions")))
    out = out.withColumn("__ends", F.when(F.col("doc_type") == "bank_statement", ledger_ends(F.col("transactions")))).withColumn("key_fields", key_fields.otherwise(scalar)).drop("__ends")
    if not parity:
        extra = F.map_filter(F.create_map(F.lit("pf"), F.col("key_fields")["epf_contribution"], F.lit("ifsc_code"), F.col("key_fields")["ifsc"], F.lit("total_credits"), F.col("key_fields")["credit_total"], F.lit("total_debits"), F.col("key_fields")["debit_total"]), lambda _, v: v.isNotNull())
        only_new = F.map_filter(extra, lambda k, _: ~F.map_contains_key("key_fields", k))
        out = out.withColumn("key_fields", F.map_concat("key_fields", only_new))
    title = F.get(F.filter("line_list", lambda x: (F.length(x) > 10) & ~x.rlike(r"^[*\-= ]+$")), 0)
    slip_title = F.get(F.filter("line_list", lambda x: F.lower(x).contains("payslip for the month of")), 0)
    return out.withColumns({"issuer": F.get("line_list", 0), "title": F.when(F.col("doc_type") == "payslip", F.coalesce(slip_title, title)).otherwise(title), "line_count": F.size("line_list"), "dates": candidate_dates(F.col("full_text"))})


def breakdown(key_fields: Column, names: list[str]) -> Column:
    """X17."""
    return F.map_filter(key_fields, lambda k, _: k.isin(*names))


def case_key(doc_type: Column, key_fields: Column, source_name: Column) -> Column:
    """X35."""
    who = X.first_filled(*[key_fields[k] for k in ("employee_id", "employee_name", "issuer_name", "account_number")])
    stem = F.regexp_replace(source_name, r"\.[^.]*$", "")
    return F.concat_ws("::", doc_type, F.replace(F.lower(F.trim(F.coalesce(who, stem))), F.lit(" "), F.lit("_")))


def bulk_row(df: DataFrame) -> DataFrame:
    """X36."""
    k = F.col("key_fields")
    who = X.first_filled(k["employee_name"], k["account_holder"], k["insured_name"], k["patient_name"])
    amount = X.first_filled(k["net_pay"], k["closing_balance"], k["annual_ctc"], k["gift_amount"])
    return df.select("doc_id", "source_name", "doc_type", F.left(who, F.lit(25)).alias("principal"), X.parse_amount(amount).alias("key_amount"), "truth_score", "risk_level", F.round(F.col("type_confidence") * 100).cast("int").alias("confidence_pct"))


def json_reply(reply: Column, aliases: dict[str, list[str]]) -> Column:
    """Fields of a model's reply: the outermost braces, the first candidate object that has an alias."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    blank = lambda v: F.when(~F.lower(F.trim(v)).isin("null", "none", "n/a", "na", "nil", ""), F.trim(v))
    pick = lambda names: F.coalesce(*[blank(F.get_json_object(body, f"$.{root}{n}")) for root in ("result.", "data.", "fields.", "") for n in names])
    return F.struct(*[pick(names).alias(k) for k, names in aliases.items()])


def merged_sources(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """a's field where it is filled, else b's, with the source of each."""
    joined = a.alias("a").join(b.alias("b"), key, "full_outer")
    one = lambda f: X.first_filled(F.col(f"a.{f}"), F.col(f"b.{f}"))
    source = lambda f: F.when(X.blank_to_null(F.col(f"a.{f}")).isNotNull(), "a").when(X.blank_to_null(F.col(f"b.{f}")).isNotNull(), "b")
    made = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), source(f))]), lambda _, v: v.isNotNull())
    return joined.select(key, *[one(f).alias(f) for f in fields], made.alias("field_sources"))


def qr_payload(v: Column) -> Column:
    """Attributes of an identity code's XML, or its kind."""
    at = lambda n: X.blank_to_null(F.regexp_extract(v, rf'\b{n}="([^"]*)"', 1))
    names = ["name", "dob", "yob", "gender", "uid", "co", "vtc", "dist", "state", "pc"]
    xml = F.trim(v).startswith("<")
    return F.struct(F.when(xml, "xml").otherwise("secure").alias("kind"), *[F.when(xml, at(n)).alias(n) for n in names])
