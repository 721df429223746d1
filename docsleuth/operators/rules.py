"""Validation rules as column expressions.

A rule is a nullable signal struct: null where it does not apply. A pack is a list of rules over the columns
`key_fields` (map), `doc_type`, and for banks `transactions`; all packs together are one projection without join
or shuffle. Users add packs with register_pack().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.functions import fixed
from docsleuth.functions import scalars as X
from docsleuth.operators import ledger

SIGNAL = "struct<name:string,severity:string,score:int,summary:string,passed:boolean,details:map<string,string>>"
FAILURE = "struct<name:string,severity:string,score:int>"


@dataclass(frozen=True)
class Rule:
    """A rule as the signal it gives, and as its score alone, which is all that risk needs: null where it doesn't apply. Also what it says where it fails, without message or details."""

    signal: Column
    score: Column
    failure: Column

    def where(self, gate: Column) -> Rule:
        return Rule(F.when(gate, self.signal), F.when(gate, self.score), F.when(gate, self.failure))


#: What packs ask of key_fields, by the name of the column that holds it: with_fields() computes each once a row.
_TEXTS: dict[str, tuple[str, ...]] = {}
_NUMBERS: dict[str, tuple[str, ...]] = {}


def text(*keys: str) -> Column:
    """The first key with a value that isn't empty."""
    name = f"__text {'|'.join(keys)}"
    _TEXTS[name] = keys
    return F.col(f"`{name}`")


def num(*keys: str) -> Column:
    """The number of the first key with a value that isn't empty."""
    name = f"__number {'|'.join(keys)}"
    _NUMBERS[name] = keys
    return F.col(f"`{name}`")


def with_fields(df: DataFrame) -> DataFrame:
    """df with the columns that the packs built so far refer to; the optimiser leaves out those that a query doesn't use."""
    at = lambda k: F.col("key_fields")[k]
    # several keys are looked up once each; as nested conditions they'd be looked up twice, in code too long for the JVM to compile
    first = lambda keys: X.blank_to_null(at(keys[0])) if len(keys) == 1 else F.get(F.filter(F.array(*map(at, keys)), lambda v: v != ""), 0)
    # one key's number is that of any value, several keys' that of the first filled one: an empty value has none either way
    number = lambda keys: X.parse_amount(at(keys[0]) if len(keys) == 1 else first(keys))
    # a statement brings the findings of its ledger as a column, or else the ledger itself
    found = F.col("ledger_findings") if "ledger_findings" in df.columns else ledger.findings_of(F.col("transactions")) if "transactions" in df.columns else F.lit(None).cast(ledger.FINDINGS)
    return df.withColumns({n: first(k) for n, k in _TEXTS.items()} | {n: number(k) for n, k in _NUMBERS.items()} | {"__ledger": found})


def without_fields(df: DataFrame) -> DataFrame:
    return df.drop(*_TEXTS, *_NUMBERS, "__ledger")


def signal(name: str, applies: Column, passed: Column, severity: Column | str, score: Column | int, summary: str, **details: Column) -> Rule:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    score = F.lit(score) if isinstance(score, int) else score
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    found = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    made = F.struct(
        F.lit(name).alias("name"),
        F.when(passed, F.lit("info")).otherwise(severity).alias("severity"),
        F.when(passed, F.lit(0)).otherwise(score).cast("int").alias("score"),
        F.lit(summary).alias("summary"),
        passed.alias("passed"),
        found.alias("details"),
    )
    failed = F.struct(F.lit(name).alias("name"), severity.alias("severity"), score.cast("int").alias("score")).cast(FAILURE)
    return Rule(made, F.when(passed, F.lit(0)).otherwise(score).cast("int"), F.when(~passed, failed)).where(applies)


def only_failure(name: str, fails: Column, severity: Column | str, score: Column | int, summary: str, **details: Column) -> Rule:
    return signal(name, fails, F.lit(False), severity, score, summary, **details)


def whole(x: Column) -> Column:
    """Truncated toward zero."""
    return x.cast("bigint")


def required(fields: list[str]) -> Rule:
    """R01."""
    missing = F.array_compact(F.array(*[F.when(text(f).isNull(), F.lit(f)) for f in fields]))
    return signal("required_fields_present", F.lit(True), F.size(missing) == 0, "medium", F.least(F.lit(30), 8 * F.size(missing)), "Required fields are present.", missing=F.array_join(missing, ","))


def _gross_net(score_name: str = "gross_gte_net_pay") -> Rule:
    g, n = num("gross_earnings", "gross_salary", "gross"), num("net_pay", "net_salary")
    return signal(score_name, g.isNotNull() & n.isNotNull(), (g >= n) & (n > 0), "high", 55, "Gross is at least net pay.", gross=g, net=n)


def _uan(severity: str, score: int) -> Rule:
    u = text("uan")
    return signal("uan_format", u.isNotNull(), F.length(F.regexp_replace(u, "[^0-9]", "")) == 12, severity, score, "UAN has twelve digits.", uan=u)


def _paid_days(severity: str, score: int) -> Rule:
    d = num("paid_days")
    return signal("paid_days_range", d.isNotNull(), d.between(0, 31), severity, score, "Paid days lie in a month.", paid_days=d)


def payroll() -> list[Rule]:
    """R01-R06."""
    g, n, b = num("gross_earnings"), num("net_pay"), num("basic")
    return [
        required(["employee_name", "employee_id", "gross_earnings", "net_pay"]),
        _gross_net(),
        only_failure("net_pay_zero_with_positive_gross", (g > 5000) & (n == 0), "high", 50, "Net pay is zero while gross is not.", gross=g),
        _uan("low", 5),
        _paid_days("medium", 20),
        signal("basic_minimum_proportion", (g > 0) & b.isNotNull(), F.try_divide(b, g) >= 0.20, "medium", 15, "Basic pay is at least a fifth of gross.", basic=b, gross=g),
    ]


def _balance(severity: str = "high", score: int = 60) -> Rule:
    o, c, d, e = num("opening_balance"), num("total_credits"), num("total_debits"), num("closing_balance")
    delta = F.abs(o + c - d - e)
    tolerance = F.greatest(F.lit(10).cast("bigint"), whole(F.abs(e) * 0.01))
    return signal("balance_arithmetic", o.isNotNull() & c.isNotNull() & d.isNotNull() & e.isNotNull(), delta <= tolerance, severity, score, "Opening balance, totals and closing balance agree.", delta=delta)


def _ledger_rules() -> list[Rule]:
    """R10-R12, R38-R40 over what is known of a statement's ledger: findings of its array, or of a table of rows (ledger.findings)."""
    f = F.col("__ledger")
    filled = f["n_rows"] > 0
    return [
        signal("circular_funds_detection", filled, f["pairs"] == 0, "high", 40, "No same-day round trips.", pairs=f["pairs"], evidence=f["evidence"]),
        signal("duplicate_txn_reference", filled & f["has_references"], f["repeated_references"] == 0, "high", 35, "Transaction references are unique.", references=f["references"]),
        signal("salary_credit_regularity", f["has_salary"], f["repeated_months"] == 0, "medium", 20, "One salary credit a month.", months=f["months"]),
    ]


def banking() -> list[Rule]:
    """R07-R12."""
    i, c = text("ifsc_code", "ifsc"), num("closing_balance")
    return [
        required(["account_number", "statement_period"]),
        _balance(),
        signal("ifsc_format", i.isNotNull(), F.upper(i).rlike(fixed.IFSC), "low", 5, "IFSC has its format.", ifsc=i),
        only_failure("overdraft_flag", c < 0, "low", 5, "Closing balance is negative.", closing=c),
        *_ledger_rules(),
    ]


def payments() -> list[Rule]:
    """R13-R15."""
    a, u, r = num("amount"), text("upi_id"), F.coalesce(F.col("key_fields")["transaction_id"], F.col("key_fields")["reference_number"])
    return [
        required(["transaction_id", "amount", "payment_date"]),
        signal("amount_positive", a.isNotNull(), a > 0, "high", 50, "Amount is positive.", amount=a),
        signal("upi_id_format", u.isNotNull(), u.rlike(fixed.UPI), "low", 5, "UPI id has its format.", upi_id=u),
        signal("transaction_ref_not_empty", r.isNotNull(), F.trim(r) != "", "medium", 25, "There is a transaction reference."),
    ]


def insurance() -> list[Rule]:
    """R16-R17."""
    p, c = F.col("key_fields")["policy_number"], num("claim_amount", "sum_insured")
    return [
        required(["policy_number", "insured_name", "insurer_name"]),
        signal("policy_number_format", p.isNotNull(), F.length(F.regexp_replace(p, r"\s", "")) >= 6, "medium", 20, "Policy number is long enough.", policy_number=p),
        signal("claim_amount_positive", c.isNotNull(), c > 0, "high", 40, "Claim amount is positive.", amount=c),
    ]


def healthcare() -> list[Rule]:
    """R18-R19."""
    s, x, t, p = num("subtotal"), num("taxes"), num("total"), F.col("key_fields")["patient_id"]
    delta = F.abs(s + x - t)
    return [
        required(["patient_name", "provider_name", "visit_date"]),
        signal("bill_arithmetic", s.isNotNull() & x.isNotNull() & t.isNotNull(), delta <= F.greatest(F.lit(5).cast("bigint"), whole(F.abs(t) * 0.005)), "high", 50, "Subtotal and taxes make the total.", delta=delta),
        signal("patient_id_not_empty", p.isNotNull(), F.trim(p) != "", "low", 5, "There is a patient id."),
    ]


def invoice() -> list[Rule]:
    """R20-R21."""
    s, x, t, g = num("subtotal"), num("tax_amount"), num("amount_due"), text("gstin", "gst_number")
    return [
        required(["invoice_number", "amount_due"]),
        signal("invoice_amount_arithmetic", s.isNotNull() & x.isNotNull() & t.isNotNull(), F.abs(s + x - t) <= 2, "high", 50, "Subtotal and tax make the amount due.", delta=F.abs(s + x - t)),
        signal("gstin_format", g.isNotNull(), F.upper(g).rlike(fixed.GSTIN), "medium", 15, "GSTIN has its format.", gstin=g),
    ]


def compliance(as_of: Column) -> list[Rule]:
    """R22-R23."""
    d, p = F.try_to_timestamp(text("report_date")).cast("date"), F.coalesce(F.col("key_fields")["audit_period"], F.col("key_fields")["coverage_period"])
    return [
        required(["report_title", "auditor_name", "report_date"]),
        signal("date_not_future", d.isNotNull(), d <= as_of, "medium", 20, "Report date is not in the future.", report_date=d),
        signal("period_present", p.isNotNull(), F.trim(p) != "", "low", 5, "There is a period."),
    ]


def mortgage_payslip() -> list[Rule]:
    """R24-R35."""
    g, n, b = num("gross_earnings", "gross_salary", "gross"), num("net_pay", "net_salary"), num("basic", "basic_salary")
    pf, pt, tds = num("pf", "provident_fund"), num("professional_tax"), num("tds", "income_tax")
    hra = num("hra", "house_rent_allowance")
    net_limit = g - pf - pt - F.coalesce(tds, F.lit(0).cast("bigint"))
    tolerance = F.greatest(F.lit(500.0), F.abs(g) * 0.02)
    excess = F.try_divide(hra, b) * 100 - 50
    basic_share = F.try_divide(b, g)
    return [
        _gross_net(),
        signal("basic_within_gross", g.isNotNull() & b.isNotNull(), (g >= b) & (b > 0), "high", 40, "Basic pay lies within gross.", gross=g, basic=b),
        signal("net_pay_arithmetic", g.isNotNull() & n.isNotNull() & pf.isNotNull() & pt.isNotNull(), n <= net_limit + tolerance, "critical", 60, "Net pay does not exceed gross less deductions.", net=n, limit=net_limit),
        signal("pf_rate_validity", pf.isNotNull() & (b > 0), F.try_divide(pf, b) <= 0.125, "medium", 15, "Provident fund is at most an eighth of basic.", pf=pf, basic=b),
        signal("pt_slab_validity", pt.isNotNull(), pt.between(0, 200), "medium", 15, "Professional tax lies in its slabs.", professional_tax=pt),
        signal("tds_plausibility", tds.isNotNull() & g.isNotNull(), ~((g * 12 > 700_000) & (tds == 0)), "medium", 20, "Tax is deducted above the threshold.", tds=tds, gross=g),
        signal("hra_proportion", hra.isNotNull() & (b > 0), F.try_divide(hra, b) <= 1.0, "medium", 15, "House rent allowance does not exceed basic.", hra=hra, basic=b),
        signal("basic_gross_proportion", (g > 0) & b.isNotNull(), basic_share.between(0.30, 0.55), "medium", 20, "Basic is a usual share of gross.", basic=b, gross=g),
        only_failure("hra_basic_proportion", hra.isNotNull() & (b > 0) & (F.try_divide(hra, b) > 0.55), F.when(excess > 15, "high").otherwise("medium"), F.when(excess > 30, 50).when(excess > 15, 35).otherwise(25), "House rent allowance is unusually large.", hra=hra, basic=b),
        _uan("medium", 15),
        _paid_days("medium", 15),
        only_failure("basic_minimum_proportion", (g > 0) & b.isNotNull() & (basic_share < 0.20), "medium", 20, "Basic is below a fifth of gross.", basic=b, gross=g),
    ]


def mortgage_bank() -> list[Rule]:
    """R36-R42."""
    ifsc, name = F.upper(text("ifsc", "ifsc_code")), F.upper(text("bank_name"))
    banks = F.create_map(*[x for k, v in fixed.IFSC_BANKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    expected = banks[F.substring(ifsc, 1, 4)]
    first, last = X.statement_date(text("earliest_transaction_date", "earliest_txn_date")), X.statement_date(text("latest_transaction_date", "latest_txn_date"))
    start, end = X.statement_date(text("period_from")), X.statement_date(text("period_to"))
    late, early = F.date_diff(first, start), F.date_diff(end, last)
    row, diff = F.col("__ledger")["error_row"], F.col("__ledger")["error_diff"]
    rounded = (diff >= 10_000) & (diff % 1000 == 0)
    return [
        _balance(),
        signal("bank_ifsc_bank_name_consistency", (F.length(ifsc) >= 4) & name.isNotNull() & expected.isNotNull(), F.exists(expected, lambda x: F.contains(name, x)), "high", 65, "IFSC and bank name belong together.", ifsc=ifsc, bank_name=name),
        *_ledger_rules(),
        signal("bank_statement_date_range", first.isNotNull() & last.isNotNull() & start.isNotNull() & end.isNotNull(), (late <= 20) & (early <= 20), "high", 65, "Transactions cover the stated period.", start_gap=late, end_gap=early),
        signal("bank_debit_credit_arithmetic", F.col("__ledger")["n_rows"] >= 2, row.isNull() | ~rounded, "critical", 65, "Running balances follow from debits and credits.", row=row, diff=diff),
    ]


def mortgage_employment(as_of: Column) -> list[Rule]:
    """R43-R47; nothing fires without a CIN, pay or joining date."""
    cin, ctc, gross = text("cin", "company_cin", "company_identification_number"), num("annual_ctc", "ctc"), num("gross_monthly_salary", "monthly_gross", "monthly_gross_salary")
    join_text = text("join_date", "date_of_joining")
    join, issue = X.employment_date(join_text), X.employment_date(text("letter_issue_date", "issue_date", "letter_date"))
    any_field = cin.isNotNull() | ctc.isNotNull() | gross.isNotNull() | join_text.isNotNull()
    valid = cin.rlike(fixed.CIN)
    year = F.regexp_extract(join_text, "((?:19|20)[0-9]{2})", 1).try_cast("int")
    born = F.substring(cin, 9, 4).try_cast("int")
    recent = F.date_diff(as_of, issue).between(0, int(12 * 30.44))
    gap = F.date_diff(issue, join) / 365.25
    guarded = [
        signal("employer_cin_format", cin.isNotNull(), valid, "high", 35, "CIN has its format.", cin=cin),
        only_failure("employer_cin_present", cin.isNull(), "high", 35, "CIN is missing."),
        signal("cin_age_vs_join_date", valid & year.isNotNull(), born <= year, "high", 30, "The employer existed at the joining date.", incorporated=born, joined=year),
        signal("ctc_monthly_gross_consistency", ctc.isNotNull() & gross.isNotNull(), F.abs(ctc / 12 - gross) <= F.greatest(F.lit(5000).cast("bigint"), whole(F.abs(ctc / 12) * 0.15)), "medium", 20, "Annual and monthly pay agree.", annual=ctc, monthly=gross),
        signal("employment_backdating_signal", join.isNotNull() & issue.isNotNull() & (issue > join), ~(recent & (gap >= 12)), "high", 40, "The joining date is not long before a recent letter.", years=F.round(gap, 1)),
    ]
    return [r.where(any_field) for r in guarded]


def mortgage_form16() -> list[Rule]:
    """R48-R49."""
    tan, gross, tds = text("tan", "tan_of_employer", "employer_tan"), num("gross_salary", "gross_salary_total", "gross_earnings"), num("tds", "tax_deducted_at_source_tds", "total_tds")
    return [
        signal("tan_format_validity", tan.isNotNull(), tan.rlike(fixed.TAN), "medium", 15, "TAN has its format.", tan=tan),
        signal("form16_tds_plausibility", (gross != 0) & tds.isNotNull(), ~((gross > 700_000) & (tds == 0)), "medium", 20, "Tax is deducted above the threshold.", gross=gross, tds=tds),
    ]


def mortgage_utility() -> list[Rule]:
    """R50."""
    a = num("amount", "bill_amount", "amount_due")
    return [signal("utility_amount_plausibility", a.isNotNull(), a.between(100, 20_000), "low", 10, "The bill has a usual size.", amount=a)]


def core() -> list[Rule]:
    """R51-R57; metadata, signature_markers and dates are columns of their own."""
    slip = F.col("doc_type").contains("payslip")
    g, d, n = num("gross_earnings"), num("total_deductions"), num("net_pay")
    words = text("net_pay_in_words")
    said = X.number_words(words)
    need = ["employee_id", "employee_name", "gross_earnings", "total_deductions", "net_pay"]
    missing = F.array_compact(F.array(*[F.when(text(f).isNull(), F.lit(f)) for f in need]))
    meta = F.col("metadata")
    made_by = F.lower(F.concat_ws(" ", meta["Producer"], meta["Creator"]))
    editor = F.coalesce(*[F.when(F.contains(made_by, F.lit(e)), F.lit(e)) for e in fixed.EDITORS])
    strict = F.col("doc_type").isin("payslip", "invoice", "bank_statement")
    statement = F.lower("doc_type").rlike("bank|loan|credit_card")
    stamp = lambda k: F.substring(F.regexp_replace(meta[k], "^D:", ""), 1, 14)
    created, changed = stamp("CreationDate"), stamp("ModDate")
    return [
        signal("gross_minus_deductions_equals_net_pay", slip & g.isNotNull() & d.isNotNull() & n.isNotNull(), g - d == n, "high", 65, "Gross less deductions is net pay.", gross=g, deductions=d, net=n),
        signal("amount_in_words_matches_net_pay", slip & words.isNotNull() & n.isNotNull(), F.coalesce(said == n, F.lit(False)), "medium", 40, "The amount in words is net pay.", words=words, parsed=said),
        signal("required_payslip_fields_present", slip, F.size(missing) == 0, "medium", F.least(F.lit(25), 5 * F.size(missing)), "Payslip fields are present.", missing=F.array_join(missing, ",")),
        signal("editor_software_mismatch", F.lit(True), editor.isNull(), "medium", F.when(strict, 35).otherwise(0), "No image editor made the file.", editor=editor),
        signal("digital_signature_markers_present", F.lit(True), F.size(F.coalesce("signature_markers", F.array().cast("array<string>"))) > 0, "info", 0, "The file has signature markers."),
        signal("unexpected_candidate_density", F.lit(True), (F.size(F.coalesce("dates", F.array().cast("array<string>"))) <= 5) | statement, "low", 10, "The number of dates is usual."),
        signal("metadata_date_consistency", (F.length(created) >= 14) & (F.length(changed) >= 14), changed >= created, "medium", 30, "The file was not changed before it was made.", created=created, changed=changed),
    ]


def image() -> list[Rule]:
    """R58-R64 over the columns of image_metrics; bands are (mild, failing)."""
    exif = F.col("exif")
    n_exif = F.coalesce(F.size(exif), F.lit(0))
    joined = F.lower(F.concat_ws(" ", F.map_values(exif)))
    tool = F.coalesce(*[F.when(F.contains(joined, F.lit(t)), F.lit(t)) for t in fixed.IMAGE_TOOLS])
    camera = F.exists(F.map_keys(exif), lambda k: k.isin(*fixed.CAMERA_KEYS))
    lossless = F.lower("source_name").rlike(r"\.(png|bmp)$")
    stamps = [exif[k] for k in ("EXIF DateTimeOriginal", "EXIF DateTimeDigitized", "Image DateTime")]
    count = sum(F.when(s.isNotNull(), 1).otherwise(0) for s in stamps)

    def band(name: str, value: str, mild: float, failing: float, severity: str, score: int, mild_score: int, at_least: bool = False) -> Rule:
        v = F.col(value)
        fails, soft = (v >= failing, v >= mild) if at_least else (v > failing, v > mild)
        made = signal(name, v.isNotNull(), ~fails, severity, score, f"{value} is in its usual range.", value=F.round(v, 3))
        # a mild value passes with a low severity and score
        mildly = ~fails & soft
        mild = made.signal.withField("severity", F.lit("low")).withField("score", F.lit(mild_score))
        return Rule(F.when(mildly, mild).otherwise(made.signal), F.when(mildly, mild_score).otherwise(made.score), made.failure).where(v.isNotNull())

    return [
        signal("image_suspicious_authoring_tool", F.lit(True), tool.isNull(), "high", 45, "No editing tool in the image's metadata.", tool=tool),
        signal("image_missing_camera_exif", (n_exif > 0) & ~lossless, F.coalesce(camera, F.lit(False)), "low", 10, "The camera is named."),
        signal("image_timestamp_inconsistency", count >= 2, F.coalesce(stamps[0] <= F.coalesce(stamps[1], stamps[2]), F.lit(True)) & F.coalesce(stamps[1] <= stamps[2], F.lit(True)), "medium", 25, "The image's times are in order."),
        band("image_ela_tampering_score", "ela_score", 8, 20, "high", 40, 15, at_least=True),
        band("image_noise_inconsistency", "noise_cv", 0.8, 1.5, "medium", 25, 10),
        band("image_copy_move_detection", "copy_move_score", 10, 35, "high", 35, 12),
        band("image_gan_ai_generation_score", "gan_score", 20, 55, "high", 30, 10),
    ]


def _mortgage(as_of: Column, types: list[str], combine: Callable[[list[Rule]], Column]) -> Column:
    """Sub-routing by the type's text; a type that names none of them gets all but the utility rules. Only rules that types may get are in the plan."""
    t = F.col("doc_type")
    names = {"payslip": ("payslip",), "bank": ("bank",), "employment": ("employment",), "form16": ("form16", "tds"), "utility": ("utility",)}
    kinds = lambda x: [k for k, ws in names.items() if any(w in x for w in ws)]
    hit = {k: F.lit(False) for k in names}
    for k, ws in names.items():
        for w in ws:
            hit[k] = t.contains(w) if w == ws[0] else hit[k] | t.contains(w)
    everything = any(not kinds(x) for x in types)
    rest = ~(hit["payslip"] | hit["bank"] | hit["employment"] | hit["form16"] | hit["utility"])
    packs = {"payslip": mortgage_payslip, "bank": mortgage_bank, "employment": lambda: mortgage_employment(as_of), "form16": mortgage_form16, "utility": mortgage_utility}
    # a rule stands once in the plan, behind the types that it is for
    gated = []
    for k, pack in packs.items():
        named = any(k in kinds(x) for x in types)
        if named or everything and k != "utility":
            gate = hit[k] if not everything or k == "utility" else rest | hit[k]
            gated += [r if len(types) == 1 else r.where(gate) for r in pack()]
    return combine(gated)


def fired(rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*[r.signal for r in rules])).cast(f"array<{SIGNAL}>")


def failures(rules: list[Rule]) -> Column:
    """What the rules say where they fail; null for each of the others. A plain array, so that Spark compiles the rules: below a lambda it would interpret them."""
    return F.array(*[r.failure for r in rules])


def points(rules: list[Rule]) -> Column:
    """The sum of the rules' scores, without building their signals."""
    total = F.lit(0)
    for r in rules:
        total = total + F.coalesce(r.score, F.lit(0))
    return total


_USER_PACKS: dict[str, Callable[[], list[Rule]]] = {}


def register_pack(doc_type: str, pack: Callable[[], list[Rule]]) -> None:
    """Rules for a type of the user's, or in place of the library's own; no new job is needed."""
    _USER_PACKS[doc_type] = pack


MORTGAGE_TYPES = ["mortgage", "mortgage_payslip", "mortgage_bank_statement", "employment_letter", "form16", "utility_bill", "gift_letter", "property_agreement", "payslip", "bank_statement"]


_BUILT: dict[tuple, Column] = {}


def built_once(name: str, make: Callable[[], Column]) -> Column:
    """A pack's expression, kept for the life of the JVM: building hundreds of nodes from Python takes longer than planning them."""
    key = (name, id(SparkSession.active()._jvm), tuple(_USER_PACKS.items()))
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def domain_signals(as_of: Column | None = None, types: list[str] | None = None) -> Column:
    """The rules of each row's type; types without a pack get none. types: those that occur, where they are known; other rows then get none."""
    as_of = F.current_date() if as_of is None else as_of
    return built_once(f"domain {as_of} {types}", lambda: _domain(as_of, types, fired, F.array().cast(f"array<{SIGNAL}>")))


def domain_points(as_of: Column | None = None, types: list[str] | None = None) -> Column:
    """The sum of those signals' scores."""
    as_of = F.current_date() if as_of is None else as_of
    return built_once(f"points {as_of} {types}", lambda: _domain(as_of, types, points, F.lit(0)))


def domain_failures(as_of: Column | None = None, types: list[str] | None = None) -> Column:
    """Of those signals the failed ones' names, severities and scores, among nulls."""
    as_of = F.current_date() if as_of is None else as_of
    return built_once(f"failures {as_of} {types}", lambda: _domain(as_of, types, failures, F.array().cast(f"array<{FAILURE}>")))


def _domain(as_of: Column, types: list[str] | None, combine: Callable[[list[Rule]], Column], out: Column) -> Column:
    t = F.col("doc_type")
    wanted = lambda k: types is None or k in types
    packs: dict[str, Column] = {k: combine(p()) for k, p in _USER_PACKS.items() if wanted(k)}
    own: dict[str, Callable[[], list[Rule]]] = {"payment_receipt": payments, "insurance": insurance, "healthcare": healthcare, "invoice": invoice, "compliance": lambda: compliance(as_of)}
    packs |= {k: combine(rules()) for k, rules in own.items() if wanted(k) and k not in packs}
    routed = [k for k in MORTGAGE_TYPES if wanted(k) and k not in packs]
    choices = [(t == k, made) for k, made in packs.items()] + ([(t.isin(*routed), _mortgage(as_of, routed, combine))] if routed else [])
    for hit, made in reversed(choices):
        out = F.when(hit, made).otherwise(out)
    return out


def assess(df: DataFrame, as_of: Column | None = None, with_image: bool = False, types: list[str] | None = None, with_signals: bool = True) -> DataFrame:
    """Signals, risk_score, truth_score, risk_level, verdict for summaries with the columns named in this module. types: see domain_signals().

    Without signals the scores are summed straight from the rules, so no signal, message or detail is built.
    """
    if not with_signals:
        total = built_once("core points", lambda: points(core())) + domain_points(as_of, types) + (points(image()) if with_image else F.lit(0))
        return _banded(without_fields(with_fields(df).withColumn("risk_score", total)))
    named = F.transform(domain_signals(as_of, types), lambda s: s.withField("name", F.concat(F.lit("domain::"), s["name"])))
    parts = [built_once("core", lambda: fired(core())), named, *([fired(image())] if with_image else [])]
    return scored(without_fields(with_fields(df).withColumn("signals", F.concat(*parts))))


def assess_failures(df: DataFrame, as_of: Column | None = None, types: list[str] | None = None) -> DataFrame:
    """The scores of assess(), and the column failures in place of signals: names, severities and scores of the failed rules, without messages or details."""
    core_failures = built_once("core failures", lambda: failures(core()))
    total = built_once("core points", lambda: points(core())) + domain_points(as_of, types)
    # columns of their own, so that rules are compiled: below a lambda Spark would interpret them
    made = {"__core": core_failures, "__domain": domain_failures(as_of, types), "risk_score": total}
    out = with_fields(df).withColumns(made)
    named = F.transform("__domain", lambda s: s.withField("name", F.concat(F.lit("domain::"), s["name"])))
    return _banded(without_fields(out.withColumn("failures", F.array_compact(F.concat("__core", named))).drop("__core", "__domain")))


def scored(df: DataFrame) -> DataFrame:
    """Scores add up; the bands are 25 and 60."""
    return _banded(df.withColumn("risk_score", F.aggregate("signals", F.lit(0), lambda a, s: a + s["score"])))


def _banded(df: DataFrame) -> DataFrame:
    df = df.withColumn("truth_score", F.greatest(F.lit(0), 100 - F.col("risk_score")))
    level = F.when(F.col("risk_score") >= 60, "high").when(F.col("risk_score") >= 25, "medium").otherwise("low")
    verdict = F.when(F.col("risk_score") >= 60, "suspicious_inconsistency").when(F.col("risk_score") >= 25, "review_recommended").otherwise("no_obvious_tampering")
    return df.withColumns({"risk_level": level, "verdict": verdict})


def rule_rollup(df: DataFrame) -> DataFrame:
    """How often each rule fired and failed."""
    # an inner explode would also filter on the array's size, which evaluates every rule a second time
    one = df.select(F.explode_outer("signals").alias("s")).where("s is not null")
    return one.groupBy(F.col("s.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("s.passed")).alias("failed"), F.sum("s.score").alias("total_score"))


def failed_signals(df: DataFrame) -> DataFrame:
    """Failed signals, exploded."""
    return df.select(*[c for c in df.columns if c != "signals"], F.explode(F.filter("signals", lambda s: ~s["passed"])).alias("signal"))


def failed(df: DataFrame, found: Column) -> DataFrame:
    """a row for each failure among failures() or domain_failures(), as the column signal, without messages or details."""
    # an inner explode would also filter on the array's size
    return without_fields(with_fields(df).withColumn("signal", F.explode_outer(found)).where("signal is not null"))


def ela_verdict(score: Column, fallback: Column) -> Column:
    """The layer's word for a stored score."""
    return F.when(fallback, F.lit(None).cast("string")).when(score.isNull(), "N/A").when(score >= 20, "SUSPECT").when(score >= 8, "REVIEW").otherwise("CLEAN")


def pan_layer(tamper: Column, valid: Column, read: Column) -> Column:
    """Floor of the mean of what is known, and its level."""
    known = F.array_compact(F.array(tamper.cast("int"), F.when(valid, 100), F.when(read, 80)))
    score = F.floor(F.try_divide(F.aggregate(known, F.lit(0), lambda a, x: a + x), F.size(known))).cast("int")
    return F.struct(score.alias("score"), F.when(score.isNull(), "UNKNOWN").when(score >= 75, "LOW").when(score >= 50, "MEDIUM").otherwise("HIGH").alias("level"))
