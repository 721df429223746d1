"""Explicit schemas of every table; nothing is inferred."""

SIGNAL = "struct<name:string,severity:string,score:int,summary:string,passed:boolean,details:map<string,string>>"
RAW = "pages array<struct<page:int,text:string>>"
LOG = "ts string, level string, logger string, module string, func string, line int, msg string, exc string, elapsed_ms double"
LABELS = "case_id string, name string, city string, employer string, annual_ctc bigint, property_value bigint, loan_amount bigint, is_tampered boolean, tamper_types string"
STRUCTURED = "document struct<type:string,confidence:double>, source struct<name:string,path:string>, key_fields map<string,string>, named_fields map<string,array<string>>"
TABLES = {
    "entities": "id bigint, entity_ref string, first_name string, last_name string, pan string, aadhaar string, email string, phone string, created_at timestamp, updated_at timestamp",
    "scans": "id bigint, entity_ref string, source_name string, document_type string, risk_level string, truth_score int, verdict string, generated_at timestamp, report_json string, pdf_report binary",
    "cases": "case_key string, status string, disposition string, priority string, assignee string, labels array<string>, updated_at timestamp",
    "case_notes": "case_key string, note string, author string, created_at timestamp",
    "document_information": "scan_id bigint, entity_ref string, document_type string, fields map<string,string>, created_at timestamp",
    "identity_checks": "id bigint, entity_ref string, check_type string, status string, verdict string, score double, created_at timestamp",
    "layered_analysis_entries": "entity_ref string, screen string, section string, status string, details string, updated_at timestamp",
}
#: The column that a preview of each table is ordered by.
NEWEST = {"entities": "id", "scans": "generated_at", "cases": "updated_at", "case_notes": "created_at", "document_information": "created_at", "identity_checks": "id", "layered_analysis_entries": "updated_at"}
