"""Word lists, patterns and thresholds that results depend on, in natural order."""

DOC_TYPES = [
    ("payslip", ["payslip", "salary slip", "employee pay summary", "gross earnings", "net pay"]),
    ("invoice", ["invoice", "bill to", "invoice number", "amount due"]),
    ("receipt", ["receipt", "receipt number", "payment received"]),
    ("bank_statement", ["bank statement", "closing balance", "statement period"]),
    ("payment_receipt", ["upi", "neft", "rtgs", "transaction id", "payment receipt", "utr number"]),
    ("insurance", ["policy number", "insured name", "sum insured", "premium", "insurance certificate"]),
    ("healthcare", ["patient name", "discharge summary", "diagnosis", "hospital invoice", "uhid"]),
    ("compliance", ["audit report", "compliance certificate", "board resolution", "kyc", "aml declaration"]),
    ("employment_letter", ["to whomsoever it may concern", "employment letter", "date of joining", "company identification number", "cin", "hr department", "employment verification"]),
    ("form16", ["form 16", "form-16", "tds certificate", "certificate of tax deducted", "assessment year", "tan of employer", "section 203"]),
    ("utility_bill", ["electricity bill", "utility bill", "consumer number", "units consumed", "kwh", "electricity duty", "msedcl", "bescom", "tangedco", "best electricity"]),
    ("gift_letter", ["gift declaration", "gift letter", "hereby declare", "amount is a gift", "not a loan", "down payment gift"]),
    ("property_agreement", ["agreement for sale", "sale agreement", "sale deed", "sale consideration", "vendor", "purchaser", "property address", "rera"]),
    ("mortgage", ["home loan", "mortgage", "loan application", "loan against property", "property documents", "loan to value"]),
    ("generic", []),
]
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
NUMBER_SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
EDITORS = ["photoshop", "illustrator", "canva", "gimp", "coreldraw", "inkscape"]
IMAGE_TOOLS = [
    "photoshop", "adobe photoshop", "lightroom", "illustrator", "gimp", "inkscape", "canva", "coreldraw", "paintshop", "affinity",
    "fotor", "pixlr", "snapseed", "vsco", "snapedit", "remove.bg", "stable diffusion", "midjourney", "dall-e", "dall·e",
    "firefly", "imagemagick", "paint.net", "microsoft paint", "screenshot", "camscanner", "pdf24", "smallpdf", "ilovepdf",
]
CAMERA_KEYS = ["Image Make", "Image Model", "EXIF LensModel", "Make", "Model", "LensModel", "ExifIFD"]
PAYSLIP_FIELDS = {
    "employee_id": ["employee_id"],
    "employee_name": ["employee_name"],
    "designation": ["designation"],
    "date_of_joining": ["date_of_joining"],
    "pay_date": ["pay_date"],
    "paid_days": ["paid_days"],
    "lop_days": ["lop_days"],
    "uan": ["uan"],
    "pan": ["pan"],
    "bank": ["bank"],
    "basic": ["basic", "basic_salary"],
    "house_rent_allowance": ["house_rent_allowance"],
    "fixed_bonus": ["fixed_bonus"],
    "other_allowances": ["other_allowances"],
    "advance_or_arrears": ["advance_or_arrears_or_notice_pay", "advance_or_arrears"],
    "gross_earnings": ["gross_earnings"],
    "net_pay": ["net_pay", "net_pay_take_home", "net_salary"],
    "total_deductions": ["total_deductions"],
    "epf_contribution": ["epf_contribution", "provident_fund_emp", "provident_fund", "pf_emp"],
    "income_tax": ["income_tax", "income_tax_tds"],
    "professional_tax": ["professional_tax"],
    "other_deductions": ["other_deductions"],
}
MONEY_LABELS = ["amount", "pay", "gross", "net", "bonus", "allowance", "tax", "deduction", "contribution", "salary", "arrears", "earnings"]
IDENTIFIER_LABELS = ["id", "uan", "account", "reference", "number"]
CREDIT_WORDS = ["credit", "interest", "refund", "gift", "inward", "reversal", "cashback", "dividend", "proceeds"]
SALARY_WORDS = ["salary", "sal cr", "neft sal"]
IFSC_BANKS = {
    "HDFC": ["HDFC"],
    "ICIC": ["ICICI"],
    "SBIN": ["SBI", "STATE BANK"],
    "PUNB": ["PNB", "PUNJAB NATIONAL"],
    "UBIN": ["UNION BANK"],
    "CNRB": ["CANARA"],
    "BARB": ["BANK OF BARODA", "BARODA"],
    "BKID": ["BANK OF INDIA"],
    "UTIB": ["AXIS"],
    "KKBK": ["KOTAK"],
    "IDFB": ["IDFC"],
    "INDB": ["INDUSIND"],
    "YESB": ["YES BANK", "YES"],
}
PAN_ENTITIES = {
    "P": "Individual",
    "C": "Company",
    "H": "Hindu Undivided Family",
    "F": "Firm",
    "A": "Association of Persons",
    "T": "Trust / AOP",
    "B": "Body of Individuals",
    "L": "Local Authority",
    "J": "Artificial Juridical Person",
    "G": "Government",
}
IFSC = "^[A-Z]{4}0[A-Z0-9]{6}$"
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]$"
CIN = "(?i)^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{2,4}[0-9]{6}$"
TAN = "(?i)^[A-Z]{4}[0-9]{5}[A-Z]$"
UPI = "^[a-zA-Z0-9.\\-_+]+@[a-zA-Z0-9]+$"
GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"
RISK_RANK = {"low": 0, "medium": 1, "high": 2}

# What letters and statements say, as patterns of running text, and the labels of a statement's balances.
CIN_IN_TEXT = r"(?i)\bCIN[:\s]+([LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{2,4}[0-9]{6})\b"
ANNUAL_CTC = r"(?i)(?:ctc|cost.{0,30}?company)[^0-9\n]{0,40}?([0-9][0-9,]+)\s+per\s+annum"
GROSS_MONTHLY = r"(?i)gross\s+monthly[^0-9\n]{0,20}?([0-9][0-9,]+)"
JOINING_DATE = r"(?i)(?:with\s+effect\s+from|date\s+of\s+joining|joining\s+date|joining\s+from)\s+([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}|[0-9]{1,2}[/-][A-Za-z0-9]+[/-][0-9]{4})"
ISSUE_DATE = r"(?:^|\n)\s*[Dd]ated?\s*[:\-]\s*([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})"
EMPLOYEE_NAME = r"(?:certify\s+that|employee\s+name\s*[:\-])\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})[\s,.]"
STATEMENT_PERIOD = r"(?i)([0-9]{1,2}[/-][A-Za-z0-9]+[/-][0-9]{4})\s+to\s+([0-9]{1,2}[/-][A-Za-z0-9]+[/-][0-9]{4})"
IFSC_IN_TEXT = r"(?i)\b([A-Z]{4}0[A-Z0-9]{6})\b"
MASKED_ACCOUNT = r"\b((?:X{4}\s?){2}[0-9]{4})\b"
OPENING_LABELS = ["opening_balance", "opening_bal", "balance_bf", "balance_brought_forward"]
CLOSING_LABELS = ["closing_balance", "closing_bal", "balance_cf", "balance_carried_forward"]
GIFT_AMOUNT = r"(?i)(?:gifted?\s+a?\s*sum\s+of|gift\s+(?:amount|of))[^0-9\n]{0,30}?([0-9][0-9,]+)"
PROPERTY_VALUE = r"(?i)property\s+value\s+is[^0-9\n]{0,20}?([0-9][0-9,]+)"
DONOR_PAN = r"\bPAN\s*[:\-]\s*([A-Z]{5}[0-9]{4}[A-Z])\b"
LETTER_DATE = r"[Dd]ate\s*[:\-]\s*([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})"
