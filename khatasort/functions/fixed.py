"""What results depend on, stated as they are, in their natural order.  Nothing here is computed.

The keyword rules, commercial words and directory keys are files of ``data``: see ``vocabulary``.
"""

# --- categories, in taxonomy order
CATEGORIES = ("GROCERIES", "FOOD_AND_DINING", "SHOPPING", "BILLS_AND_UTILITIES", "MOBILE_AND_INTERNET", "TRANSPORT", "HEALTH", "ENTERTAINMENT", "TRAVEL", "FINANCE", "EDUCATION", "PERSONAL_TRANSFER", "INCOME", "OTHER")
# --- deciding layers, in order of authority, and those that identify a merchant
SOURCES = ("USER_OVERRIDE", "EXACT_MERCHANT", "RULE", "FUZZY_MATCH", "TXN_TYPE", "ML_MODEL", "SEMANTIC", "FALLBACK")
IDENTITY_SOURCES = ("EXACT_MERCHANT", "RULE", "FUZZY_MATCH")
# --- short names that older data carry
TO_LEGACY = {
    "GROCERIES": "food", "FOOD_AND_DINING": "food", "SHOPPING": "shopping", "BILLS_AND_UTILITIES": "bills", "MOBILE_AND_INTERNET": "bills", "TRANSPORT": "transport", "HEALTH": "health",
    "ENTERTAINMENT": "ent", "TRAVEL": "transport", "FINANCE": "bills", "EDUCATION": "edu", "PERSONAL_TRANSFER": "contact", "INCOME": "income", "OTHER": "Other",
}
FROM_LEGACY = {
    "food": "FOOD_AND_DINING", "groceries": "GROCERIES", "grocery": "GROCERIES", "transport": "TRANSPORT", "travel": "TRAVEL", "shopping": "SHOPPING", "bills": "BILLS_AND_UTILITIES",
    "mobile": "MOBILE_AND_INTERNET", "ent": "ENTERTAINMENT", "entertainment": "ENTERTAINMENT", "health": "HEALTH", "finance": "FINANCE", "contact": "PERSONAL_TRANSFER",
    "transfer": "PERSONAL_TRANSFER", "income": "INCOME", "other": "OTHER", "edu": "EDUCATION", "education": "EDUCATION",
}

# --- confidences and thresholds
REVIEW, EXACT, RULE, USER_RULE, LEARN = 0.75, 0.97, 0.90, 0.92, 0.90
FUZZY_LEAST, FUZZY_MARGIN, FUZZY_LENGTH, ANCHOR_LENGTH, NEAR_RATIO, FUZZY_CAP = 0.86, 0.04, 8, 4, 0.82, 0.94
FEATURES, GRAM_LENGTHS, MODEL_CAP = 16384, (2, 3, 4), 0.89
NEIGHBOURS, CLEAR_SHARE, LEAST_SIMILARITY, VOTE_CONFIDENCE = 5, 0.75, 0.50, 0.78
NO_INDEX = ("PERSONAL_TRANSFER", "INCOME", "OTHER")
MODEL_C, OVERRIDE_WEIGHT, MODEL_FOLDS = 10.0, 3.0, 5

# --- words of counterparties
CORPORATE = ("pvt", "pvt.", "private", "ltd", "ltd.", "limited", "limtied", "llp", "inc", "incorporated", "corp", "corporation", "company")
SERVICE_LABELS = ("mobile recharge", "recharge", "electricity", "dth recharge", "dth", "gas", "water", "broadband", "datacard", "landline", "fastag", "credit card", "loan repayment", "insurance")
AMBIGUOUS = ("internet cafe", "cyber cafe")
WEAK_ANCHORS = (
    "store", "stores", "shop", "shops", "centre", "center", "general", "daily", "needs", "new", "shree", "shri", "sri", "sree", "jai", "jay", "maa", "the", "and", "india", "indian", "private",
    "limited", "point", "house", "services", "service", "traders", "enterprises", "kirana", "medical", "hotel", "cafe", "bakery", "restaurant",
)
WEAK_RULES = ("general", "tea", "point", "hotel", "collection", "novelty", "mess", "sweet", "fashion", "electric", "metro", "ola")

# --- verbs of the direction column
OUT_VERBS = ("paid to", "paid", "sent to", "payment to", "transfer to", "debited", "bill paid")
IN_VERBS = ("received from", "credited", "money received", "received")
REFUND_VERBS = ("refund from", "refund", "refunded", "reversal", "reversed")
BILL_VERBS = ("bill paid", "bill payment")

# --- patterns (Java and RE2 read them alike)
PREFIX = r"^(?:paid\s+to|received\s+from|refund\s+from|sent\s+to|bill\s+paid|paid|payment\s+to|transfer\s+to|upi\s*/?|vpa|to\s+)\s*"
MESSRS = r"^m\s*[/.]?\s*s\s+"
MASKED = r"[*x•]{2,}\s*\d*"
SEPARATORS = r"[_\-/\\|.,;:()\[\]{}'\"!?*#@+~`^<>=&]+"
REFUND_TEXT = r"\b(refund|reversal|reversed|cashback|cash\s*back|chargeback)\b"
INCOME_TEXT = r"\b(salary|wages|stipend|payroll|interest|dividend|bonus|reimbursement|reimburse|cashback|cash\s*back|refund|payout|settlement|maturity|redemption)\b"
MOBILE = r"^(?:\+?91[\s-]?)?[6-9]\d{9}$"
MASKED_WHOLE, BARE_REFERENCE = r"^[*xX]{2,}\d+$", r"^[A-Z0-9]{12,}$"
HONORIFIC = r"^(mr|mrs|miss|ms|dr|shri|smt|sri|md)\.?\s+"
NUMBER = r"-?[\d,]*\.?\d+"

# --- statement columns: roles and their header names, in order
ROLES = {
    "date": ("date", "txn date", "transaction date", "value date", "posted on"),
    "time": ("time", "txn time", "transaction time"),
    "direction": ("direction", "txn direction", "flow", "narration type"),
    "counterparty": ("counterparty", "payee", "beneficiary", "merchant", "name", "narration", "description", "particulars", "remarks", "details"),
    "transaction_id": ("transaction id", "txn id", "transaction_id", "reference no"),
    "utr": ("utr", "rrn", "utr no"),
    "account_flow": ("account flow", "account_flow"),
    "account_last4": ("account last4", "account_last4", "account no", "account"),
    "type": ("type", "dr cr", "cr dr", "drcr", "txn type", "transaction type"),
    "amount": ("amount", "txn amount", "transaction amount", "value"),
    "debit": ("debit", "withdrawal", "withdrawn", "paid out"),
    "credit": ("credit", "deposit", "paid in"),
}
NEEDED_ROLES = ("date", "counterparty")
HEADER_WORDS = ("date", "amount", "counterparty", "narration", "description", "debit", "credit", "type", "direction", "particulars")
DELIMITERS = ",;\t|"
CREDIT_MARKS = ("credit", "cr", "received", "deposit", "refund", "in")
DEBIT_MARKS = ("debit", "dr", "paid", "sent", "withdrawal", "withdrawn", "out")
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "d/M/yy", "d-M-yy", "yyyy/M/d", "M/d/yyyy")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TIME_FORMATS = ("H:m", "H:m:s", "h:m a", "h:m:s a")
SHORT_YEAR_PIVOT = 69

# --- output columns
VERDICT_COLUMNS = ("category", "category_confidence", "category_source", "category_needs_review", "category_txn_type", "category_normalized_merchant", "category_evidence", "status")
SHEET_COLUMNS = ("key", "flow", "example", "count", "total_amount", "direction", "true_category", "notes")
EVIDENCE_LENGTH = 200
