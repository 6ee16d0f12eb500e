"""Settings of an assessment.  All of these are fixed values: results depend on them."""

from __future__ import annotations

DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency", "accuracy", "timeliness", "integrity")
#: Dimensions that are planned but not assessed yet: rules for them are refused with a message of their own.  None at present.
DEFERRED_DIMENSIONS: tuple[str, ...] = ()
SEVERITY_WEIGHTS = {"high": 3, "medium": 2, "low": 1}

# Sizes.
MAX_ROWS_FULL = 5_000_000
SAMPLE_TARGET_ROWS = 1_000_000
CHUNK_SIZE = 50_000
EXAMPLE_CAP = 200
TOP_VALUES = 25
TOP_MASKS = 50
SAMPLE_VALUES = 3
VALUE_CHARS = 200
ASSESSMENT_MAX_OBJECTS = 25
REPORT_RULES, REPORT_ROWS = 12, 10

# Inference.
TYPE_AGREEMENT = 0.95
SEMANTIC_MATCH = 0.80
PATTERN_COVERAGE = 0.95
ENUM_MAX, ENUM_COVERAGE = 25, 0.95
MAD_Z, STALE_DAYS = 3.5, 730
MIN_YEAR, YEARS_AHEAD = 1900, 10
FUZZY_THRESHOLD, FUZZY_MAX_BLOCK = 88, 500

# Relationships within a dataset.
FD_MAX_PAIRS, FD_MAX_KEYS, FD_MAX_RATIO, FD_MIN_GROUPS, FD_CONSISTENCY = 24, 10_000, 0.6, 5, 0.95
DEPENDENT_SUPPORT, INTEGRITY_MIN_ROWS = 0.90, 20

# Scoring of critical data elements.
CDE_THRESHOLD = 0.5
CDE_BUSINESS_NAME, CDE_METADATA_NAME, CDE_SEMANTIC = 0.35, -0.60, 0.20
CDE_FILL, CDE_DISTINCT, CDE_SINGLE, CDE_FEW = 0.15, 0.15, -0.50, -0.25

# Texts that stand for a missing value.
PLACEHOLDERS = (
    "n/a", "na", "n.a.", "null", "none", "nil", "unknown", "unspecified",
    "tbd", "tba", "xxx", "xx", "-", "--", ".", "?", "??", "test", "testing",
    "no value", "not available", "not applicable", "missing", "#n/a",
    "#null!", "#ref!", "#value!", "0000-00-00", "01/01/1900",
)
EXCEL_ERRORS = ("#REF!", "#N/A", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!")

# Names of technical columns, then of business columns.
METADATA_NAMES = (
    r"^created?[_\s-]?(by|date|at|on|ts|time|stamp)",
    r"^(last[_\s-]?)?(modified|updated|changed)([_\s-]?(by|date|at|on|ts))?",
    r"^(sys|system)[_\s-]?mod[_\s-]?stamp$",
    r"^source[_\s-]?(system|file|id)$",
    r"^etl[_\s-]",
    r"^batch[_\s-]?(id|no|number)$",
    r"^(is)?[_\s-]?deleted$",
    r"^owner[_\s-]?id$",
    r"^record[_\s-]?type[_\s-]?id$",
    r"^(row|line)[_\s-]?(num|number|id)$",
    r"^_+",
    r"[_\s-]ts$",
    r"^load[_\s-]?(date|time|id)$",
    r"^version$",
    r"^checksum$",
    r"^(dw|dwh|stg|tmp)[_\s-]",
)
BUSINESS_NAMES = (
    r"name", r"email", r"e[_\s-]?mail", r"phone", r"mobile", r"contact",
    r"address", r"street", r"city", r"state", r"province", r"country",
    r"zip", r"postal", r"postcode", r"ssn", r"tax[_\s-]?id", r"account",
    r"customer", r"client", r"vendor", r"supplier", r"product", r"sku",
    r"amount", r"price", r"cost", r"revenue", r"salary", r"quantity",
    r"birth", r"dob", r"gender", r"title", r"company", r"organi[sz]ation",
    r"date$", r"^date", r"signup", r"activity", r"expir", r"due$",
    r"start", r"end$", r"renewal", r"close",
    r"^id$", r"[_\s-]id$", r"number", r"code", r"status", r"category",
    r"department", r"industry", r"currency", r"invoice", r"order",
)

# Meaning of a column by its name, first match wins.
SEMANTIC_NAMES = (
    ("email", r"e[_\s-]?mail"),
    ("phone", r"phone|mobile|cell|telephone|fax|contact[_\s-]?(no|number)"),
    ("postcode", r"zip|postal|post[_\s-]?code|pin[_\s-]?code"),
    ("country", r"^country|country$|nation"),
    ("state", r"^state|state$|province|region$"),
    ("city", r"^city|city$|town$|locality"),
    ("address", r"address|street|addr[_\s-]?line"),
    ("currency_code", r"currency([_\s-]?code)?$|^ccy"),
    ("amount", r"amount|price|cost|revenue|salary|balance|total|value$|fee$|charge"),
    ("date", r"date$|^date|birth|dob|expir|due$"),
    ("datetime", r"timestamp|datetime|_at$|_ts$"),
    ("person_name", r"(first|last|middle|given|sur|full|contact)[_\s-]?name|^name$"),
    ("org_name", r"(company|organi[sz]ation|business|account|vendor|supplier|client)[_\s-]?name"),
    ("url", r"url|website|web[_\s-]?site|link$|domain$"),
    ("identifier", r"^id$|[_\s-]id$|^.*_no$|number$|code$|sku|reference|ref$"),
    ("boolean_flag", r"^is[_\s-]|^has[_\s-]|flag$|^active$|^enabled$"),
    ("category", r"type$|category|status$|segment|class$|tier$|group$"),
)
# Meaning of a column by its values, in order of precedence.
SEMANTIC_VALUES = (
    ("email", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"),
    ("url", r"(?i)^(https?://|www\.)[^\s]+$"),
    ("currency_code", r"^[A-Z]{3}$"),
    ("phone", r"^[\+\(]?[\d][\d\s\-\(\)\.]{6,20}$"),
    ("postcode", r"(?i)^\d{5}(-\d{4})?$|^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$|^\d{6}$|^[A-Z0-9][A-Z0-9\s\-]{2,9}$"),
    ("boolean_flag", r"(?i)^(true|false|yes|no|y|n|1|0|t|f|active|inactive|enabled|disabled)$"),
    ("amount", r"^-?[\$€£₹]?\s?-?[\d,]+(\.\d+)?$"),
    ("identifier", r"^[A-Za-z0-9][A-Za-z0-9\-_/\.]{2,}$"),
    ("person_name", r"^[A-Za-z][A-Za-z\s\.\'\-]{1,60}$"),
)
UNVERIFIABLE = ("date", "datetime", "country", "state", "city", "address", "org_name", "category")
BUSINESS_MEANINGS = ("email", "phone", "person_name", "org_name", "address", "postcode", "country", "state", "city", "currency_code", "amount", "date", "datetime", "identifier", "url")
#: Meanings whose values are open-ended, so that few distinct ones are no closed domain.
OPEN_ENDED = ("person_name", "org_name", "email", "phone", "address", "identifier", "url", "free_text", "amount", "postcode")
