"""Fixed values. Results depend on these exact words, limits and patterns, so they are kept together here."""

# --- fixed values: column roles and default metrics -------------------------------------------------
METRIC_NAME_EXCLUSIONS = [
    "key", "code", "num", "index", "date", "time", "year", "month",
]
DATE_SHARE = 0.6
NUMBER_SHARE = 0.8
ID_SHARE = 0.9
CATEGORY_LIMIT = 100
CHART_CATEGORY_LIMIT = 50
MISSING_TEXT = "Unknown"
MISSING_WORDS = ("", "NA", "N/A", "n/a", "#N/A", "NaN", "nan", "null", "NULL", "None", "<NA>")

# --- fixed values: findings -------------------------------------------------------------------------
OUTLIER_Z = 3.0
FLAT_SLOPE = 1e-5
CORRELATION_MIN = 0.5
CORRELATION_STRONG = 0.7
CORRELATION_SAME = 0.95
CONCENTRATED_PCT = 50.0
CRITICAL_PCT = 80.0
NORMALITY_P = 0.05
CAP_GEOGRAPHY_PCT = 70.0
CAP_MISSING_PCT = 20.0

# --- fixed values: charts and headline numbers ------------------------------------------------------
HISTOGRAM_BINS = 20

# --- fixed values: run-record checks ----------------------------------------------------------------
DOMAINS = [
    "retail_sales", "manufacturing_quality", "manufacturing_production",
    "manufacturing_maintenance", "hr_attrition", "hr_performance",
    "finance_transactions", "logistics", "other",
]
CONFIDENCES = ["High", "Medium", "Low"]
VERDICTS = ["supported", "contradicted", "no_external_evidence"]
REPORT_SECTIONS = [
    "# Executive Summary",
    "# Critical Issues",
    "# Root Cause",
    "# Recommended Actions",
    "# Data Gaps",
]
MAX_ACTION_HEADINGS = 5
MIN_REPORT_CHARS = 1500
MIN_REPORT_WORDS = 1500
MAX_INVENTED_NUMBERS = 5
PERCENT_SUM_RANGE = (85, 115)

# --- fixed values: number checks in report text -----------------------------------------------------
NUMBER_PATTERN = r"\d[\d,]*\.?\d*"
GROUND_TRUTH_PATTERN = r"\d+\.?\d*"
CONTEXT_CHARS = 30
OPERATOR_CHARS = 5
OPERATOR_MARKS = ["= ", "× ", "to ", "→"]
SKIP_PATTERNS = [
    r"page\s+\d+",
    r"over[-\s]?\d",
    r"top\s+\d+",
    r"ranked.{0,10}\d+",
    r"section\s+\d+",
    r"\d+\s*%\s*confidence",
    r"\d+\.\s+\*{0,2}\w",
    r"phase\s*[\d\-]",
    r"days?\b",
    r"hrs?\b",
    r"timeline",
    r"\d{4}",
    r"priority",
    r"estimate",
    r"approximately",
    r"roughly",
    r"≈",
    r"~\s*\d",
    r"projected?",
    r"variance",
    r"account\s+for",
    r"attribut",
    r"responsible\s+for",
    r"\$[\d\.]+\s*[mk]",
    r"[mk]\b",
    r"replacement\s+cost",
    r"hidden",
    r"lost\s+product",
]
SMALL_NUMBER = 20
SMALL_NUMBER_WORDS = ["issue", "rank", "step", "point", "item", "#"]
STATISTIC_PATTERNS = [
    r"mean", r"average", r"avg", r"gap", r"delta", r"\bvs\b",
    r"compared", r"higher", r"lower", r"unit\s+gap", r"disparity",
]

# --- fixed values: typographic clean-up -------------------------------------------------------------
# narrow no-break space, no-break space -> space; non-breaking hyphen, en dash -> hyphen; em dash -> two hyphens
SPACE_LIKE = "\u202f\u00a0"
HYPHEN_LIKE = "\u2011\u2013"
EM_DASH = "\u2014"

# --- our own values: shapes tried for dates, numbers and personal data ------------------------------
NUMBER_SHAPE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER_SHAPE = r"^\s*[+-]?[0-9]{1,18}\s*$"
LEADING_ZERO_SHAPE = r"^\s*[+-]?0[0-9]"
DATE_SHAPES = [
    ("yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"),
    ("yyyy/MM/dd", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"),
    ("MM/dd/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("dd/MM/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("dd-MM-yyyy", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$"),
    ("yyyyMMdd", r"^[0-9]{8}$"),
    ("HH:mm", r"^[0-9]{2}:[0-9]{2}$"),
]
ISO_DATE_SHAPE = r"^\s*[0-9]{4}-[0-9]{1,2}(-|\s*$)"
DATE_FORMATS = [
    ("M/d/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("d/M/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("yyyy/M/d", r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"),
    ("d-M-yyyy", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("d.M.yyyy", r"^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$"),
    ("yyyyMMdd", r"^[0-9]{8}$"),
    ("M/d/yyyy H:mm", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$"),
    ("d/M/yyyy H:mm", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$"),
    ("M/d/yyyy H:mm:ss", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$"),
]
SENSITIVE_NAME = (
    r"^name$|(^|_)(first|last|full|user|contact|person)_?name(_|$)"
    r"|(^|_)(email|e_mail|mail|phone|mobile|fax|ssn|passport|national_id|employee|operator|patient)(_|$)"
    r"|(employee|operator|customer|patient|national|passport).*(id|name|no|number|email|phone)$"
)
EMAIL_SHAPE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE_SHAPE = r"(^|[^0-9A-Za-z])(\+[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}([^0-9A-Za-z]|$)"
ID_SHAPE = r"^[A-Za-z]+[#_-]?[0-9]{5,}$"
# products, parts and equipment are no personal data, whatever their codes look like
PRODUCT_ID = r"^(?i:sku|prod|product|part|item|article|brand|model|eq|equip|equipment|mach|machine)[#_-]?[0-9]"
