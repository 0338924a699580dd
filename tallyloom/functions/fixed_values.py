"""Word lists, patterns and cut-offs the results depend on."""

# Names tried first, in this order, when looking for the amount column.
AMOUNT_NAMES = [
    "Transaction Amount (RM)", "transaction_amount", "amount", "Amount",
    "Gross payments", "Net payments", "Settlement Amount (RM)",
    "value", "Value", "total", "Total",
]
# A column whose lower-cased name contains one of these may hold amounts.
AMOUNT_WORDS = ["amount", "rm", "total", "sum", "payment", "gross", "net"]
# Mean of a column that may pass for an amount when no name helps.
AMOUNT_MEAN_LOW, AMOUNT_MEAN_HIGH = 0.01, 100000

# Written before amounts in answers.
CURRENCY = "RM"

# Names tried first, in this order, when looking for the key column.
ID_NAMES = [
    "Transaction ID", "transaction_id", "id", "ID", "reference",
    "Reference", "Transaction Reference", "Merchant Reference",
]

# A first data row with one of these words is really the header.
HEADER_WORDS = ["no", "date", "transaction", "amount", "reference", "type", "payment"]

# A cell containing one of these marks a summary row.
SUMMARY_WORDS = [
    "total:", "total", "sum:", "sum", "grand total",
    "subtotal", "summary", "balance", "amount due",
]
SUMMARY_MIN_CELLS, SUMMARY_MIN_SHARE = 2, 0.3

# Question patterns per intent; questions are lower-cased first.
INTENT_PATTERNS = {
    "comparison": [
        r"\b(compare|comparison|difference|diff|vs|versus)\b",
        r"\bmissing\b.*\b(between|from)\b",
        r"\bhow\s+much\s+is\s+missing\b",
        r"\bdifference\s+between\b",
        r"\bmissing.*\b(transactions?|records?|entries?)\b",
        r"\bhow\s+many.*\bmissing\b",
        r"\bfind.*\bmissing\b",
        r"\bcheck.*\bmissing\b",
        r"\bmissing.*\bcount\b",
        r"\bmissing.*\brm\b",
    ],
    "aggregation": [
        r"\b(total|sum|count|average|mean)\b(?!.*\bmissing\b)",
        r"\bhow\s+much\b.*\b(total|altogether)\b(?!.*\bmissing\b)",
        r"\bgrand\s+total\b(?!.*\bmissing\b)",
    ],
    "analysis": [
        r"\banalyze|analysis\b",
        r"\bbreakdown\b",
        r"\binsights?\b",
        r"\bpatterns?\b",
        r"\brelation(s|ship)?\b",
        r"\blogical\b.*\brelation\b",
    ],
    "transaction_matching": [
        r"\bmatch\b.*\btransactions?\b",
        r"\brelated\b.*\btransactions?\b",
        r"\bcommon\b.*\btransactions?\b",
    ],
}
INTENT_FLOOR, INTENT_FALLBACK_CONFIDENCE = 0.3, 0.5

AGGREGATION_WORDS = {
    "sum": ["total", "sum"],
    "count": ["count", "number"],
    "mean": ["average", "mean"],
}

# An assistant message containing one of these is a decision.
DECISION_WORDS = [
    "recommend", "suggest", "advice", "decision",
    "should", "could", "would be best", "optimal",
    "proposed solution", "best approach",
]

# Response scoring.
LIST_MARKERS = ["•", "-", "*", "1.", "2.", "3."]
ADVICE_WORDS = ["recommend", "suggest", "consider", "try"]
DATA_WORDS = ["data", "column", "row", "table", "analysis"]
ACTION_WORDS = [
    "should", "could", "recommend", "suggest", "try", "consider",
    "next step", "action", "implement", "apply", "use", "create",
]
ANALYSIS_TERMS = [
    "column", "row", "table", "dataset", "relationship", "pattern",
    "trend", "correlation", "distribution", "outlier", "quality",
    "schema", "index", "foreign key", "primary key",
]

# Relationship search.
JOIN_WORDS = ["id", "key", "code", "num", "number"]
OBVIOUS_JOIN_WORDS = ["id", "key", "ref", "code", "number"]
GENERIC_COLUMN_NAMES = ["id", "name", "date", "year", "month", "day"]
MIN_OVERLAP, UNIQUE_RATIO, SHARED_UNIQUE_RATIO = 0.1, 0.9, 0.8
OVERLAP_WEIGHT, UNIQUE_WEIGHT = 0.7, 0.3
KEY_CONFIDENCE, NAME_SIMILARITY = 0.7, 0.6

# Constraint sets of the metadata tables.
PROCESSING_STATUSES = ["pending", "processing", "completed", "failed"]
MESSAGE_TYPES = ["user", "assistant", "system", "error"]
SESSION_DATA_LIMIT = 10000

# Column type names.
SQL_TYPES = {
    "integer": "INTEGER", "decimal": "DECIMAL", "text": "TEXT",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}
ENUM_MAX_VALUES, ENUM_MAX_RATIO, VARCHAR_LIMIT = 10, 0.1, 50

# Quality cut-offs: share above which an issue is medium / high.
NULL_FLAG, NULL_MEDIUM, NULL_HIGH = 0.1, 0.2, 0.5
SHARE_FLAG, SHARE_MEDIUM, SHARE_HIGH = 0.05, 0.1, 0.2
IQR_FACTOR = 1.5
CATEGORICAL_RATIO = 0.1

# The metadata tables, and the columns that name a row of their parent.
METADATA_TABLES = ["user_sessions", "file_metadata", "processing_states", "conversation_history", "data_insights", "resource_usage"]
METADATA_REFERENCES = {
    "file_metadata": ("session_id", "user_sessions"),
    "processing_states": ("file_id", "file_metadata"),
    "conversation_history": ("session_id", "user_sessions"),
    "data_insights": ("file_id", "file_metadata"),
    "resource_usage": ("session_id", "user_sessions"),
}
METADATA_REQUIRED = {
    "user_sessions": ["user_id"],
    "file_metadata": ["session_id", "filename", "file_type", "size", "processing_status"],
    "processing_states": ["file_id", "current_step", "progress_percentage"],
    "conversation_history": ["session_id", "message_type", "content"],
    "data_insights": ["file_id", "quality_score"],
    "resource_usage": ["session_id", "cpu_percent", "memory_percent", "memory_used_mb", "disk_usage_percent", "operation_type"],
}
UNIQUE_RULE = "id_unique"
