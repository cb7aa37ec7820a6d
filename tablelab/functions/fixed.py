"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES -- keep as written (they define results, not tuning).
"""

# Strings the CSV reader treats as missing (pandas defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# Personal-data patterns, matched at the start of the text only.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
}

# Missing-share thresholds (strictly greater than).
MISSING_CRITICAL = 50
MISSING_HIGH = 20
MISSING_MODERATE = 5
HEALTH_PENALTY = 8

# Target-candidate hints.
ID_LIKE_NAMES = ["id", "identifier", "uuid", "uid", "index", "rowid", "customer_id", "user_id"]
ID_LIKE_SUBSTRINGS = ["customer_id", "user_id", "account_id", "order_id"]
TARGET_NAME_HINTS = ["target", "label", "class", "y", "price", "amount", "churn", "outcome",
                     "response", "value", "score"]

# Intent keywords, in priority order (first hit wins).
INTENT_KEYWORDS = [
    ("web_search", ["search", "find online", "look up", "latest news", "جستجو", "سرچ",
                    "اینترنت", "find info", "بیا پیدا کن", "تحقیق کن روی"]),
    ("eda", ["eda", "exploratory", "analyze", "statistics", "distribution",
             "correlation", "آنالیز", "تحلیل", "آمار", "بررسی داده"]),
    ("preprocessing", ["clean", "preprocess", "missing", "outlier", "encode", "scale",
                       "پیش‌پردازش", "تمیز", "مقادیر گمشده", "نرمال"]),
    ("ml_training", ["train", "model", "random forest", "xgboost", "classification",
                     "regression", "آموزش مدل", "یادگیری ماشین", "دقت مدل"]),
    ("deep_learning", ["neural", "ann", "deep learning", "keras", "epoch",
                       "شبکه عصبی", "یادگیری عمیق"]),
    ("visualization", ["chart", "plot", "graph", "visualize", "heatmap", "scatter",
                       "نمودار", "رسم", "چارت", "ویژوالیز"]),
    ("prediction", ["predict", "inference", "forecast", "پیش‌بینی", "پیشگویی"]),
    ("report", ["report", "summary", "export", "گزارش", "خلاصه"]),
    ("data_qa", ["column", "row", "dataset", "data", "value", "ستون", "ردیف",
                 "داده", "فایل", "دیتاست"]),
]
QUESTION_MARKERS = ["?", "what", "how many", "show", "چند", "چیست", "چه"]

# Intent -> roles that handle it.
INTENT_ROLES = {
    "casual_chat": ["chat"],
    "data_qa": ["data_analyst"],
    "eda": ["data_analyst", "visualizer"],
    "preprocessing": ["preprocessor"],
    "ml_training": ["ml_engineer"],
    "deep_learning": ["deep_learning"],
    "visualization": ["visualizer"],
    "prediction": ["predictor"],
    "report": ["reporter", "data_analyst"],
    "web_search": ["data_analyst"],
}

# Substrings that make a message ask for a web search.
SEARCH_TRIGGERS = [
    "search", "find online", "look up", "latest", "current", "today",
    "news", "recent", "trend", "what is", "who is", "how does",
    "جستجو", "سرچ", "اینترنت", "بیا پیدا کن", "جدیدترین", "اخبار",
    "تحقیق کن", "find info", "tell me about",
]

# Health labels: lower bounds (inclusive).
HEALTH_LABELS = [(80, "Excellent"), (60, "Good"), (40, "Fair")]
HEALTH_LABEL_ELSE = "Critical"

# Page text and search result limits.
PAGE_TEXT_MAX_CHARS = 3000
EXCERPT_MAX_CHARS = 600
DIGEST_MAX_CHARS = 400
RECENT_TURNS = 4
CITATIONS_MAX = 5

# FIXED VALUES: markup of a result page and the line for a search without results.
LINK_RE = r'(?i)<a[^>]+class="result-link"[^>]*href="([^"]+)"[^>]*>([^<]+)</a>'
SNIPPET_RE = r'(?is)<td[^>]+class="result-snippet"[^>]*>(.*?)</td>'
NO_RESULTS_LINE = "[No web search results found]"
