"""Fixed values.

Every list in this module is a fixed value that has to equal what the analysed pipeline uses,
otherwise features, scores and predictions differ. They are written out plainly, in their
natural order, and are not derived from anything.
"""

# --- fixed values: lexical feature job (F1) -------------------------------------------------

# Words that mark a URL as suspicious (substring test on the lower-cased URL).
SUSPICIOUS_WORDS = [
    "login", "password", "bank", "account", "secure", "verify", "confirm",
    "signin", "admin", "update", "alert", "warning", "suspended", "locked",
    "billing", "invoice", "payment", "credit", "card", "support", "help",
    "service", "customer", "client", "user", "auth", "session", "token",
]

# Public suffixes counted as risky (compared with the lower-cased public suffix).
MALICIOUS_TLDS = [
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "club", "online", "site", "work",
    "bid", "party", "review", "trade", "science", "space", "tech", "fun", "icu",
    "info", "biz", "pro", "loan", "win", "life", "stream", "download", "date",
    "ru", "cn", "in", "br", "mx", "tr", "pl", "ua", "ro", "cz", "gr", "pt", "ar",
]

# Special characters counted by F1 (character class, as written).
SPECIAL_CHAR_CLASS = r"""[!@#$%^&*()_+\-=\[\]{};':"\\|,.<>/?]"""

# Weights of the F1 security risk score, applied in this order.
RISK_WEIGHTS = [
    ("special_char_count", 0.1),
    ("digit_count", 0.05),
    ("subdomain_count", 0.3),
    ("malicious_tld", 2.0),
    ("has_suspicious_words", 1.5),
    ("has_hyphen_domain", 0.8),
    ("is_ip_address", 1.2),
    ("has_at_symbol", 2.5),
    ("has_double_slash", 1.8),
    ("has_redirect", 1.0),
    ("has_php", 0.5),
    ("has_exe", 1.5),
    ("has_jsp", 0.5),
    ("has_query", 0.3),
    ("path_depth", 0.2),
    ("has_https", -0.5),
    ("has_www", -0.3),
    ("domain_entropy", 0.1),
]
RISK_MIN, RISK_MAX = -5.0, 10.0

# --- fixed values: training / quick feature jobs (F2, F3) -----------------------------------

SUSPICIOUS_PATTERN_SHORT = "login|bank|paypal|secure|account|update|verify|signin|password"
RISK_CHAR_PATTERN = r"""[<>'";()]|://.*://"""

# Feature order fed to the boosted-tree model.
TRAINING_FEATURES = [
    "url_length", "domain_length", "has_suspicious_words",
    "special_char_count", "digit_ratio", "is_ip_address",
    "security_risk_score", "has_www", "has_params",
    "path_length", "dir_count", "has_https",
]

# --- fixed values: enrichment threat score (P4) ---------------------------------------------

THREAT_TLDS = ["tk", "xyz", "info", "top"]

# --- fixed values: simple risk score (F4) ---------------------------------------------------

SIMPLE_RISK_WORDS = ["login", "bank", "secure", "password"]
SIMPLE_RISK_TLDS = ["ru", "cn", "tk"]
SIMPLE_RISK_LONG_URL = 75
SIMPLE_RISK_CAP = 5

# --- fixed values: rule scoring (R1-R4) -----------------------------------------------------

# (reason text, points), in the order the reasons are reported.
RULE_REASONS = [
    ("has_exe", "Contains .exe file", 10),
    ("is_ip_address", "Uses IP address instead of domain", 8),
    ("malicious_tld", "Uses suspicious TLD", 7),
    ("has_at_symbol", "Contains @ symbol", 6),
    ("many_subdomains", "Too many subdomains", 5),
    ("has_suspicious_words", "Contains suspicious keywords", 4),
    ("long_hyphen_domain", "Long domain with hyphens", 3),
    ("high_risk_score", "High security risk score", 3),
    ("high_entropy", "High domain entropy", 2),
    ("has_https", "Uses HTTPS", -2),
    ("has_www", "Has www prefix", -1),
]
# Hosting platforms: host suffix, reason; only the first that matches counts (-5 points).
HOSTING_SUFFIXES = [
    (".web.app", "Firebase hosting domain (legitimate)"),
    (".github.io", "GitHub Pages hosting (legitimate)"),
    (".netlify.app", "Netlify hosting (legitimate)"),
    (".vercel.app", "Vercel hosting (legitimate)"),
]
HOSTING_POINTS = -5
MALICIOUS_TYPES = ["phishing", "malware", "defacement"]

# --- fixed values: model override (J4) ------------------------------------------------------

# Known legitimate domains; a non-benign model prediction becomes benign when any entry is a
# substring of the lower-cased netloc. 42 entries as listed (three appear twice).
LEGIT_DOMAINS = [
    "google.com", "github.com", "microsoft.com", "apple.com", "amazon.com", "amazon.in",
    "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com",
    "wikipedia.org", "stackoverflow.com", "reddit.com", "netflix.com", "paypal.com",
    "ebay.com", "craigslist.org", "indeed.com", "glassdoor.com", "monster.com",
    "linkedin.com", "xing.com", "dropbox.com", "onedrive.live.com", "icloud.com",
    "zoom.us", "slack.com", "discord.com", "telegram.org", "whatsapp.com",
    "spotify.com", "soundcloud.com", "pandora.com", "tidal.com", "apple.com",
    "microsoft.com", "adobe.com", "autodesk.com", "nvidia.com", "amd.com",
    "web.app",
]
OVERRIDE_CONFIDENCE = 0.95
OVERRIDE_PROBABILITIES = [("benign", 0.95), ("defacement", 0.02), ("malware", 0.02), ("phishing", 0.01)]

# --- fixed values: training augmentation (U1) -----------------------------------------------

HOSTING_EXAMPLE_URLS = [
    "https://myproject.web.app/",
    "https://portfolio.web.app/",
    "https://app.web.app/",
    "https://demo.web.app/",
    "https://test.web.app/",
    "https://myapp.firebaseapp.com/",
    "https://project.github.io/",
    "https://docs.github.io/",
    "https://portfolio.netlify.app/",
    "https://site.vercel.app/",
]
HOSTING_EXAMPLE_REPEATS = 10

# --- fixed values: aggregates and viewer ----------------------------------------------------

LENGTH_BUCKET_WIDTH = 50
PAGE_SIZE = 25
DISPLAY_URL_CHARS = 60
TOP_TYPES_N, TOP_DOMAINS_N, TOP_TLDS_N, TOP_COUNTRIES_N = 20, 20, 50, 10
CHART_TYPES_N, CHART_DOMAINS_N, CHART_TLDS_N = 10, 15, 20
DASHBOARD_TOP_N = 10
PREVIEW_ROWS = 30
ZSCORE_THRESHOLD = 3.0
OTHER_CODE, OTHER_NAME = "OTHER", "Other/Unknown"

# --- fixed values: input reading (S1-S3) ----------------------------------------------------

SEPARATORS = [",", "\t", ";", "|"]

# Characters Python's str.strip() removes (str.isspace); used wherever text is trimmed.
WHITESPACE_CODEPOINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODEPOINTS)

# --- country lookup (J2b) ---------------------------------------------------------------------

FUZZY_MAX_DISTANCE = 2
