"""Lexical URL features (F1-F5) as native column expressions.

Each variant keeps its own definition because the analysed scripts disagree (see SURVEY §2.8).
Everything is built from Spark SQL string, regex and higher-order functions, so the work stays
in the JVM and inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urlparts as U
from .constants import (MALICIOUS_TLDS, RISK_CHAR_PATTERN, RISK_MAX, RISK_MIN, RISK_WEIGHTS,
                        SIMPLE_RISK_CAP, SIMPLE_RISK_LONG_URL, SIMPLE_RISK_TLDS, SIMPLE_RISK_WORDS,
                        SPECIAL_CHAR_CLASS, SUSPICIOUS_PATTERN_SHORT, SUSPICIOUS_WORDS)

# Python's ``\d`` and ``str.isalnum`` are Unicode-aware; these classes match them in Java.
UNICODE_DIGIT = r"\p{Nd}"
NOT_ALNUM = r"[^\p{L}\p{N}]"
IPV4_PREFIX = r"^\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}"
IPV4_FULL = IPV4_PREFIX + "$"

#: F1 output columns, in the order the analysed function fills its dict.
F1_COLUMNS = [
    "url_length", "domain_length", "special_char_count", "digit_count", "letter_count",
    "digit_ratio", "subdomain_count", "has_www", "has_hyphen_domain", "has_suspicious_words",
    "malicious_tld", "has_https", "has_http", "is_ip_address", "path_length", "query_length",
    "has_query", "path_depth", "has_php", "has_jsp", "has_exe", "has_at_symbol",
    "has_double_slash", "has_redirect", "domain_entropy", "security_risk_score",
]


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def _b(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def char_entropy(text: Column | str) -> Column:
    """Shannon entropy in bits over the characters of ``text``; 0 for empty or null.

    Sums over distinct characters with a higher-order function: O(distinct × length) per value
    and no explode, so nothing is shuffled. ``text`` is evaluated for every character, so it should be a plain column.
    """
    t = _c(text)
    n = F.length(t).cast("double")
    chars = F.array_distinct(F.split(t, ""))
    shares = F.transform(chars, lambda ch: (F.length(t) - F.length(F.replace(t, ch, F.lit("")))).cast("double") / n)
    ent = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(t.isNull() | (F.length(t) == 0), F.lit(0.0)).otherwise(ent + F.lit(0.0))


#: Fixed value: the risk of a URL whose features can't be taken; all other features are 0 then.
FAILED_RISK = 5.0


def lexical_features(df: DataFrame, url: str = "url", suffix: str = "tld") -> DataFrame:
    """26 feature columns added to ``df`` (needs the resolved public suffix column).

    A null URL, and one whose host the URL splitter refuses (brackets that hold no IP address), get the default row: risk ``FAILED_RISK``,
    everything else 0. Staged in projections so shared parts (netloc, path, lower-case URL, characters of the
    entropy) are computed once per row.
    """
    u = F.col(url)
    staged = df.withColumns({
        "_nl": U.netloc(u), "_pth": U.path(u), "_qry": U.query(u), "_low": F.lower(u),
    })
    nl, pth, qry, low = F.col("_nl"), F.col("_pth"), F.col("_qry"), F.col("_low")
    staged = staged.withColumn("_aln", F.regexp_replace(nl, NOT_ALNUM, "")).withColumns({
        "url_length": F.length(u).cast("bigint"),
        "domain_length": F.length(nl).cast("bigint"),
        "special_char_count": F.regexp_count(u, F.lit(SPECIAL_CHAR_CLASS)).cast("bigint"),
        "digit_count": F.regexp_count(u, F.lit(UNICODE_DIGIT)).cast("bigint"),
        "letter_count": F.regexp_count(u, F.lit("[a-zA-Z]")).cast("bigint"),
        "subdomain_count": F.when(F.length(nl) - F.length(F.replace(nl, F.lit("."), F.lit(""))) > 1,
                                  F.size(F.split(nl, r"[.]", -1)) - 2).otherwise(F.lit(0)).cast("bigint"),
        "has_www": _b(nl.startswith("www.")),
        "has_hyphen_domain": _b(nl.contains("-")),
        "has_suspicious_words": _b(F.exists(F.array(*[F.lit(w) for w in SUSPICIOUS_WORDS]),
                                            lambda w: F.contains(low, w))),
        "malicious_tld": _b(F.lower(F.col(suffix)).isin(*MALICIOUS_TLDS)),
        "has_https": _b(u.startswith("https://")),
        "has_http": _b(u.startswith("http://")),
        "is_ip_address": _b(nl.rlike(IPV4_PREFIX)),
        "path_length": F.length(pth).cast("bigint"),
        "query_length": F.length(qry).cast("bigint"),
        "has_query": _b(F.length(qry) > 0),
        "path_depth": (F.length(pth) - F.length(F.replace(pth, F.lit("/"), F.lit("")))).cast("bigint"),
        "has_php": _b(F.lower(pth).contains(".php") | F.lower(qry).contains(".php")),
        "has_jsp": _b(F.lower(pth).contains(".jsp") | F.lower(qry).contains(".jsp")),
        "has_exe": _b(low.contains(".exe")),
        "has_at_symbol": _b(u.contains("@")),
        "has_double_slash": _b(F.substring(u, 9, 1 << 30).contains("//")),
        "has_redirect": _b(low.contains("redirect") | low.contains("redir")),
        "domain_entropy": char_entropy("_aln"),
    })
    staged = staged.withColumn(
        "digit_ratio",
        F.when(F.col("url_length") > 0, F.col("digit_count") / F.col("url_length")).otherwise(F.lit(0.0)))
    risk = F.lit(0.0)
    for name, weight in RISK_WEIGHTS:
        risk = risk + F.col(name) * F.lit(float(weight))
    staged = staged.withColumn("security_risk_score", F.greatest(F.lit(RISK_MIN), F.least(F.lit(RISK_MAX), risk)))
    failed = u.isNull() | ~U.netloc_parses(nl)
    defaults = {c: F.when(failed, F.lit(FAILED_RISK if c == "security_risk_score" else 0)).otherwise(F.col(c)) for c in F1_COLUMNS}
    return staged.withColumns(defaults).drop("_nl", "_pth", "_qry", "_low", "_aln")


def _training_like(df: DataFrame, url: Column, host: Column, url_len: Column) -> DataFrame:
    return df.withColumns({
        "domain_length": F.length(host).cast("bigint"),
        "special_char_count": F.regexp_count(url, F.lit("[^a-zA-Z0-9]")).cast("bigint"),
        "digit_count": F.regexp_count(url, F.lit("[0-9]")).cast("bigint"),
        "is_ip_address": _b(host.rlike(IPV4_FULL)),
        "has_suspicious_words": _b(url.rlike("(?i)(?:" + SUSPICIOUS_PATTERN_SHORT + ")")),
        "security_risk_score": F.regexp_count(url, F.lit(RISK_CHAR_PATTERN)).cast("bigint"),
        "path_length": (F.length(url) - F.length(host)).cast("bigint"),
        "dir_count": (F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))).cast("bigint"),
        "has_www": _b(host.startswith("www.")),
        "has_params": _b(url.contains("?")),
    }).withColumn("digit_ratio", F.col("digit_count") / url_len)


def training_features(urls: DataFrame) -> DataFrame:
    """the model's features on enriched rows (registered domain, stored length)."""
    u = F.coalesce(F.col("url"), F.lit(""))
    d = F.coalesce(F.col("domain"), F.lit(""))
    out = _training_like(urls, u, d, F.col("url_length").cast("double"))
    return out.withColumn("has_https", F.col("has_https").cast("int"))


def quick_features(df: DataFrame, url: str = "url") -> DataFrame:
    """13 features with the host taken by splitting on ``/``."""
    u = F.col(url)
    parts = F.split(u, "/", -1)
    host = F.when(u.contains("//"), F.element_at(parts, 3)).otherwise(F.element_at(parts, 1))
    out = _training_like(df.withColumn("_qhost", host), u, F.col("_qhost"), F.length(u).cast("double"))
    out = out.withColumns({
        "url_length": F.length(u).cast("bigint"),
        "digit_ratio": F.when(F.length(u) > 0, F.col("digit_ratio")).otherwise(F.lit(0.0)),
        "has_https": _b(u.startswith("https://")),
    })
    return out.drop("_qhost")


def simple_risk_score(url: Column | str) -> Column:
    """0-5 score (+1 long URL, +1 risky word, +2 ``ru``/``cn``/``tk`` anywhere)."""
    low = F.lower(_c(url))
    s = (_b(F.length(low) > SIMPLE_RISK_LONG_URL)
         + _b(F.exists(F.array(*[F.lit(w) for w in SIMPLE_RISK_WORDS]), lambda w: F.contains(low, w)))
         + F.when(F.exists(F.array(*[F.lit(t) for t in SIMPLE_RISK_TLDS]), lambda t: F.contains(low, t)),
                  F.lit(2)).otherwise(F.lit(0)))
    return F.least(s, F.lit(SIMPLE_RISK_CAP))
