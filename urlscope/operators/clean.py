"""Cleaning and predicates.

All of them are narrow column expressions: no shuffle, kept inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MALICIOUS_TYPES
from ..functions.urlparts import py_strip


def clean_urls(df: DataFrame, url: str = "url", label: str = "type") -> DataFrame:
    """Trim the URL, trim and lower-case the label, drop rows whose URL is blank."""
    return (df.withColumns({url: py_strip(url), label: F.lower(py_strip(label))})
            .filter(F.length(F.col(url)) > 0))


def normalize_url(url: Column | str, strip: bool = True) -> Column:
    """Prefix ``http://`` unless the text starts with ``http://`` or ``https://``.

    The test is case-sensitive, so ``HTTP://x`` becomes ``http://HTTP://x``. Blank → null.
    """
    u = py_strip(url) if strip else (F.col(url) if isinstance(url, str) else url)
    return (F.when(F.length(u) == 0, F.lit(None).cast("string"))
            .when(u.startswith("http://") | u.startswith("https://"), u)
            .otherwise(F.concat(F.lit("http://"), u)))


def default_label(label: Column | str) -> Column:
    """Trimmed lower-case label; null or empty → ``unknown``."""
    col = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.nullif(F.lower(py_strip(col)), F.lit("")), F.lit("unknown"))


def is_not_benign(label: Column | str = "type") -> Column:
    """P5: ``type !== 'benign'``; true for null labels too."""
    col = F.col(label) if isinstance(label, str) else label
    return ~col.eqNullSafe(F.lit("benign"))


def is_malicious_type(label: Column | str = "prediction") -> Column:
    """Label is one of phishing, malware, defacement (``unknown`` is not)."""
    col = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.lower(col).isin(*MALICIOUS_TYPES), F.lit(False))


def drop_null_rows(df: DataFrame, cols=("url", "type")) -> DataFrame:
    """P8."""
    return df.dropna(subset=list(cols))


def is_number(col: str = "threat_score") -> Column:
    """P9 predicate: the value is a number (not null, not NaN).

    Written with a single reference to the column: predicates are pushed below projections
    with the column's defining expression substituted in, so each extra reference would copy
    the whole derivation (here the suffix resolution) into generated code again.
    """
    v = F.col(col).try_cast("double")
    return ~F.isnan(F.coalesce(v, F.lit(float("nan"))))


def numeric_only(df: DataFrame, col: str = "threat_score") -> DataFrame:
    """Keep rows whose value is a number (not null, not NaN)."""
    return df.filter(is_number(col))
