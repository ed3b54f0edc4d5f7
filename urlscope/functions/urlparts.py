"""URL parts as native column expressions.

Semantics follow the standard-library URL split used by the analysed pipeline:
the scheme runs to the first ``:`` when it is made of scheme characters and starts with a
letter; the netloc follows ``//`` up to the first of ``/?#`` and keeps user info and port;
the fragment is cut at the first ``#``, the query at the first ``?`` before it; ``;params``
are split off the last path segment only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import WHITESPACE

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_AFTER_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"^[^#]*#(.*)$"
_PARAMS = r";([^/]*)$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """Trim the characters Python's ``str.strip()`` removes."""
    return F.btrim(_c(col), F.lit(WHITESPACE))


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), _SCHEME, 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), _NETLOC, 1)


def raw_path(url: Column | str) -> Column:
    """Path including ``;params`` (what a plain split gives)."""
    return F.regexp_extract(_c(url), _AFTER_NETLOC, 1)


def path(url: Column | str) -> Column:
    """Path with ``;params`` of the last segment removed."""
    return F.regexp_replace(raw_path(url), _PARAMS, "")


def params(url: Column | str) -> Column:
    return F.regexp_extract(raw_path(url), _PARAMS, 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), _QUERY, 1)


def fragment(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), _FRAGMENT, 1)


# Netloc the standard splitter accepts: no brackets, or the text between the first ``[`` and
# the next ``]`` is an IPv6 address (hex digits, colons, dots) or an IPvFuture ``vX.…`` form.
_NETLOC_OK = r"^(?:[^\[\]]*|[^\[]*\[(?:v[0-9A-Fa-f]+\.[^\]]+|[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*)\].*)$"


def netloc_parses(nl: Column | str) -> Column:
    """False where the URL splitter refuses the netloc (unbalanced or invalid brackets)."""
    return _c(nl).rlike(_NETLOC_OK)


def suffix_host(url: Column | str) -> Column:
    """Host as the suffix resolver sees it.

    Leading ``scheme://`` or ``//`` removed, cut at the first of ``/?#``, user info dropped up
    to the last ``@``, port dropped at the first ``:``, whitespace and trailing dots stripped,
    ideographic full stops read as dots.
    """
    u = F.regexp_replace(_c(url), r"^(?:[a-zA-Z0-9+.\-]+:)?//", "")
    u = F.regexp_extract(u, r"^([^/?#]*)", 1)
    u = F.regexp_replace(u, r"^.*@", "")
    u = F.regexp_extract(u, r"^([^:]*)", 1)
    u = py_strip(u)
    u = F.regexp_replace(u, "[.。．｡]+$", "")
    return F.translate(u, "。．｡", "...")


def url_parts(url: Column | str) -> list[Column]:
    """The six URL parts (F6) as named columns."""
    return [
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        path(url).alias("path"),
        params(url).alias("params"),
        query(url).alias("query"),
        fragment(url).alias("fragment"),
    ]
