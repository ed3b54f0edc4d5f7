"""The ICANN section of the public suffix list, read from the copy that ships with Spark."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

#: Where the list stands in Spark's jars, and the marks of its first section.
JAR, ENTRY = "httpclient-4*.jar", "mozilla/public-suffix-list.txt"
BEGIN, END = "===BEGIN ICANN DOMAINS===", "===END ICANN DOMAINS==="


def _jar() -> str:
    import pyspark
    for home in (os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")):
        found = sorted(glob.glob(os.path.join(home, "jars", JAR)))
        if found:
            return found[0]
    raise FileNotFoundError("no public suffix list among Spark's jars; pass the rules as a table")


@lru_cache(maxsize=1)
def icann_rules() -> tuple[str, ...]:
    """All rules of the section in the list's own syntax (``*.`` wildcard, ``!`` exception)."""
    with zipfile.ZipFile(_jar()) as z:
        text = z.read(ENTRY).decode("utf-8")
    section = text[text.index(BEGIN):text.index(END)]
    return tuple(r.lower() for r in (line.strip() for line in section.splitlines()[1:]) if r and not r.startswith("//"))
