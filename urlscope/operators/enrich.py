"""Enrichment (P4): the 13-column URL record, as one narrow transform plus J3.

``urls`` below means the enriched table: ``url, type, domain, subdomain, tld, path, query,
scheme, has_https, url_length, num_subdomains, country, threat_score`` plus any key columns
the input carried (``page_id``, ``event_id``, ``ts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urlparts as U
from ..functions.constants import THREAT_TLDS
from .clean import clean_urls, default_label, normalize_url
from .suffix import SuffixResolver

ENRICHED_COLUMNS = ["url", "type", "domain", "subdomain", "tld", "path", "query", "scheme",
                    "has_https", "url_length", "num_subdomains", "country", "threat_score"]


def enrich_urls(df: DataFrame, rules: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """P4 over cleaned rows (P1 applied here too, so raw input is fine).

    Rows whose URL the standard splitter refuses (unbalanced IPv6 brackets) are dropped, as the
    analysed pipeline drops rows it cannot parse.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("url", "type", "country")]
    has_country = "country" in df.columns
    base = clean_urls(df).select(
        *keep,
        normalize_url("url", strip=False).alias("url"),
        default_label("type").alias("type"),
        (F.col("country") if has_country else F.lit("Unknown")).alias("country"),
    ).filter(F.col("url").isNotNull())
    parsed = base.withColumn("_netloc", U.netloc("url")).filter(U.netloc_parses("_netloc"))
    parsed = parsed.withColumn("_host", U.suffix_host("url"))
    resolved = SuffixResolver(df.sparkSession, rules).resolve(parsed, host="_host")
    dom, suf = F.col("_sfx_dom"), F.col("_sfx_suf")
    reg = F.concat_ws(".", F.nullif(dom, F.lit("")), F.nullif(suf, F.lit("")))
    domain = F.when(reg == "", F.col("_netloc")).otherwise(reg)
    sub = F.col("_sfx_sub")
    n_sub = F.when(sub == "", F.lit(0)).otherwise(F.size(F.split(sub, r"[.]", -1)))
    url_len = F.length("url")
    threat = (url_len.cast("double") / F.lit(100.0) + n_sub * F.lit(2)
              + F.when(suf.isin(*THREAT_TLDS), F.lit(1)).otherwise(F.lit(0)))
    return resolved.select(
        *keep,
        "url", "type",
        domain.alias("domain"),
        sub.alias("subdomain"),
        suf.alias("tld"),
        U.path("url").alias("path"),
        U.query("url").alias("query"),
        U.scheme("url").alias("scheme"),
        (U.scheme("url") == "https").alias("has_https"),
        url_len.cast("bigint").alias("url_length"),
        n_sub.cast("bigint").alias("num_subdomains"),
        "country",
        threat.cast("double").alias("threat_score"),
    )
