"""Rule-based scoring (R1-R5) and the known-domain override.

Points and reasons are one ``when`` per rule over the F1 columns; the reason list is an array
with the non-firing entries removed, so the whole job is one narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urlparts as U
from ..functions.features import F1_COLUMNS
from ..functions.constants import (HOSTING_POINTS, HOSTING_SUFFIXES, LEGIT_DOMAINS,
                                   OVERRIDE_CONFIDENCE, OVERRIDE_PROBABILITIES, RULE_REASONS)
from .clean import is_malicious_type


def _conditions(f) -> dict[str, Column]:
    return {
        "has_exe": f("has_exe") == 1,
        "is_ip_address": f("is_ip_address") == 1,
        "malicious_tld": f("malicious_tld") == 1,
        "has_at_symbol": f("has_at_symbol") == 1,
        "many_subdomains": f("subdomain_count") >= 4,
        "has_suspicious_words": f("has_suspicious_words") == 1,
        "long_hyphen_domain": (f("has_hyphen_domain") == 1) & (f("domain_length") > 20),
        "high_risk_score": f("security_risk_score") > 3,
        "high_entropy": f("domain_entropy") > 4,
        "has_https": f("has_https") == 1,
        "has_www": f("has_www") == 1,
    }


def score_result(scored: DataFrame, url: str = "url") -> DataFrame:
    """The whole result of scored URLs, their features as one struct."""
    return scored.withColumn("features", F.struct(*F1_COLUMNS)).select(
        *[c for c in scored.columns if c not in F1_COLUMNS and c != url], F.col(url).alias(url), "features")


def score_rules(features: DataFrame, url: str = "url", clamp: bool = False) -> DataFrame:
    """R1-R5 over an F1 table: ``rule_score, reasons, prediction, confidence, is_malicious``.

    clamp: confidences stay within 0 and 1 (a strongly negative score gives more than 1 otherwise).
    """
    cond = _conditions(F.col)
    host = F.lower(U.netloc(F.col(url)))
    staged = features.withColumn("_rhost", host)
    h = F.col("_rhost")
    hosting = None
    for suffix, reason in HOSTING_SUFFIXES:
        hosting = (F.when(h.endswith(suffix), F.lit(reason)) if hosting is None
                   else hosting.when(h.endswith(suffix), F.lit(reason)))
    staged = staged.withColumn("_hosting", hosting)
    score = F.lit(0)
    for key, _, pts in RULE_REASONS:
        score = score + F.when(cond[key], F.lit(pts)).otherwise(F.lit(0))
    score = score + F.when(F.col("_hosting").isNotNull(), F.lit(HOSTING_POINTS)).otherwise(F.lit(0))
    reasons = F.array_compact(F.array(
        *[F.when(cond[key], F.lit(text)) for key, text, _ in RULE_REASONS], F.col("_hosting")))
    staged = staged.withColumns({"rule_score": score, "reasons": reasons})
    s = F.col("rule_score")
    prediction = (F.when(s >= 8, F.lit("malware")).when(s >= 5, F.lit("phishing"))
                  .when(s >= 2, F.lit("defacement")).otherwise(F.lit("benign")))
    confidence = (F.when(s >= 8, F.least(F.lit(0.95), F.lit(0.7) + (s - 8) * F.lit(0.05)))
                  .when(s >= 5, F.least(F.lit(0.9), F.lit(0.6) + (s - 5) * F.lit(0.06)))
                  .when(s >= 2, F.least(F.lit(0.8), F.lit(0.4) + (s - 2) * F.lit(0.1)))
                  .otherwise(F.greatest(F.lit(0.6), F.lit(0.8) - s * F.lit(0.1))))
    if clamp:
        confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    staged = staged.withColumns({"prediction": prediction, "confidence": confidence})
    return staged.withColumn("is_malicious", is_malicious_type("prediction")).drop("_rhost", "_hosting")


def malicious(scored: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the scored rows that are malicious.

    The rows pass through ``inline``, so that each is scored once and the filter tests one column. Without it Catalyst pushes the filter
    below the projections and writes the whole derivation of ``is_malicious`` into it, with every shared part once for each use.
    """
    return scored.select(F.inline(F.array(F.struct("is_malicious", *columns)))).filter("is_malicious").select(*columns)


def legit_override(scored: DataFrame, url: str = "url", prediction: str = "prediction",
                   confidence: str = "confidence", strict: bool = False) -> DataFrame:
    """A non-benign prediction becomes benign when a listed domain is a substring of the host.

    strict: the host has to be the domain or end with a dot and the domain. The list is a fixed literal of 42 entries, so the test is an ``exists`` over a literal
    array inside the projection (no join at all).
    """
    host = F.lower(U.netloc(F.col(url)))
    listed = F.array(*[F.lit(d) for d in LEGIT_DOMAINS])
    hit = F.exists(listed, (lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))) if strict
                   else lambda d: F.contains(host, d))
    applied = (F.col(prediction) != F.lit("benign")) & hit
    probs = F.create_map(*[x for k, v in OVERRIDE_PROBABILITIES for x in (F.lit(k), F.lit(v))])
    out = scored.withColumn("override_applied", F.coalesce(applied, F.lit(False)))
    o = F.col("override_applied")
    out = out.withColumns({
        prediction: F.when(o, F.lit("benign")).otherwise(F.col(prediction)),
        confidence: F.when(o, F.lit(OVERRIDE_CONFIDENCE)).otherwise(F.col(confidence)),
    })
    if "probabilities" in scored.columns:
        out = out.withColumn("probabilities", F.when(o, probs).otherwise(F.col("probabilities")))
    return out.withColumn("is_malicious", is_malicious_type(prediction))


def model_then_rules(features: DataFrame, model=None, url: str = "url", strict: bool = False) -> DataFrame:
    """R6 in one pass over an F1 table: the model's prediction with the known-domain override and the
    rules' reasons; without a model the rules alone (``override_applied`` false)."""
    ruled = score_rules(features, url)
    if model is None:
        return ruled.withColumn("override_applied", F.lit(False))
    from .ml import score_batch
    scored = score_batch(model, ruled.drop("prediction", "confidence", "is_malicious"))
    return legit_override(scored, url, strict=strict)
