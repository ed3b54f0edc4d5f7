"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator ID.

Inputs are the driver tables; ``urls`` is the enriched ``urls_raw`` fixture (one row per page)
and ``feed`` the enriched ``url_feed`` fixture (one row per event). Doubles are rounded to six
places so results compare exactly with the SQL twins in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urlparts as U
from ..functions.constants import CHART_DOMAINS_N, PREVIEW_ROWS, TOP_DOMAINS_N
from ..functions.features import (F1_COLUMNS, char_entropy, lexical_features, quick_features,
                                  simple_risk_score, training_features)
from ..functions.constants import TRAINING_FEATURES
from ..operators import aggregates as A
from ..operators import clean as P
from ..operators import lookup as L
from ..operators import outliers as Z
from ..operators import rules as R
from ..operators import sampling as M
from ..operators.enrich import enrich_urls
from ..operators.suffix import resolve_suffix
from ..functions.literals import literal_table
from ..sources.fixtures import COUNTRY_DIM, SEARCH_DIM, SEARCH_NAMES, SEARCH_PLACES, url_feed, urls_raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Parameters of the registered queries (fixed; the SQL twins use the same values).
SAMPLE_N = 100
STRAT_N, STRAT_FLOOR = 60, 10
RANDOM_SEED = "7"
PAGE_NO = 2


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(col):
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def urls(spark, sf) -> DataFrame:
    return enrich_urls(urls_raw(spark, sf))


def feed(spark, sf) -> DataFrame:
    return enrich_urls(url_feed(spark, sf))


def features(spark, sf) -> DataFrame:
    return lexical_features(urls(spark, sf))


def scored(spark, sf) -> DataFrame:
    return R.score_rules(features(spark, sf))


# --- P: cleaning and predicates -----------------------------------------------------------

@query
def clean_urls(spark, sf):
    return P.clean_urls(urls_raw(spark, sf)).select("page_id", "url", "type")


@query
def normalize_url(spark, sf):
    c = P.clean_urls(urls_raw(spark, sf))
    return c.select("page_id", P.normalize_url("url", strip=False).alias("url"))


@query
def default_label(spark, sf):
    return urls_raw(spark, sf).select("page_id", P.default_label("type").alias("type"))


@query
def enrich(spark, sf):
    e = urls(spark, sf)
    return e.withColumn("threat_score", r6("threat_score"))


@query
def malicious_only(spark, sf):
    return urls(spark, sf).filter(P.is_not_benign("type")).select("page_id", "type")


@query
def is_malicious_type(spark, sf):
    return urls(spark, sf).select("page_id", "type", P.is_malicious_type("type").alias("is_malicious"))


@query
def project_columns(spark, sf):
    return urls(spark, sf).select("page_id", "url", "type", "domain")


@query
def drop_null_rows(spark, sf):
    return P.drop_null_rows(urls_raw(spark, sf)).select("page_id", "url", "type")


@query
def drop_null_rows_mixed(spark, sf):
    """P8 where it has something to drop."""
    u = urls_raw(spark, sf)
    u = u.select("page_id", F.when(F.col("page_id") % 7 != 2, F.col("url")).alias("url"), F.when(F.col("page_id") % 11 != 3, F.col("type")).alias("type"))
    return P.drop_null_rows(u)


@query
def numeric_only_mixed(spark, sf):
    """P9 over a text column with nulls, words and NaN."""
    score = (F.when(F.col("page_id") % 5 == 1, F.lit("high")).when(F.col("page_id") % 5 == 2, F.lit("NaN"))
             .when(F.col("page_id") % 5 > 2, F.col("url_length").cast("string")))
    u = urls(spark, sf).select("page_id", score.alias("threat_score"))
    return P.numeric_only(u).select("page_id", F.col("threat_score").cast("double").alias("threat_score"))


@query
def numeric_only(spark, sf):
    return P.numeric_only(urls(spark, sf)).select("page_id", r6("threat_score").alias("threat_score"))


@query
def match_class(spark, sf):
    return urls(spark, sf).filter(F.col("type") == "phishing").select("page_id", "url")


# --- J: joins -------------------------------------------------------------------------------

@query
def restrict_to_sample(spark, sf):
    u = urls(spark, sf)
    sample = M.fixed_sample(u.select("page_id"), SAMPLE_N, "page_id")
    return A.counts_by_type(M.restrict_to_sample(u, sample, "page_id"))


@query
def country_lookup(spark, sf):
    f = feed(spark, sf)
    names = f.select(F.coalesce(F.nullif(F.col("country"), F.lit("")), F.lit("Unknown")).alias("country")).distinct()
    dim = L._bounded(L._names(L.country_dim(spark, COUNTRY_DIM)))
    j = names.join(dim, F.lower(F.trim("country")) == F.col("key"), "left")
    ok = F.col("alpha_3").isNotNull() & (F.col("country") != "Unknown")
    return j.select("country", F.when(ok, F.col("alpha_3")).otherwise(F.lit("OTHER")).alias("country_code"),
                    F.when(ok, F.col("canonical")).otherwise(F.lit("Other/Unknown")).alias("country_name"))


@query
def country_lookup_fuzzy(spark, sf):
    return L.country_lookup_fuzzy(feed(spark, sf), L.country_dim(spark, COUNTRY_DIM))


@query
def resolve_suffix_query(spark, sf):
    c = P.clean_urls(urls_raw(spark, sf))
    n = c.select("page_id", P.normalize_url("url", strip=False).alias("url"))
    return resolve_suffix(n).select("page_id", "subdomain", "domain_label", "suffix")


@query
def legit_override(spark, sf):
    s = R.legit_override(scored(spark, sf))
    return s.select("page_id", "prediction", r6("confidence").alias("confidence"), "override_applied", "is_malicious")


# --- A: aggregates --------------------------------------------------------------------------

@query
def counts_by_type(spark, sf):
    return A.counts_by_type(urls(spark, sf))


@query
def mal_domains(spark, sf):
    return A.mal_domains(urls(spark, sf))


@query
def malicious_tld_counts(spark, sf):
    return A.malicious_tld_counts(urls(spark, sf))


@query
def threat_scores(spark, sf):
    t = A.threat_scores(urls(spark, sf))
    return t.select("type", r6("sum_score").alias("sum_score"), r6("max_score").alias("max_score"),
                    "cnt", r6("avg_score").alias("avg_score"))


@query
def country_counts(spark, sf):
    return L.country_counts(feed(spark, sf), L.country_dim(spark, COUNTRY_DIM))


@query
def url_length_by_type(spark, sf):
    return A.url_length_by_type(urls(spark, sf))


@query
def class_distribution(spark, sf):
    return A.class_distribution(urls(spark, sf))


@query
def threat_summary(spark, sf):
    return A.threat_summary(urls(spark, sf))


@query
def mean_of_type_means(spark, sf):
    return A.mean_of_type_means(urls(spark, sf)).select(r6("avg_threat_score").alias("avg_threat_score"))


@query
def table_cardinalities(spark, sf):
    return A.table_cardinalities(urls(spark, sf))


@query
def type_share(spark, sf):
    return A.type_share(urls(spark, sf))


@query
def top_malicious_hosts(spark, sf):
    return A.top_malicious_hosts(urls(spark, sf))


@query
def top_host_labels(spark, sf):
    return A.top_host_labels(urls(spark, sf))


@query
def url_length_box(spark, sf):
    b = A.url_length_box(urls(spark, sf))
    return b.select("type", "n", "min_len", "max_len", *[r6(c).alias(c) for c in
                    ("mean_len", "q1", "median", "q3", "lower_fence", "upper_fence")], "n_outliers")


@query
def domain_length_box(spark, sf):
    b = A.domain_length_box(urls(spark, sf))
    return b.select("type", "n", "min_len", "max_len", *[r6(c).alias(c) for c in ("mean_len", "q1", "median", "q3")])


@query
def avg_risk_by_type(spark, sf):
    return A.avg_risk_by_type(urls(spark, sf)).select("type", r6("avg_risk").alias("avg_risk"))


@query
def tld_share(spark, sf):
    return A.tld_share(urls(spark, sf))


@query
def country_map_data(spark, sf):
    c = A.country_map_data(L.country_counts(feed(spark, sf), L.country_dim(spark, COUNTRY_DIM)))
    return c.select("country_code", "country_name", "cnt", *[r6(x).alias(x) for x in ("log_cnt", "min_log", "max_log")])


@query
def avg_score_by_type(spark, sf):
    return A.avg_score_by_type(urls(spark, sf)).select("type", r6("avg_score").alias("avg_score"))


@query
def country_search(spark, sf):
    """J2b as a search: events by the code that their country's name is found under, and how."""
    names = F.array(*[F.lit(n) for n, _, _ in SEARCH_NAMES])
    events = url_feed(spark, sf).select(F.element_at(names, (F.col("event_id") % len(SEARCH_NAMES) + 1).cast("int")).alias("country"))
    found = L.country_search(events, L.country_dim(spark, SEARCH_DIM), literal_table(spark, SEARCH_PLACES, "place string, alpha_3 string"))
    return events.join(found, "country").groupBy("country_code", "found_by").agg(F.count(F.lit(1)).alias("cnt"))


# --- T: sorts, limits, paging ---------------------------------------------------------------

@query
def top_k(spark, sf):
    return A.top_k(A.mal_domains(urls(spark, sf)), "domain", TOP_DOMAINS_N)


@query
def chart_top_n(spark, sf):
    return A.top_k(A.mal_domains(urls(spark, sf)), "domain", CHART_DOMAINS_N)


@query
def page_of_domains(spark, sf):
    return A.page_of(A.mal_domains(urls(spark, sf)), PAGE_NO, [F.desc("cnt"), F.asc("domain")])


@query
def numbered_page_of_domains(spark, sf):
    """T3 by number, through the directory of ranks."""
    return A.numbered_page(A.mal_domains(urls(spark, sf)), PAGE_NO)


@query
def named_counts(spark, sf):
    """The first page of malicious domains as result rows."""
    return A.named_counts(A.numbered_page(A.mal_domains(urls(spark, sf)), 1))


@query
def next_page_of_domains(spark, sf):
    """T3 by key: the page behind the last row of the first one."""
    order = [("cnt", True), ("domain", False)]
    c = A.mal_domains(urls(spark, sf))
    for_last = A.page_after(c, order, None).orderBy("cnt", F.desc("domain")).first()
    return A.page_after(c, order, (for_last["cnt"], for_last["domain"]) if for_last else None)


@query
def recent_urls(spark, sf):
    return A.page_of(urls(spark, sf).select("page_id", "url", "type"), 1, [F.desc("page_id")])


@query
def top_features_per_url(spark, sf):
    f = features(spark, sf)
    # sorted within the row: descending value, then the features' order; no shuffle
    all_features = F.array(*[F.struct((-F.col(c).cast("double")).alias("minus"), F.lit(i).alias("pos"), F.lit(c).alias("feature"))
                             for i, c in enumerate(F1_COLUMNS)])
    top = F.slice(F.array_sort(F.filter(all_features, lambda x: x["minus"] < 0)), 1, 10)
    return (f.select("page_id", F.posexplode(top).alias("at", "x"))
            .select("page_id", "x.feature", r6(-F.col("x.minus")).alias("value"), (F.col("at") + 1).alias("rnk")))


@query
def display_rows(spark, sf):
    u = urls(spark, sf)
    return u.select("page_id", A.display_url("url").alias("url_display"), "type",
                    A.thousands("url_length").alias("url_length_display"))


@query
def sample_preview(spark, sf):
    return A.url_length_by_type(urls(spark, sf)).orderBy("type", "bucket").limit(PREVIEW_ROWS)


# --- F: features ----------------------------------------------------------------------------

@query
def lexical(spark, sf):
    f = features(spark, sf)
    dbl = {"digit_ratio", "domain_entropy", "security_risk_score"}
    return f.select("page_id", *[r6(c).alias(c) if c in dbl else F.col(c) for c in F1_COLUMNS])


@query
def failed_features(spark, sf):
    """F1 where it fails: every fourth URL is null, every fourth has brackets that hold no address."""
    u = urls(spark, sf)
    bad = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://[bad"), "page_id", F.lit("/x"))).when(F.col("page_id") % 4 != 1, F.col("url"))
    f = lexical_features(u.withColumn("url", bad))
    dbl = {"digit_ratio", "domain_entropy", "security_risk_score"}
    return f.select("page_id", *[r6(c).alias(c) if c in dbl else F.col(c) for c in F1_COLUMNS])


@query
def training(spark, sf):
    f = training_features(urls(spark, sf))
    return f.select("page_id", *[r6(c).alias(c) if c == "digit_ratio" else F.col(c) for c in TRAINING_FEATURES])


QUICK_COLUMNS = ["url_length", "domain_length", "special_char_count", "digit_count", "digit_ratio",
                 "is_ip_address", "has_suspicious_words", "security_risk_score", "path_length",
                 "dir_count", "has_www", "has_params", "has_https"]


@query
def quick(spark, sf):
    f = quick_features(urls(spark, sf))
    return f.select("page_id", *[r6(c).alias(c) if c == "digit_ratio" else F.col(c) for c in QUICK_COLUMNS])


@query
def simple_risk(spark, sf):
    return urls(spark, sf).select("page_id", simple_risk_score("url").alias("risk_score"))


@query
def char_entropy_query(spark, sf):
    return urls(spark, sf).select("page_id", r6(char_entropy(F.col("url"))).alias("entropy"))


@query
def url_parts(spark, sf):
    c = P.clean_urls(urls_raw(spark, sf))
    n = c.select("page_id", P.normalize_url("url", strip=False).alias("url"))
    return n.select("page_id", *U.url_parts("url"))


# --- R: rules -------------------------------------------------------------------------------

@query
def rule_score(spark, sf):
    return scored(spark, sf).select("page_id", "rule_score")


@query
def rule_reasons(spark, sf):
    return scored(spark, sf).select("page_id", F.array_join("reasons", "; ").alias("reasons"))


@query
def rule_prediction(spark, sf):
    return scored(spark, sf).select("page_id", "prediction")


@query
def rule_confidence(spark, sf):
    return scored(spark, sf).select("page_id", r6("confidence").alias("confidence"))


@query
def score_urls(spark, sf):
    return scored(spark, sf).select("page_id", "url", "prediction", r6("confidence").alias("confidence"),
                                    "is_malicious", "rule_score",
                                    F.array_join("reasons", "; ").alias("reasons"))


@query
def score_result(spark, sf):
    """R5 with the features that the score was taken from."""
    out = R.score_result(scored(spark, sf).select("page_id", "url", "prediction", "confidence", "is_malicious", "rule_score", "reasons", *F1_COLUMNS))
    dbl = {"digit_ratio", "domain_entropy", "security_risk_score"}
    return out.select("page_id", "url", "prediction", r6("confidence").alias("confidence"), "is_malicious", "rule_score", F.array_join("reasons", "; ").alias("reasons"),
                      *[r6(F.col(f"features.{c}")).alias(c) if c in dbl else F.col(f"features.{c}").alias(c) for c in F1_COLUMNS])


@query
def quantile_sketch_facts(spark, sf):
    """A14 for a number column: sketches of three parts of the rows, merged; the rank of every quartile is within the stated error."""
    u = features(spark, sf).select("page_id", "type", "digit_ratio")
    parts = [A.quantile_sketches(u.filter(F.col("page_id") % 3 == i), "type", "digit_ratio") for i in range(3)]
    box = A.sketch_box(A.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), "type"))
    x = F.col("digit_ratio")
    ranks = u.join(box, "type").groupBy("type").agg(F.first("n").alias("n"), *[e for q in ("q1", "median", "q3") for e in (
        F.avg((x < F.col(q)).cast("double")).alias(f"{q}_below"), F.avg((x <= F.col(q)).cast("double")).alias(f"{q}_upto"))])
    near = F.lit(True)
    for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        near = near & (F.col(f"{q}_below") <= p + A.SKETCH_RANK_ERROR) & (F.col(f"{q}_upto") >= p - A.SKETCH_RANK_ERROR)
    return ranks.select("type", "n", near.alias("within_error"))


# --- M, U: sampling -------------------------------------------------------------------------

@query
def fixed_sample(spark, sf):
    return M.fixed_sample(urls(spark, sf).select("page_id", "url", "type"), SAMPLE_N, "page_id")


@query
def stratified_sample(spark, sf):
    u = urls(spark, sf).select("page_id", "type")
    return M.stratified_sample(u, STRAT_N, "page_id", floor=STRAT_FLOOR)


@query
def stratified_split(spark, sf):
    return M.stratified_split(urls(spark, sf).select("page_id", "type"), "page_id")


@query
def random_url(spark, sf):
    u = urls(spark, sf).select("page_id", "url", "type")
    return M.fixed_sample(u, 1, "page_id", seed=RANDOM_SEED).select("url", "type")


@query
def augment_training(spark, sf):
    return M.augment_training(urls(spark, sf))


# --- Z: outliers ----------------------------------------------------------------------------

@query
def zscore_outliers(spark, sf):
    h = A.host_counts(urls(spark, sf))
    return Z.zscore_outliers(h, "cnt").select("host", "cnt", r6("z").alias("z"))


@query
def outlier_lengths(spark, sf):
    """Z1 over a table of more than ten groups: rows by URL length in steps of two, one group made large."""
    step = F.when(F.col("page_id") % 2 == 0, F.lit(-1)).otherwise(F.floor(F.col("url_length") / 2)).cast("bigint")
    c = urls(spark, sf).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("cnt"))
    return Z.zscore_outliers(c, "cnt").select("step", "cnt", r6("z").alias("z"))


@query
def outlier_types(spark, sf):
    c = A.counts_by_type(urls(spark, sf))
    return Z.zscore_outliers(c, "cnt").select("type", "cnt", r6("z").alias("z"))


@query
def outlier_scores(spark, sf):
    t = A.threat_scores(urls(spark, sf)).select("type", "avg_score")
    return Z.zscore_outliers(t, "avg_score").select("type", r6("avg_score").alias("avg_score"), r6("z").alias("z"))


# Registered names follow the operator IDs of SURVEY §2 where a Python name would clash.
for _old, _new in {"enrich": "enrich_urls", "lexical": "lexical_features", "training": "training_features",
                   "quick": "quick_features", "simple_risk": "simple_risk_score",
                   "char_entropy_query": "char_entropy", "resolve_suffix_query": "resolve_suffix"}.items():
    QUERIES[_new] = QUERIES.pop(_old)

from . import catalog_more  # noqa: E402,F401  (registers the ML, source and streaming queries)
