"""Aggregates (A1-A19), top-k and paging.

All aggregates are ``groupBy().agg()`` with Spark's partial (map-side) aggregation, so a hot
key is folded to one row per input partition before the shuffle. Quantiles of integer columns
(A14, A15) are exact and still skew-safe: values are first counted per (group, value) - a small
histogram - and the quantiles are read off the cumulative counts of that histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urlparts as U
from ..functions.constants import (DISPLAY_URL_CHARS, LENGTH_BUCKET_WIDTH, OTHER_CODE, PAGE_SIZE)
from ..functions.features import simple_risk_score
from .clean import is_not_benign, is_number


def counts_by_type(urls: DataFrame) -> DataFrame:
    """A1."""
    return urls.groupBy("type").agg(F.count(F.lit(1)).alias("cnt"))


def mal_domains(urls: DataFrame) -> DataFrame:
    """A2."""
    return urls.filter(is_not_benign("type")).groupBy("domain").agg(F.count(F.lit(1)).alias("cnt"))


def malicious_tld_counts(urls: DataFrame) -> DataFrame:
    """A3: null or empty suffix counts as ``unknown``."""
    tld = F.coalesce(F.nullif(F.col("tld"), F.lit("")), F.lit("unknown"))
    return (urls.filter(is_not_benign("type")).groupBy(tld.alias("tld"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def threat_scores(urls: DataFrame) -> DataFrame:
    """A4: sum, max, count and mean of the numeric threat scores per label.

    The "is a number" test (P9) is folded into the aggregate instead of a filter, so nothing is
    pushed into the enrichment plan; labels without any numeric score are dropped afterwards,
    as a map step that emits nothing for them would.
    """
    ok = is_number("threat_score")
    s = F.when(ok, F.col("threat_score").cast("double"))
    return (urls.groupBy("type")
            .agg(F.sum(s).alias("sum_score"), F.max(s).alias("max_score"),
                 F.count(s).alias("cnt"))
            .filter(F.col("cnt") > 0)
            .withColumn("avg_score", F.col("sum_score") / F.col("cnt")))


def url_length_by_type(urls: DataFrame, width: int = LENGTH_BUCKET_WIDTH) -> DataFrame:
    """Count per (label, 50-wide length bucket ``start-end``)."""
    ln = F.coalesce(F.col("url_length").cast("bigint"), F.lit(0))
    start = F.floor(ln / F.lit(width)) * F.lit(width)
    bucket = F.concat(start.cast("string"), F.lit("-"), (start + F.lit(width - 1)).cast("string"))
    label = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unknown"))
    return (urls.groupBy(label.alias("type"), bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def class_distribution(urls: DataFrame) -> DataFrame:
    """Count per label, largest first."""
    return counts_by_type(urls).orderBy(F.desc("cnt"), F.asc("type"))


def threat_summary(urls: DataFrame) -> DataFrame:
    """A8 (+A9): totals, malicious share and the unweighted mean of per-label mean scores.

    Two aggregation levels: per label (partial aggregation over all rows), then one global
    aggregate over the handful of label rows.
    """
    per_type = urls.groupBy("type").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.avg(F.when(~F.isnan(F.col("threat_score")), F.col("threat_score"))).alias("avg_score"))
    g = per_type.agg(
        F.sum("cnt").alias("total_urls"),
        F.sum(F.when(is_not_benign("type"), F.col("cnt")).otherwise(F.lit(0))).alias("malicious_urls"),
        F.avg("avg_score").alias("mean_avg"))
    total = F.coalesce(F.col("total_urls"), F.lit(0)).cast("bigint")
    mal = F.coalesce(F.col("malicious_urls"), F.lit(0)).cast("bigint")
    return g.select(
        total.alias("total_urls"), mal.alias("malicious_urls"), (total - mal).alias("benign_urls"),
        F.when(total > 0, F.round(mal / total * F.lit(100.0), 2)).otherwise(F.lit(0.0)).alias("threat_percentage"),
        F.round(F.coalesce(F.col("mean_avg"), F.lit(0.0)), 2).alias("avg_threat_score"))


def mean_of_type_means(urls: DataFrame) -> DataFrame:
    """Unweighted mean of the per-label mean threat scores."""
    return threat_scores(urls).agg(F.avg("avg_score").alias("avg_threat_score"))


def table_cardinalities(urls: DataFrame) -> DataFrame:
    """A10: row counts of urls and of three derived tables, in one row per table."""
    pairs = urls.groupBy("type", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_number("threat_score"), F.lit(1))).alias("scored"))
    # null is a group too, which a distinct count would leave out
    some = lambda c, when: F.count_distinct(F.when(when, F.struct(F.lit(1), c)))
    one = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("urls"), some("domain", is_not_benign("type")).alias("mal_domains"),
                    some("type", F.col("scored") > 0).alias("threat_scores"), some("type", F.lit(True)).alias("counts_by_type"))
    names = ("urls", "mal_domains", "threat_scores", "counts_by_type")
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("table_name"), F.col(n).alias("cnt")) for n in names])).alias("x")).select("x.*")


def type_share(urls: DataFrame) -> DataFrame:
    """Count and percent of all rows per label (1 dp).

    The grand total is a window over the per-label table, which has one row per label, so it
    runs over a handful of rows whatever the size of ``urls``.
    """
    c = counts_by_type(urls)
    total = F.sum("cnt").over(Window.partitionBy())
    return c.select("type", "cnt", F.round(F.col("cnt") / total * F.lit(100.0), 1).alias("pct"))


def _top(df: DataFrame, key: str, n: int, by: str = "cnt") -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(key)).limit(n)


def top_malicious_hosts(urls: DataFrame, n: int = 10) -> DataFrame:
    """Top hosts (full netloc) among non-benign rows."""
    hosts = (urls.filter(is_not_benign("type")).groupBy(U.netloc("url").alias("host"))
             .agg(F.count(F.lit(1)).alias("cnt")))
    return _top(hosts, "host", n)


def host_counts(urls: DataFrame) -> DataFrame:
    """Rows per netloc over all rows (A12's grouping without the label filter)."""
    return urls.groupBy(U.netloc("url").alias("host")).agg(F.count(F.lit(1)).alias("cnt"))


def top_host_labels(urls: DataFrame, n: int = 10) -> DataFrame:
    """Top last host labels over all rows; ``unknown`` for hosts without a dot."""
    nl = U.netloc("url")
    label = F.when(nl.contains("."), F.element_at(F.split(nl, r"[.]", -1), -1)).otherwise(F.lit("unknown"))
    c = urls.groupBy(label.alias("tld")).agg(F.count(F.lit(1)).alias("cnt"))
    return _top(c, "tld", n)


def quantiles_from_histogram(hist: DataFrame, group: str, probs=(0.25, 0.5, 0.75),
                             names=("q1", "median", "q3")) -> DataFrame:
    """Exact linear-interpolated quantiles per group from a ``(group, _v, _c)`` histogram.

    The cumulative count per group is a window over the histogram (one row per distinct
    value, so a hot group costs no more than its number of distinct values), and the k-th
    order statistic is the smallest value whose cumulative count exceeds k. Matches
    ``percentile`` / ``quantile_cont``.
    """
    w = Window.partitionBy(group).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.withColumns({"_cum": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(group))})
    aggs = [F.first("_n").alias("_n")]
    for p, name in zip(probs, names):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.min(F.when(F.col("_cum") > lo, F.col("_v"))).alias(f"_{name}_lo"))
        aggs.append(F.min(F.when(F.col("_cum") > hi, F.col("_v"))).alias(f"_{name}_hi"))
        aggs.append(F.first(pos - lo).alias(f"_{name}_f"))
    out = h.groupBy(group).agg(*aggs)
    for name in names:
        lo, hi, fr = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        out = out.withColumn(name, lo.cast("double") + fr * (hi - lo).cast("double"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def exact_int_quantiles(df: DataFrame, group: str, value: Column, probs=(0.25, 0.5, 0.75),
                        names=("q1", "median", "q3")) -> DataFrame:
    """Exact quantiles of an integer column per group, without sorting rows (see above)."""
    hist = df.groupBy(F.col(group), value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return quantiles_from_histogram(hist, group, probs, names)


def _box(urls: DataFrame, value: Column, outliers: bool) -> DataFrame:
    """Box statistics from one (type, value) histogram: one scan, one shuffle of the histogram.

    Count, min, max and mean, the quartiles and the outlier count are all read off the
    histogram, whose size is (labels × distinct lengths) whatever the number of rows.
    """
    hist = (urls.groupBy(F.col("type"), value.cast("bigint").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")))
    stats = hist.groupBy("type").agg(
        F.sum("_c").alias("n"), F.min("_v").alias("min_len"), F.max("_v").alias("max_len"),
        (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean_len"))
    out = stats.join(quantiles_from_histogram(hist, "type"), "type")
    if outliers:
        iqr = F.col("q3") - F.col("q1")
        out = out.withColumns({"lower_fence": F.col("q1") - F.lit(1.5) * iqr,
                               "upper_fence": F.col("q3") + F.lit(1.5) * iqr})
        fences = out.select("type", "lower_fence", "upper_fence")
        n_out = (hist.join(fences, "type")
                 .groupBy("type").agg(F.sum(F.when((F.col("_v") < F.col("lower_fence"))
                                                   | (F.col("_v") > F.col("upper_fence")), F.col("_c"))
                                            .otherwise(F.lit(0))).alias("n_outliers")))
        out = out.join(n_out, "type")
    return out


#: Size parameter of a quantile sketch, and the share of the rows by which a rank it gives may be off (with 99 % confidence).
SKETCH_K, SKETCH_RANK_ERROR = 4096, 0.001


def quantile_sketches(df: DataFrame, group: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """(group, n, sketch): a mergeable quantile sketch of the numbers of each group; nulls and NaN are left out.

    A sketch has some kilobytes whatever the number of rows, and sketches of parts (days, folders) merge to that of the whole.
    """
    # no filter on the value: it would stand in the plan with the value's whole derivation
    rows = df.select(F.col(group), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    return rows.groupBy(group).agg(F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch")).filter("n > 0")


def merge_sketches(sketches: DataFrame, group: str) -> DataFrame:
    """(group, n, sketch) of several tables of sketches put together."""
    return sketches.groupBy(group).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_box(sketches: DataFrame, probs=(0.25, 0.5, 0.75), names=("q1", "median", "q3")) -> DataFrame:
    """A14/A15 for any number column: quantiles and 1.5-IQR fences from sketches; each quantile's rank is right within
    ``SKETCH_RANK_ERROR`` of the rows (``SKETCH_K``), where ``_box`` counts every value of a whole number."""
    out = sketches
    for p, name in zip(probs, names):
        out = out.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))
    iqr = F.col(names[-1]) - F.col(names[0])
    return out.drop("sketch").withColumns({"lower_fence": F.col(names[0]) - F.lit(1.5) * iqr, "upper_fence": F.col(names[-1]) + F.lit(1.5) * iqr})


def url_length_box(urls: DataFrame) -> DataFrame:
    """Box statistics of URL length per label, with mean and 1.5-IQR outlier count."""
    return _box(urls, F.length("url"), outliers=True)


def domain_length_box(urls: DataFrame) -> DataFrame:
    """Box statistics of netloc length per label."""
    return _box(urls, F.length(U.netloc("url")), outliers=False)


def avg_risk_by_type(urls: DataFrame) -> DataFrame:
    """Mean simple risk score (F4) per label."""
    return urls.groupBy("type").agg(F.avg(simple_risk_score("url")).alias("avg_risk"))


def tld_share(urls: DataFrame, n: int = 20) -> DataFrame:
    """Top-n malicious suffixes with their percent of the shown total (1 dp)."""
    top = _top(malicious_tld_counts(urls), "tld", n)
    return top.select("tld", "cnt", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy()) * F.lit(100.0), 1).alias("pct"))


def country_map_data(country_counts: DataFrame) -> DataFrame:
    """Country counts without ``OTHER`` plus ``log1p(count)`` and its range."""
    c = country_counts.filter(F.col("country_code") != F.lit(OTHER_CODE))
    c = c.withColumn("log_cnt", F.log1p(F.col("cnt").cast("double")))
    allw = Window.partitionBy()
    return c.withColumns({"min_log": F.min("log_cnt").over(allw), "max_log": F.max("log_cnt").over(allw)})


def avg_score_by_type(urls: DataFrame) -> DataFrame:
    """A19."""
    return threat_scores(urls).select("type", "avg_score")


# --- T: sorts, limits, paging -----------------------------------------------------------------

def top_k(df: DataFrame, key: str, n: int, by: str = "cnt") -> DataFrame:
    """``n`` largest by ``by``, ties broken by ``key`` (TakeOrderedAndProject)."""
    return _top(df, key, n, by)


def page_of(df: DataFrame, page: int, order: list[Column], size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page`` (1-based) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset(max(page - 1, 0) * size).limit(size)


def rank_directory(df: DataFrame, count: str, name: str, letters: int = 4) -> DataFrame:
    """(count, first letters of name, size, before): how many rows stand before those of each count and beginning, by descending count and
    ascending name. One row for each different (count, beginning), however many rows share it."""
    sizes = df.groupBy(F.col(count).alias("_count"), F.substring(name, 1, letters).alias("_begin")).agg(F.count(F.lit(1)).alias("size"))
    # over the directory, not over the rows
    w = Window.orderBy(F.desc("_count"), F.asc("_begin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("before", F.sum("size").over(w) - F.col("size"))


def numbered_page(df: DataFrame, page: int, count: str = "cnt", name: str = "domain", size: int = PAGE_SIZE, letters: int = 4) -> DataFrame:
    """T3 by number: the same rows as ``page_of`` over (count descending, name), without gathering the pages before.

    The directory says which beginnings the page touches; only their rows are ranked, each beginning by itself.
    """
    first = max(page - 1, 0) * size
    touched = rank_directory(df, count, name, letters).filter((F.col("before") < first + size) & (F.col("before") + F.col("size") > first))
    rows = df.join(touched, (F.col(count) == F.col("_count")) & F.substring(name, 1, letters).eqNullSafe(F.col("_begin")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("_count", "_begin").orderBy(F.asc(name)))
    return rows.withColumn("_place", place).filter((F.col("_place") > first) & (F.col("_place") <= first + size)).select(*df.columns)


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: tuple | None, size: int = PAGE_SIZE) -> DataFrame:
    """T3/T4 by key: the ``size`` rows behind the row ``last`` of the page before (None: the first page).

    order: (column, descending), together a total order. Every task keeps ``size`` rows however deep the page is.
    """
    behind = F.lit(last is None)
    same = F.lit(True)
    for (name, down), value in zip(order, last or ()):
        c = F.col(name)
        behind = behind | (same & (c < F.lit(value) if down else c > F.lit(value)))
        same = same & (c == F.lit(value))
    keys = [F.desc(name) if down else F.asc(name) for name, down in order]
    return df.filter(behind).orderBy(*keys).limit(size)


def display_url(url: Column | str, n: int = DISPLAY_URL_CHARS) -> Column:
    """URL cut to ``n`` characters plus ``...`` when longer."""
    u = F.col(url) if isinstance(url, str) else url
    return F.when(F.length(u) > n, F.concat(F.substring(u, 1, n), F.lit("..."))).otherwise(u)


def named_counts(df: DataFrame, name: str = "domain", count: str = "cnt") -> DataFrame:
    """Result rows as they are shown: the group under ``name``, its count with separators under ``value``."""
    return df.select(F.col(name).alias("name"), thousands(count).alias("value"))


def thousands(col: Column | str) -> Column:
    """Integer with thousands separators."""
    c = F.col(col) if isinstance(col, str) else col
    return F.format_number(c.cast("bigint"), 0)
