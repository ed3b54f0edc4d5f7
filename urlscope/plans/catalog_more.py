"""Registered ML, source/sink and streaming queries (L*, R6, S*, W*).

Queries with side effects write only below the shared checkpoint folder
(``spark.checkpoint.dir``), each run into a fresh sub-folder.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions.constants import TRAINING_FEATURES
from ..functions.features import F1_COLUMNS, lexical_features, training_features
from ..operators import aggregates as A
from ..operators import ml as ML
from ..operators import rules as R
from ..operators import sampling as M
from ..operators.suffix import rules_frame
from ..session import scratch_path
from ..sources import files as S
from ..sources.fixtures import url_feed, urls_raw
from ..streaming import streams as W
from .catalog import QUERIES, feed, query, r6, scored, urls

#: Most labelled rows of a fit: a stratified sample (M2) with at least FIT_FLOOR rows of a label.
FIT_ROWS, FIT_FLOOR = 20_000, 1_000


def _fit_and_test(df, key="page_id"):
    """(rows of the fit, rows to predict): the whole table is split, the bounded sample is
    taken within its train part, and its test part stays whole. Both are read from what the split has written."""
    split = M.stratified_split(df, key)
    path = scratch_path(df.sparkSession, "fit")
    M.stratified_sample(_part(split, "train"), FIT_ROWS, key, floor=FIT_FLOOR).write.parquet(path)
    return df.sparkSession.read.parquet(path), _part(split, "test")


def _part(df, name):
    return df.filter(F.col("split") == name)


def _fit_forest(rows):
    return ML.train_forest(rows, F1_COLUMNS)


def _fit_text(rows):
    """L5 with U1: the hosting examples join the training rows."""
    return ML.train_text(M.augment_training(rows))


def _text_split(spark, sf):
    return _fit_and_test(urls(spark, sf).select("page_id", "url", "type"))


# --- L: learning ----------------------------------------------------------------------------

@query
def index_labels(spark, sf):
    return ML.index_labels(urls(spark, sf).select("page_id", "type"))


@query
def scale_features(spark, sf):
    t = training_features(urls(spark, sf)).select("page_id", *TRAINING_FEATURES)
    s = ML.scale_exact(t, TRAINING_FEATURES)
    return s.select("page_id", *[r6(c).alias(c) for c in TRAINING_FEATURES])


@query
def train_gbt(spark, sf):
    fit, test = _fit_and_test(training_features(urls(spark, sf)))
    return ML.predict(ML.train_gbt(fit), test).select("page_id", "type", "prediction")


@query
def train_forest(spark, sf):
    fit, test = _fit_and_test(lexical_features(urls(spark, sf)))
    return ML.predict(_fit_forest(fit), test).select("page_id", "type", "prediction")


@query
def train_text(spark, sf):
    fit, test = _text_split(spark, sf)
    return ML.predict(_fit_text(fit), test).select("page_id", "type", "prediction")


def _model_facts(model, fit, test, importance):
    """What must hold of any fitted model: rows of the fit and of the test part, classes, probabilities, importances, accuracy."""
    scored = ML.score_batch(model, test)
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    top = F.array_max(F.map_values("probabilities"))
    one = scored.agg(F.count("*").alias("n_test"), F.bool_and(F.abs(total - 1) < 1e-6).alias("sums_to_one"),
                     F.bool_and(F.abs(top - F.col("confidence")) < 1e-9).alias("confidence_is_largest"),
                     F.avg((F.col("type") == F.col("prediction")).cast("double")).alias("acc"),
                     F.max(F.size("probabilities")).alias("n_classes"))
    most = test.groupBy("type").count().agg(F.max("count").alias("most"))
    whole = importance is None or abs(sum(i for _, i in importance) - 1) < 1e-6
    return (one.crossJoin(most).select(F.lit(fit.count()).alias("n_train"), "n_test", "n_classes", "sums_to_one", "confidence_is_largest",
                                       (F.col("acc") * F.col("n_test") >= F.col("most")).alias("at_least_majority"),
                                       F.lit(whole).alias("importances_sum_to_one")))


@query
def gbt_facts(spark, sf):
    fit, test = _fit_and_test(training_features(urls(spark, sf)))
    model = ML.train_gbt(fit)
    return _model_facts(model, fit, test, ML.feature_importance(model))


@query
def forest_facts(spark, sf):
    fit, test = _fit_and_test(lexical_features(urls(spark, sf)))
    model = _fit_forest(fit)
    return _model_facts(model, fit, test, ML.feature_importance(model, F1_COLUMNS))


@query
def text_facts(spark, sf):
    fit, test = _text_split(spark, sf)
    return _model_facts(_fit_text(fit), fit, test, None)


def _rule_pairs(spark, sf):
    return scored(spark, sf).select("page_id", "type", "prediction")


@query
def accuracy(spark, sf):
    return ML.accuracy(_rule_pairs(spark, sf)).select(r6("accuracy").alias("accuracy"))


@query
def classification_report(spark, sf):
    rep = ML.classification_report(_rule_pairs(spark, sf))
    return rep.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def confusion_matrix(spark, sf):
    return ML.confusion_matrix(_rule_pairs(spark, sf))


@query
def feature_importance(spark, sf):
    model = ML.train_gbt(_fit_and_test(training_features(urls(spark, sf)))[0])
    return spark.createDataFrame(ML.feature_importance(model), "feature string, importance double")


@query
def score_batch(spark, sf):
    """Fitted on the sample, every row is scored."""
    out = ML.score_batch(_fit_text(_text_split(spark, sf)[0]), urls(spark, sf).select("page_id", "url", "type"))
    return out.select("page_id", "prediction", "confidence", F.to_json("probabilities").alias("probabilities"))


@query
def model_then_rules(spark, sf):
    """Model prediction, known-domain override, rule reasons, in one pass over the features."""
    out = R.model_then_rules(lexical_features(urls(spark, sf)), _fit_text(_text_split(spark, sf)[0]))
    return out.select("page_id", "prediction", "confidence", "is_malicious", "override_applied",
                      F.to_json("probabilities").alias("probabilities"), F.array_join("reasons", "; ").alias("reasons"))


@query
def rules_without_model(spark, sf):
    """R6 where there is no model: the rules alone."""
    out = R.model_then_rules(lexical_features(urls(spark, sf)))
    return out.select("page_id", "prediction", r6("confidence").alias("confidence"), "override_applied")


@query
def override_facts(spark, sf):
    """Every row on a listed host, scored as if the model had called it malware."""
    u = urls(spark, sf).select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://google.com.evil.ru/"), "page_id"))
                               .when(F.col("page_id") % 3 == 1, F.concat(F.lit("http://mail.google.com/"), "page_id")).otherwise(F.lit("http://evil.ru/")).alias("url"))
    bad = u.select("page_id", "url", F.lit("malware").alias("prediction"), F.lit(0.8).alias("confidence"))
    loose, strict = R.legit_override(bad), R.legit_override(bad, strict=True)
    strict = strict.select("page_id", F.col("override_applied").alias("strict_applied"))
    return loose.join(strict, "page_id").select("page_id", "prediction", "confidence", "is_malicious", "override_applied", "strict_applied")


@query
def save_model(spark, sf):
    """Persist a fitted pipeline with its metadata, load both back and score with the loaded copy."""
    fit, test = _fit_and_test(lexical_features(urls(spark, sf)))
    model = _fit_forest(fit)
    path, about = scratch_path(spark, "model"), scratch_path(spark, "model-about")
    model.write().overwrite().save(path)
    one = ML.accuracy(ML.predict(model, test)).select(
        F.lit("forest").alias("kind"), F.lit(fit.count()).alias("n_train"), F.array(*[F.lit(c) for c in F1_COLUMNS]).alias("features"),
        F.array(*[F.lit(c) for c in ML.labels_of(model)]).alias("labels"), "accuracy")
    S.overwrite_result(one, about)
    loaded, features = PipelineModel.load(path), spark.read.parquet(about).first()["features"]
    if list(features) != F1_COLUMNS:
        raise ValueError("the model was fitted on other features")
    return ML.predict(loaded, test).select("page_id", "prediction")


# --- S: sources and sinks -------------------------------------------------------------------

def _raw(spark, sf):
    return urls_raw(spark, sf).select("url", "type")


@query
def read_raw_urls(spark, sf):
    path = scratch_path(spark, "raw-semicolon")
    S.write_raw_csv(_raw(spark, sf), path, sep=";", header=False)
    return S.read_raw_urls(spark, path)


@query
def drop_header_row(spark, sf):
    path = scratch_path(spark, "raw-header")
    S.write_raw_csv(_raw(spark, sf), path, sep=",", header=True)
    return S.read_raw_urls(spark, path)


@query
def split_fallback(spark, sf):
    path = scratch_path(spark, "raw-text")
    _raw(spark, sf).select(F.concat_ws(" ", "url", "type").alias("value")).write.mode("overwrite").text(path)
    return S.read_raw_urls(spark, path)


@query
def pick_source(spark, sf):
    real = scratch_path(spark, "raw-tab")
    S.write_raw_csv(_raw(spark, sf), real, sep="\t", header=True)
    chosen = S.pick_source(spark, [scratch_path(spark, "missing"), real])
    return S.read_raw_urls(spark, chosen)


ENRICHED_SCHEMA = ("page_id bigint, url string, type string, domain string, subdomain string, tld string, "
                   "path string, query string, scheme string, has_https boolean, url_length bigint, "
                   "num_subdomains bigint, country string, threat_score double")


@query
def write_jsonl(spark, sf):
    """S5 + S6: JSON lines out, one malformed line added, read back dropping it."""
    path = scratch_path(spark, "jsonl")
    S.write_jsonl(urls(spark, sf), path)
    spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(path)
    back = S.read_jsonl(spark, path, ENRICHED_SCHEMA)
    return back.withColumn("threat_score", r6("threat_score"))


@query
def read_jsonl(spark, sf):
    """Every seventh row's line is cut short; the reader's kept and dropped lines, counted."""
    path = scratch_path(spark, "jsonl-cut")
    u = urls(spark, sf)
    line = F.to_json(F.struct(*u.columns))
    u.select(F.when(F.col("page_id") % 7 == 3, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return S.jsonl_line_counts(spark, path, ENRICHED_SCHEMA)


@query
def append_urls(spark, sf):
    path = scratch_path(spark, "appended")
    raw = urls_raw(spark, sf)
    S.append_urls(raw, path)
    return S.append_urls(raw, path)[0]


@query
def append_urls_total(spark, sf):
    """The rows a second call added, and all that are stored then."""
    path = scratch_path(spark, "appended-total")
    raw = urls_raw(spark, sf)
    S.append_urls(raw, path)
    stored, added = S.append_urls(raw, path)
    return stored.agg(F.lit(added).alias("added"), F.count("*").alias("stored"))


@query
def overwrite_result(spark, sf):
    path = scratch_path(spark, "counts")
    c = A.counts_by_type(urls(spark, sf))
    S.overwrite_result(c, path)
    return S.overwrite_result(c, path)


@query
def upsert_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    pairs = _rule_pairs(spark, sf)
    m = ML.metrics_rows(pairs).withColumn("value", r6("value"))
    S.overwrite_result(m, path)
    return S.overwrite_result(m, path)


@query
def model_metrics_facts(spark, sf):
    """S9 of a fitted model: its whole metrics are stored over older ones and read back."""
    fit, test = _fit_and_test(lexical_features(urls(spark, sf)))
    model, path = _fit_forest(fit), scratch_path(spark, "model-metrics")
    S.overwrite_result(ML.metrics_rows(_rule_pairs(spark, sf)), path)
    m = S.overwrite_result(ML.metrics_rows(ML.predict(model, test).select("type", "prediction"), ML.feature_importance(model, F1_COLUMNS)), path)
    one = {p: F.sum(F.when(F.col("part") == p, F.col("value"))) for p in ("importance", "matrix")}
    support = F.sum(F.when((F.col("part") == "support") & ~F.col("a").isin("macro avg", "weighted avg"), F.col("value")))
    return m.agg(F.count_if(F.col("part") == "importance").alias("features"), (F.abs(one["importance"] - 1) < 1e-6).alias("importances_sum_to_one"),
                 one["matrix"].cast("bigint").alias("n_test"), support.cast("bigint").alias("support"),
                 F.count_if((F.col("part").isin("accuracy", "precision", "recall", "f1")) & ~F.col("value").between(0, 1)).alias("out_of_range"))


@query
def score_batch_facts(spark, sf):
    """One row for every URL, probabilities that sum to 1, the largest as confidence."""
    out = ML.score_batch(_fit_text(_text_split(spark, sf)[0]), urls(spark, sf).select("page_id", "url", "type"))
    p = F.map_values("probabilities")
    return out.agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("ids"), F.bool_and(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6).alias("sums_to_one"),
                   F.bool_and(F.col("confidence") == F.array_max(p)).alias("confidence_is_largest"), F.max(F.size("probabilities")).alias("n_classes"))


@query
def model_then_rules_facts(spark, sf):
    """One row for every URL; an override always says benign, whatever the model says."""
    out = R.model_then_rules(lexical_features(urls(spark, sf)), _fit_text(_text_split(spark, sf)[0]))
    return out.agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("ids"), F.bool_and(~F.col("override_applied") | (F.col("prediction") == "benign")).alias("overrides_are_benign"),
                   F.bool_and(F.col("confidence").between(0, 1)).alias("confidence_in_range"), F.bool_and(F.col("reasons").isNotNull()).alias("reasons_given"))


@query
def save_model_facts(spark, sf):
    """The loaded copy predicts every row as the fitted model does."""
    fit, test = _fit_and_test(lexical_features(urls(spark, sf)))
    model, path = _fit_forest(fit), scratch_path(spark, "model")
    model.write().overwrite().save(path)
    one = ML.predict(model, test).select("page_id", F.col("prediction").alias("one"))
    two = ML.predict(PipelineModel.load(path), test).select("page_id", F.col("prediction").alias("two"))
    return one.join(two, "page_id").agg(F.count("*").alias("n_test"), F.bool_and(F.col("one") == F.col("two")).alias("equal"))


@query
def with_fallback_source(spark, sf):
    csv = scratch_path(spark, "raw-pipe")
    S.write_raw_csv(_raw(spark, sf), csv, sep="|", header=True)
    store = scratch_path(spark, "empty-store")
    _raw(spark, sf).filter("false").write.parquet(store)
    return S.with_fallback_source(spark, store, csv)


def _named(spark, sf):
    """Rows with a URL and a label."""
    return urls_raw(spark, sf).filter(F.length(F.trim("url")) > 0).select("page_id", "url", F.coalesce(F.nullif("type", F.lit("")), F.lit("none")).alias("type"))


def _untidy_folder(spark, sf):
    """A folder of three files: one with a header, one with none, one with odd lines."""
    path = scratch_path(spark, "raw-untidy")
    part = _named(spark, sf)
    S.write_raw_csv(part.filter("page_id % 3 = 0"), path, header=True)
    S.write_raw_csv(part.filter("page_id % 3 = 1"), path, header=False, mode="append")
    odd = part.filter("page_id % 3 = 2")
    three = F.concat("url", F.lit("/x,y,"), "type")
    quoted = F.concat(F.lit('"'), F.col("url"), F.lit('/a,b",'), F.col("type"))
    odd.select(F.when(F.col("page_id") % 2 == 0, three).otherwise(quoted).alias("value")).write.mode("append").text(path)
    return path


@query
def read_raw_folder(spark, sf):
    """S1-S3 over a folder whose files differ: header rows in one file, quoted commas in another."""
    return S.read_raw_urls(spark, _untidy_folder(spark, sf))


@query
def rejected_lines(spark, sf):
    """Lines of three fields, which are neither cut nor lost."""
    return S.rejected_lines(spark, _untidy_folder(spark, sf))


@query
def read_raw_bare(spark, sf):
    """Four lines of five hold a URL alone; the others decide the separator, and no line is lost."""
    path = scratch_path(spark, "raw-bare")
    part = _named(spark, sf).select(F.when(F.col("page_id") % 5 == 0, F.concat_ws(",", "url", "type")).otherwise(F.col("url")).alias("value"))
    part.write.text(path)
    return S.read_raw_urls(spark, path)


def _folder_with_breaks(spark, sf):
    """Every third URL goes on over two more lines, within quotes; every seventh line has a quote that opens nothing."""
    path = scratch_path(spark, "raw-breaks")
    broken = F.concat(F.lit('"'), F.col("url"), F.lit('\n/a,""b""\n\n/c",'), F.col("type"))
    loose = F.concat("url", F.lit('"q,'), "type")
    plain = F.concat_ws(",", "url", "type")
    rows = _named(spark, sf).select(F.when(F.col("page_id") % 3 == 0, broken).when(F.col("page_id") % 7 == 0, loose).otherwise(plain).alias("value"))
    rows.write.text(path)
    return path, rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0


@query
def read_raw_breaks(spark, sf):
    """Quoted line breaks, read in some 200 splits, so that records lie across their borders."""
    path, size = _folder_with_breaks(spark, sf)
    out, key, cost = scratch_path(spark, "raw-breaks-read"), "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key), spark.conf.get(cost)
    try:
        spark.conf.set(key, str(max(256, size // 200)))
        spark.conf.set(cost, "0")
        S.read_raw_urls(spark, path).write.parquet(out)
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set(cost, before[1])
    return spark.read.schema(S.RAW_SCHEMA).parquet(out)


@query
def split_fallback_unicode(spark, sf):
    """S3: a no-break space parts the fields."""
    path = scratch_path(spark, "raw-nbsp")
    _raw(spark, sf).select(F.concat_ws("\u00a0", "url", "type").alias("value")).write.text(path)
    return S.read_raw_urls(spark, path)


@query
def layout_urls(spark, sf):
    path = scratch_path(spark, "layout")
    S.layout_urls(urls(spark, sf), path)
    return spark.read.parquet(path).select("page_id", "url", "domain", "type")


@query
def layout_for_lookups(spark, sf):
    """S11 for all six columns, over the feed, which has countries and times."""
    path = scratch_path(spark, "layout-lookups")
    S.layout_for_lookups(feed(spark, sf), path)
    return spark.read.parquet(path).select("event_id", "url", "domain", "type", "country")


# --- W: streaming ---------------------------------------------------------------------------

#: Most rows of an arriving file, so that a larger feed comes as more files.
ARRIVAL_ROWS = 1_000_000


def _batch_files(spark):
    """Files of a micro-batch: one for each core, as a file of one row group is one task."""
    return max(2, spark.sparkContext.defaultParallelism)


def _arrive(spark, rows, folder, batches=1):
    """Adds the rows to ``folder`` as parquet files of like sizes (arrivals), enough for so many micro-batches."""
    rows.repartition(batches * _batch_files(spark), "event_id").write.option("maxRecordsPerFile", ARRIVAL_ROWS).mode("append").parquet(folder)


def _feed_folder(spark, sf):
    """Raw feed rows written as the arrivals of several micro-batches into a fresh folder."""
    folder = scratch_path(spark, "feed-in")
    _arrive(spark, url_feed(spark, sf), folder, batches=4)
    return folder


def _stream(spark, sf):
    folder = _feed_folder(spark, sf)
    schema = spark.read.parquet(folder).schema
    return W.read_feed(spark, folder, schema, max_files=_batch_files(spark))


@query
def stream_new_urls(spark, sf):
    sink, ck = scratch_path(spark, "w1-out"), scratch_path(spark, "w1-ck")
    W.run_append(_stream(spark, sf).select("event_id", "url", "type"), sink, ck)
    return spark.read.parquet(sink)


@query
def stream_alerts(spark, sf):
    sink, ck = scratch_path(spark, "w2-out"), scratch_path(spark, "w2-ck")
    W.run_append(W.alerts(_stream(spark, sf)), sink, ck)
    return spark.read.parquet(sink).withColumn("confidence", r6("confidence"))


@query
def stream_counts(spark, sf):
    sink, ck = scratch_path(spark, "w3-out"), scratch_path(spark, "w3-ck")
    W.run_update(W.counts(_stream(spark, sf)), sink, ck)
    return W.latest(spark, sink, "type", ["cnt"])


@query
def stream_counts_state(spark, sf):
    """W3 served from the state of the running query, stopped and started again in between."""
    ck, sink, folder = scratch_path(spark, "w3-ck"), scratch_path(spark, "w3-out"), scratch_path(spark, "feed-in")
    rows = url_feed(spark, sf)
    for i in range(2):
        _arrive(spark, rows.filter(F.col("event_id") % 2 == i), folder)
        W.run_update(W.counts(W.read_feed(spark, folder, rows.schema, max_files=_batch_files(spark))), sink, ck)
    return W.from_state(spark, ck, "type", {"count": "cnt"})


#: Suffixes that only the second version of the list has.
HOSTING_SUFFIX_RULES = ["web.app", "github.io", "netlify.app", "vercel.app"]


@query
def stream_alerts_versions(spark, sf):
    """W2 with versions: one half of the events arrives under the built-in suffix list, the other after a longer list was published."""
    versions, sink, ck, folder = (scratch_path(spark, x) for x in ("versions", "w2v-out", "w2v-ck", "feed-in"))
    rows = url_feed(spark, sf)
    longer = rules_frame(spark).unionByName(rules_frame(spark, HOSTING_SUFFIX_RULES))
    for i, rules in enumerate((None, longer)):
        W.publish(spark, versions, i + 1, rules)
        _arrive(spark, rows.filter(F.col("event_id") % 2 == i), folder)
        W.run_versioned_alerts(W.read_feed(spark, folder, rows.schema), versions, sink, ck)
    return spark.read.parquet(sink).drop("batch").withColumn("confidence", r6("confidence"))
