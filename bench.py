"""Benchmark: the reference's workload stages on the event-sized URL feed.

Stages (each forced with a no-op write, so every row is computed and nothing is collected):
  ingest      - raw labelled feed (events joined to pages and nations) stored as parquet
  preprocess  - read raw feed, clean, normalize, resolve suffixes, enrich; written as parquet
  agg_*       - the six aggregation jobs over the stored enriched table
  score       - 26 lexical features + rule scoring of every stored URL
  summary     - dashboard summary, box statistics and top hosts
  train       - random forest of full size on the bounded sample; apart: the boosted ensemble of full size

Prints one JSON line. ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from urlscope.functions.features import F1_COLUMNS, lexical_features, training_features  # noqa: E402
from urlscope.operators import aggregates as A  # noqa: E402
from urlscope.operators import lookup as L  # noqa: E402
from urlscope.operators import ml as ML  # noqa: E402
from urlscope.operators import sampling as M  # noqa: E402
from urlscope.operators.enrich import enrich_urls  # noqa: E402
from urlscope.operators.rules import score_rules  # noqa: E402
from urlscope.session import scratch_path  # noqa: E402
from urlscope.sources.fixtures import COUNTRY_DIM, url_feed  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("urlscope-bench")
             .config("spark.sql.shuffle.partitions", str(cpus * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="urlscope-bench-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t, 3)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # warm-up (JIT, class loading) on a tiny slice of work
    run(spark.read.parquet(f"{sf_dir}/nation.parquet"))

    # ingest: the raw labelled feed is stored as parquet in ``cpus`` files (the driver's tables
    # are single row-group files, which would otherwise give one input split).
    raw_store, store = scratch_path(spark, "bench-raw"), scratch_path(spark, "bench-urls")
    timed("ingest", lambda: url_feed(spark, sf_dir).repartition(cpus).write.mode("overwrite").parquet(raw_store))
    timed("preprocess", lambda: enrich_urls(spark.read.parquet(raw_store)).write.mode("overwrite").parquet(store))
    urls = spark.read.parquet(store)
    n_rows = urls.count()

    timed("agg_counts_by_type", lambda: run(A.counts_by_type(urls)))
    timed("agg_mal_domains", lambda: run(A.mal_domains(urls)))
    timed("agg_malicious_tld_counts", lambda: run(A.malicious_tld_counts(urls)))
    timed("agg_threat_scores", lambda: run(A.threat_scores(urls)))
    timed("agg_country_counts", lambda: run(L.country_counts(urls, L.country_dim(spark, COUNTRY_DIM))))
    timed("agg_url_length_by_type", lambda: run(A.url_length_by_type(urls)))
    timed("score", lambda: run(score_rules(lexical_features(urls))))

    def summary():
        run(A.threat_summary(urls))
        run(A.url_length_box(urls))
        run(A.top_malicious_hosts(urls))
    timed("summary", summary)

    def sample(features):
        # the registered queries' inputs: a stratified sample of at most 20,000 labelled rows
        return M.stratified_sample(features, 20_000, "event_id", floor=1_000)

    timed("train", lambda: ML.train_forest(sample(lexical_features(urls)), F1_COLUMNS))

    total = round(sum(times.values()), 3)
    # shown apart from the total: boosting at its full size, 100 rounds of depth 8 with early stopping
    t = time.perf_counter()
    rounds = len(ML.train_gbt(sample(training_features(urls)), key="event_id").rounds)
    apart = {"train_boosted": round(time.perf_counter() - t, 3), "boosted_rounds": rounds}
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "rows": n_rows,
                      "cpus": cpus, "apart": apart}))
    spark.stop()


if __name__ == "__main__":
    main()
