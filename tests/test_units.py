"""Literal edge cases (FIXTURES.md §5); expected values worked out by hand from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from urlscope.functions import urlparts as U
from urlscope.functions.features import char_entropy, lexical_features, simple_risk_score
from urlscope.operators import aggregates as A
from urlscope.operators.clean import (clean_urls, default_label, is_malicious_type, is_not_benign,
                                      normalize_url)
from urlscope.operators.enrich import enrich_urls
from urlscope.operators.rules import legit_override, score_rules
from urlscope.operators.suffix import resolve_suffix


def one(spark, rows, schema="id int, url string, type string"):
    return spark.createDataFrame(rows, schema)


def test_url_parts_keep_userinfo_port_and_split_params(spark):
    df = one(spark, [(1, "http://u@h.com:80/p;x?q#f", "benign")])
    r = df.select(*U.url_parts("url")).first()
    assert (r.scheme, r.netloc, r.path, r.params, r.query, r.fragment) == ("http", "u@h.com:80", "/p", "x", "q", "f")


def test_params_only_from_last_segment(spark):
    r = one(spark, [(1, "http://h/a;b/c;d;e?z", "x")]).select(*U.url_parts("url")).first()
    assert (r.path, r.params) == ("/a;b/c", "d;e")


def test_case_sensitive_scheme_prefix(spark):
    df = one(spark, [(1, "HTTP://x.com/a", "b"), (2, "ftp://h/x", "b"), (3, "https://ok.com", "b")])
    got = {r.id: r.u for r in df.select("id", normalize_url("url").alias("u")).collect()}
    assert got == {1: "http://HTTP://x.com/a", 2: "http://ftp://h/x", 3: "https://ok.com"}
    nl = df.select("id", U.netloc(normalize_url("url")).alias("n")).collect()
    assert {r.id: r.n for r in nl}[1] == "HTTP:"


def test_bracket_rules(spark):
    df = one(spark, [(1, "http://[bad/", "b"), (2, "http://[::1]:8/", "b"), (3, "http://a_b.com/", "b"),
                     (4, "http://a]b/", "b")])
    ok = {r.id: r.ok for r in df.select("id", U.netloc_parses(U.netloc("url")).alias("ok")).collect()}
    assert ok == {1: False, 2: True, 3: True, 4: False}
    # rows the splitter refuses are dropped by the enrichment
    assert sorted(r.id for r in enrich_urls(df).collect()) == [2, 3]


@pytest.mark.parametrize("url,sub,dom,suf", [
    ("http://a.b.co.uk/", "a", "b", "co.uk"),
    ("http://x.y.ck/", "", "x", "y.ck"),
    ("http://www.ck/", "", "www", "ck"),
    ("http://localhost/", "", "localhost", ""),
    ("http://10.0.0.1:8080/", "", "10.0.0.1", ""),
    ("http://10.0.0.1.evil.com/", "10.0.0.1", "evil", "com"),
    ("http://proj.web.app/", "proj", "web", "app"),
    ("http://a.b.unknownsfx/", "a.b", "unknownsfx", ""),
    ("http://User@Shop.Example.COM./x", "Shop", "Example", "COM"),
])
def test_public_suffix(spark, url, sub, dom, suf):
    r = resolve_suffix(one(spark, [(1, url, "b")])).first()
    assert (r.subdomain, r.domain_label, r.suffix) == (sub, dom, suf)


def test_clean_and_labels(spark):
    df = one(spark, [(1, "  http://a.com ", " Benign "), (2, "   ", "x"), (3, "b.com", None), (4, "c.com", "")])
    c = clean_urls(df).select("id", "url", default_label("type").alias("t")).collect()
    assert [(r.id, r.url, r.t) for r in sorted(c)] == [(1, "http://a.com", "benign"), (3, "b.com", "unknown"),
                                                       (4, "c.com", "unknown")]


def test_malicious_predicates_differ_on_unknown_and_null(spark):
    df = one(spark, [(1, "u", "unknown"), (2, "u", None), (3, "u", "benign"), (4, "u", "Malware")])
    r = {x.id: (x.a, x.b) for x in df.select("id", is_not_benign("type").alias("a"),
                                             is_malicious_type("type").alias("b")).collect()}
    assert r == {1: (True, False), 2: (True, False), 3: (False, False), 4: (True, True)}


def test_unicode_digit_counts_like_python(spark):
    df = enrich_urls(one(spark, [(1, "http://a.com/%D9%A3٣", "b")]))
    f = lexical_features(df).first()
    assert f.digit_count == 3  # 9, 3 and the Arabic-Indic three


def test_f1_on_ip_url(spark):
    df = enrich_urls(one(spark, [(1, "http://10.0.1.7/login.php?user=1", "phishing")]))
    f = lexical_features(df).first()
    assert (f.is_ip_address, f.has_php, f.has_query, f.has_suspicious_words, f.path_depth) == (1, 1, 1, 1, 1)
    assert f.subdomain_count == 2  # four labels minus two, as the analysed rule counts
    # risk: 10 special×.1 + 6 digits×.05 + 2 sub×.3 + 1.5 words + 1.2 ip + .5 php + .3 query
    #       + 1 depth×.2 + entropy(10017, digits only: 1.5219...)×.1
    assert math.isclose(f.security_risk_score, 5.6 + 0.1 * 1.5219280948873621, rel_tol=1e-12)
    s = score_rules(lexical_features(df)).first()
    assert s.rule_score == 8 + 4 + 3 and s.prediction == "malware"
    assert list(s.reasons) == ["Uses IP address instead of domain", "Contains suspicious keywords",
                               "High security risk score"]


def test_hosting_rule_and_benign_confidence(spark):
    df = enrich_urls(one(spark, [(1, "https://www.proj.github.io/", "benign")]))
    s = score_rules(lexical_features(df)).first()
    assert s.rule_score == -2 - 1 - 5
    assert s.prediction == "benign" and math.isclose(s.confidence, 1.6)
    assert list(s.reasons)[-1] == "GitHub Pages hosting (legitimate)"


def test_override_is_substring_based(spark):
    df = one(spark, [(1, "http://google.com.evil.ru/login", "x")], "id int, url string, prediction string")
    df = df.withColumn("confidence", F.lit(0.5))
    r = legit_override(df).first()
    assert (r.prediction, r.confidence, r.override_applied, r.is_malicious) == ("benign", 0.95, True, False)


def test_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("a",), ("abcd",)], "s string")
    got = [r.e for r in df.select(char_entropy("s").alias("e")).collect()]
    assert got == [1.0, 0.0, 0.0, 2.0]


def test_simple_risk_and_buckets(spark):
    u49 = "http://" + "a" * 42
    rows = [(i, u, "t") for i, u in enumerate([u49, u49 + "a", "http://x.ru/" + "b" * 64, "http://tk/bank"])]
    df = one(spark, rows)
    risk = [r.s for r in df.orderBy("id").select(simple_risk_score("url").alias("s")).collect()]
    assert risk == [0, 0, 1 + 2, 1 + 2]
    b = A.url_length_by_type(df.withColumn("url_length", F.length("url"))).collect()
    # lengths 49, 50, 76, 14 → buckets 0-49, 50-99, 50-99, 0-49
    assert sorted((r.bucket, r.cnt) for r in b) == [("0-49", 2), ("50-99", 2)]


def test_display_cut(spark):
    df = spark.createDataFrame([("x" * 60,), ("y" * 61,)], "url string")
    got = [r.d for r in df.select(A.display_url("url").alias("d")).collect()]
    assert got == ["x" * 60, "y" * 60 + "..."]


# --- whole inputs and in-place sampling ------------------------------------------------------

def test_split_keeps_repeated_keys_and_null_labels(spark):
    from urlscope.operators import sampling as M
    rows = [(i % 20, None if i % 4 == 0 else "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, type string")
    out = M.stratified_split(df, "k").collect()
    assert len(out) == 80
    for label in (None, "a", "b"):
        mine = [r for r in out if r["type"] == label]
        assert sum(r["split"] == "test" for r in mine) == len(mine) * 20 // 100
    assert M.stratified_sample(df, 20, "k", floor=3).filter("type is null").count() == 5
    plan = M.stratified_split(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") <= 4


def test_samples_and_splits_scan_their_input_twice(spark, tmp_path):
    """Once to count, once to label; the result reads what was written, and a sample writes no row that is out."""
    from urlscope.operators import sampling as M
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def look(x):
        seen.add(1)
        return x

    spark.range(400).selectExpr("id as k", "concat('l', id % 3) as type").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("k", look.asNondeterministic()("k"))
    for made in (lambda: M.fixed_sample(df, 50, "k"), lambda: M.stratified_sample(df, 60, "k", floor=5), lambda: M.stratified_split(df, "k")):
        before = seen.value
        out = made()
        assert seen.value - before == 800
        files = out.inputFiles()
        assert files and all("labelled-" in f for f in files)
        out.collect()
        assert seen.value - before == 800
    assert spark.read.parquet(*sorted({f.rsplit("/", 1)[0] for f in M.fixed_sample(df, 50, "k").inputFiles()})).count() < 60


def test_format_comes_from_all_lines(spark, tmp_path):
    from urlscope.sources import files as S
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("url;type\n" + "a.com;x\n" * 3)
    (tmp_path / "in/b.txt").write_text("c.com;benign\n\n" + '"d;e";y\n' * 4 + "a;b;c\n")
    got = sorted(tuple(r) for r in S.read_raw_urls(spark, str(tmp_path / "in")).collect())
    assert got == sorted([("a.com", "x")] * 3 + [("c.com", "benign")] + [("d;e", "y")] * 4)
    assert [tuple(r) for r in S.rejected_lines(spark, str(tmp_path / "in")).collect()] == [("a;b;c", 1)]
    (tmp_path / "none.txt").write_text("\n \n")
    assert S.read_raw_urls(spark, str(tmp_path / "none.txt")).count() == 0


def test_empty_store_falls_back(spark, tmp_path):
    from urlscope.sources import files as S
    (tmp_path / "store").mkdir()
    (tmp_path / "raw.csv").write_text("url,type\na.com,x\n")
    assert S.with_fallback_source(spark, str(tmp_path / "store"), str(tmp_path / "raw.csv")).count() == 1


def test_matrix_with_null_predictions(spark):
    from urlscope.operators import ml as ML
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None)], "type string, prediction string")
    got = {(r["label"], r["prediction"]): r["cnt"] for r in ML.confusion_matrix(df).collect()}
    assert got == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}


def test_whole_suffix_list(spark):
    urls = ["http://bit.ly/x", "http://www.bbc.co.ke/", "http://shop.com.co/", "http://a.b.ck/", "http://www.ck/", "http://goo.gl/", "http://x.city.kawasaki.jp/", "http://a.b.kawasaki.jp/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, type string")
    got = {r["url"]: (r["subdomain"], r["domain_label"], r["suffix"]) for r in resolve_suffix(df).collect()}
    assert list(map(got.get, urls)) == [("", "bit", "ly"), ("www", "bbc", "co.ke"), ("", "shop", "com.co"), ("", "a", "b.ck"), ("", "www", "ck"),
                                        ("", "goo", "gl"), ("x", "city", "kawasaki.jp"), ("", "a", "b.kawasaki.jp")]


def test_too_many_rules_are_refused(spark, monkeypatch):
    from urlscope.operators import suffix
    monkeypatch.setattr(suffix, "MAX_RULES", 3)
    with pytest.raises(ValueError, match="reference table"):
        suffix.SuffixResolver(spark, suffix.rules_frame(spark, ["com", "net", "org", "edu"]))


def test_countries_by_name_and_misspelt(spark):
    from urlscope.operators import lookup as L
    names = ["France", "Germny", "Japn ", "Nowhere", "", None, "fr", "Brazzil"]
    df = spark.createDataFrame([(f"http://a{i}.com", "phishing", n) for i, n in enumerate(names)], "url string, type string, country string")
    got = {r["country_code"]: r["cnt"] for r in L.country_counts(df).collect()}
    assert got == {"FRA": 2, "OTHER": 6}
    fuzzy = L.country_lookup_fuzzy(df)
    near = {r["country"]: (r["country_code"], r["distance"]) for r in fuzzy.collect()}
    assert near["Germny"] == ("DEU", 1) and near["Japn "] == ("JPN", 1) and near["Brazzil"] == ("BRA", 1) and near["Nowhere"] == ("OTHER", None)
    assert "NestedLoop" not in fuzzy._jdf.queryExecution().executedPlan().toString()


def test_top_features_without_a_shuffle(spark):
    from conftest import SF_SMALL

    from urlscope.plans.catalog import QUERIES
    plan = QUERIES["top_features_per_url"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_restarted_streams_add_nothing_twice(spark, tmp_path):
    from urlscope.streaming import streams as W
    schema = "event_id bigint, url string, type string, country string"
    rows = [(i, f"http://h{i % 3}.com/a", "ab"[i % 2], "x") for i in range(40)]
    spark.createDataFrame(rows[:30], schema).repartition(3).write.parquet(str(tmp_path / "in"))

    def go():
        feed = W.read_feed(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, max_files=1)
        W.run_append(feed.select("event_id"), str(tmp_path / "out"), str(tmp_path / "ck1"))
        W.run_update(W.counts(W.read_feed(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)), str(tmp_path / "cnt"), str(tmp_path / "ck2"))
        return (sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()),
                {r["type"]: r["cnt"] for r in W.latest(spark, str(tmp_path / "cnt"), "type", ["cnt"]).collect()})

    first = go()
    assert first == (list(range(30)), {"a": 15, "b": 15}) and go() == first
    spark.createDataFrame(rows[30:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert go() == (list(range(40)), {"a": 20, "b": 20})


def test_one_line_of_two_fields_decides(spark, tmp_path):
    from urlscope.sources import files as S
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("http://a.com\nhttp://b.com\nhttp://c.com,phishing\n")
    assert sorted(S.read_raw_urls(spark, str(tmp_path / "in")).collect(), key=str) == [("http://a.com", None), ("http://b.com", None), ("http://c.com", "phishing")]


@pytest.mark.parametrize("split", [128 << 20, 700, 150, 64])
def test_quoted_line_breaks_across_splits(spark, tmp_path, split):
    import csv
    import random

    from urlscope.sources import files as S
    r, want = random.Random(4), []
    (tmp_path / "in").mkdir()
    for k in range(2):
        with open(tmp_path / f"in/{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            for i in range(80):
                url = f"http://x{k}.com/" + ("".join(r.choice(["a", "\n", "\n", ",", '"', "x" * 30]) for _ in range(r.randint(1, 12))) if r.random() < 0.4 else str(i))
                label = r.choice(["benign", "mal\nware", "ph,i"])
                w.writerow([url, label])
                want.append((url, label))
                if r.random() < 0.2:
                    f.write(f'\nbare"quote{i}\n')
                    want.append((f'bare"quote{i}', None))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        assert sorted(map(tuple, S.read_raw_urls(spark, str(tmp_path / "in")).collect()), key=str) == sorted(want, key=str)
        assert not S.rejected_lines(spark, str(tmp_path / "in")).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_open_and_long_quotes(spark, tmp_path, monkeypatch):
    """A file that ends within quotes has no such records; a record that is too long is rejected."""
    from urlscope.sources import files as S
    (tmp_path / "open.csv").write_text('u1,x\n"open,y\nu2,z\n')
    assert S.detect_format(spark, str(tmp_path / "open.csv")) is None
    assert sorted(r.url for r in S.read_raw_urls(spark, str(tmp_path / "open.csv"), ",").collect()) == ["open,y", "u1", "u2"]
    monkeypatch.setattr(S, "RECORD_LIMIT", 20)
    (tmp_path / "long.csv").write_text('u1,x\n"a\nb",y\n"' + "c\n" * 20 + '",z\n')
    assert sorted(r.url for r in S.read_raw_urls(spark, str(tmp_path / "long.csv")).collect()) == ["a\nb", "u1"]
    assert {(r.line, r.n) for r in S.rejected_lines(spark, str(tmp_path / "long.csv")).collect()} == {('"c', 1), ("c", 19), ('",z', 1)}


def test_features_that_fail(spark):
    df = spark.createDataFrame([("http://[bad/x.php",), (None,), ("http://[::1]/a",)], "url string").withColumn("tld", F.lit("com"))
    from urlscope.functions.features import F1_COLUMNS
    got = {r["url"]: r for r in lexical_features(df).collect()}
    for url in ("http://[bad/x.php", None):
        assert [got[url][c] for c in F1_COLUMNS] == [0] * 25 + [5.0]
    assert got["http://[::1]/a"]["url_length"] == 14


@pytest.mark.parametrize("letters", [1, 2, 30])
def test_numbered_pages_rank_only_what_they_touch(spark, letters):
    import random
    r = random.Random(5)
    rows = sorted({("".join(r.choice("abcé") for _ in range(r.randint(0, 5))), r.randint(1, 4)) for _ in range(300)})
    df = spark.createDataFrame([*dict(rows).items()], "domain string, cnt int").repartition(4)
    want = sorted(dict(rows).items(), key=lambda x: (-x[1], x[0].encode()))
    for page in (1, 2, 5, 9, 40):
        out = A.numbered_page(df, page, size=20, letters=letters)
        assert sorted(map(tuple, out.collect())) == sorted(want[20 * page - 20:20 * page])
        assert "Offset" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_quantile_sketches_keep_their_bound(spark):
    import numpy as np
    r = np.random.default_rng(9)
    values = [("a", float(x)) for x in r.normal(size=60_000)] + [("b", float(x)) for x in r.exponential(size=20_000)] + [("a", None), ("b", float("nan")), ("c", None)]
    df = spark.createDataFrame(values, "type string, x double").repartition(6)
    whole = A.quantile_sketches(df, "type", "x")
    merged = A.merge_sketches(A.quantile_sketches(df.filter("x > 0"), "type", "x").unionByName(A.quantile_sketches(df.filter("x <= 0"), "type", "x")), "type")
    for got in (whole, merged):
        rows = {r["type"]: r for r in A.sketch_box(got, (0.01, 0.25, 0.5, 0.75, 0.99), ("low", "q1", "median", "q3", "high")).collect()}
        assert set(rows) == {"a", "b"} and (rows["a"]["n"], rows["b"]["n"]) == (60_000, 20_000)
        for t in "ab":
            x = np.sort([v for g, v in values if g == t and v is not None and not math.isnan(v)])
            for p, name in ((0.01, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.99, "high")):
                assert abs(np.searchsorted(x, rows[t][name], "right") / len(x) - p) <= A.SKETCH_RANK_ERROR + 1 / len(x)


def test_lookups_skip_row_groups(spark, tmp_path):
    """An equality on any of the columns reads a part of the rows."""
    from urlscope.sources import files as S
    df = spark.range(200_000).selectExpr("concat('http://d', id % 5000, '.x/', id) as url", "concat('d', lpad(id % 5000, 4, '0'), '.x') as domain", "concat('t', id % 4) as type",
                                         "concat('s', hash(id) % 50) as tld", "cast(pmod(hash(id, 7), 400) as bigint) as url_length", "concat('c', pmod(hash(id, 9), 30)) as country",
                                         "timestamp_seconds(1700000000 + id * 37) as ts")
    S.layout_for_lookups(df, str(tmp_path / "t"), files=8, row_group_bytes=64 << 10)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 200_000
    assert back.groupBy(*back.columns).count().filter("count > 1").count() == df.groupBy(*df.columns).count().filter("count > 1").count()
    for condition in ("domain = 'd0042.x'", "type = 't1'", "tld = 's7'", "url_length = 17", "country = 'c3'", "ts = timestamp_seconds(1700000000 + 37 * 777)"):
        out = back.filter(condition)
        n = out.count()
        assert n == df.filter(condition).count() > 0
        plan = out.select("url")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        read = _scanned(plan)
        assert n <= read < 0.75 * 200_000, (condition, read)


def _scanned(plan) -> int:
    """Rows that the scan of an executed plan has read."""
    todo = [plan]
    while todo:
        p = todo.pop()
        if "Scan" in p.nodeName():
            return p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
    raise AssertionError("no scan")


def test_counts_from_state_cost_the_same_after_many_batches(spark, tmp_path):
    from urlscope.streaming import streams as W
    folder, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    want = {}
    for i in range(5):
        spark.createDataFrame([("a", i), ("b" if i % 2 else "a", i)], "type string, n int").write.mode("append").parquet(folder)
        for t in ("a", "b" if i % 2 else "a"):
            want[t] = want.get(t, 0) + 1
        counts = W.read_feed(spark, folder, spark.read.parquet(folder).schema, 1).groupBy("type").agg(F.count("*").alias("cnt"))
        W.run_update(counts, sink, ck)
        state = W.from_state(spark, ck, "type", {"count": "cnt"})
        assert {r["type"]: r["cnt"] for r in state.collect()} == want == {r["type"]: r["cnt"] for r in W.latest(spark, sink, "type", ["cnt"]).collect()}
        assert state.count() == len(want) and "batch=" not in str(state.inputFiles())


def test_a_new_version_takes_effect_without_a_restart(spark, tmp_path):
    import time

    from urlscope.operators.suffix import rules_frame
    from urlscope.streaming import streams as W
    folder, versions, sink, ck = (str(tmp_path / x) for x in ("in", "versions", "out", "ck"))
    rows = spark.createDataFrame([(i, f"http://p{i}.web.app/login.php?user=a@b//x.exe", "phishing", "x") for i in range(4)], "event_id bigint, url string, type string, country string")

    def arrive(i):
        rows.filter(f"event_id = {i}").write.mode("append").parquet(folder)
        end = time.time() + 60
        while time.time() < end:
            got = {r["event_id"]: (r["tld"], r["version"]) for r in spark.read.schema("event_id bigint, tld string, version int").parquet(sink).collect()} if (tmp_path / "out").exists() else {}
            if i in got:
                return got[i]
            time.sleep(0.3)
        raise AssertionError("no alert came")

    rows.filter("false").write.parquet(folder)
    stream = W.read_feed(spark, folder, rows.schema, 1)
    q = W.run_versioned_alerts(stream, versions, sink, ck, available_now=False, interval="200 milliseconds")
    try:
        assert arrive(0) == ("app", 0)
        W.publish(spark, versions, 1, rules_frame(spark).unionByName(rules_frame(spark, ["web.app"])))
        assert arrive(1) == ("web.app", 1)
        rules_frame(spark, ["nothing"]).write.parquet(f"{versions}/000002/rules")  # not marked as ready
        assert arrive(2) == ("web.app", 1)
        assert q.isActive
    finally:
        q.stop()


def test_alerts_score_each_row_once(spark):
    """The filter tests the finished column: pushed down, it would hold the whole derivation several times."""
    from urlscope.operators.rules import malicious, model_then_rules
    from urlscope.streaming import streams as W
    rows = spark.createDataFrame([(1, "http://a.ru/setup.exe", "x", "y"), (2, "https://www.a.com/", "x", "y")], "event_id bigint, url string, type string, country string")
    scored = lexical_features(enrich_urls(rows))
    for out in (W.alerts(rows), malicious(model_then_rules(scored), "event_id", "url", "tld")):
        assert [r["event_id"] for r in out.collect()] == [1]
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [line for line in plan if "Filter" in line and ".exe" in line]


def test_entropy_reads_a_stored_column(spark):
    """The characters left of a host are taken out once, not once for each of them."""
    df = lexical_features(enrich_urls(one(spark, [(1, "http://ab-c.com/", "x")])))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\p{L}\\p{N}]") == 1 and math.isclose(df.first()["domain_entropy"], math.log2(6) - 2 / 6)


def _files_of(spark, folder):
    return spark.read.parquet(folder).select("_metadata.file_path").distinct().count()


def test_feed_fills_the_cores(spark, tmp_path):
    """A micro-batch has a file for each core, and there are no more micro-batches than the feed was made for."""
    from urlscope.plans import catalog_more as Q
    from urlscope.streaming import streams as W
    from conftest import SF_SMALL
    q = W.run_append(Q._stream(spark, SF_SMALL).select("event_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert len(sizes) == 4 and _files_of(spark, str(tmp_path / "out")) >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["stream_alerts_versions", "stream_counts_state"])
def test_arrivals_fill_the_cores(spark, tmp_path, monkeypatch, name):
    """Both halves of the feed arrive as a file for each core."""
    from urlscope.plans import catalog_more as Q
    from conftest import SF_SMALL
    monkeypatch.setattr(Q, "scratch_path", lambda spark, x: str(tmp_path / x))
    assert Q.QUERIES[name](spark, SF_SMALL).count() > 0
    assert _files_of(spark, str(tmp_path / "feed-in")) >= 2 * spark.sparkContext.defaultParallelism
