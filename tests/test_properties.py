"""Invariants over the fixture tables."""

from pyspark.sql import functions as F

from conftest import SF_ORACLE
from urlscope.operators import aggregates as A
from urlscope.operators import sampling as M
from urlscope.operators.enrich import enrich_urls
from urlscope.sources.fixtures import urls_raw


def test_aggregates_are_consistent(spark):
    u = enrich_urls(urls_raw(spark, SF_ORACLE)).cache()
    total = u.count()
    assert A.counts_by_type(u).agg(F.sum("cnt")).first()[0] == total
    assert A.url_length_by_type(u).agg(F.sum("cnt")).first()[0] == total
    for r in A.threat_scores(u).collect():
        assert abs(r.sum_score / r.cnt - r.avg_score) < 1e-12
    for r in A.url_length_box(u).collect():
        assert r.min_len <= r.q1 <= r.median <= r.q3 <= r.max_len
    u.unpersist()


def test_split_is_disjoint_exhaustive_and_stratified(spark):
    u = enrich_urls(urls_raw(spark, SF_ORACLE)).select("page_id", "type")
    s = M.stratified_split(u, "page_id").collect()
    assert len(s) == u.count() and len({r.page_id for r in s}) == len(s)
    per = {}
    for r in s:
        per.setdefault(r.type, [0, 0])[r.split == "test"] += 1
    for t, (train, test) in per.items():
        assert test == (train + test) * 20 // 100


def test_sample_helper_matches_a_full_sort(spark):
    u = enrich_urls(urls_raw(spark, SF_ORACLE)).select("page_id", "type")
    got = {r.page_id for r in M.fixed_sample(u, 37, "page_id").collect()}
    want = {r.page_id for r in u.orderBy(M.hash_order("page_id")).limit(37).collect()}
    assert got == want
