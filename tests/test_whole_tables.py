"""The bound on a fit's rows is no bound on the rows that are predicted."""

import pytest
from conftest import SF_SMALL

from urlscope.operators import sampling as M
from urlscope.plans import catalog_more
from urlscope.plans.catalog import QUERIES, urls


@pytest.fixture
def small_fit(monkeypatch):
    monkeypatch.setattr(catalog_more, "FIT_ROWS", 20)
    monkeypatch.setattr(catalog_more, "FIT_FLOOR", 4)


def test_score_batch_scores_every_row(spark, small_fit):
    whole = urls(spark, SF_SMALL)
    assert whole.count() > 40
    assert sorted(r.page_id for r in QUERIES["score_batch"](spark, SF_SMALL).select("page_id").collect()) == sorted(r.page_id for r in whole.select("page_id").collect())


@pytest.mark.parametrize("name", ["train_gbt", "train_forest", "train_text", "save_model"])
def test_the_whole_test_part_is_predicted(spark, small_fit, name):
    test = M.stratified_split(urls(spark, SF_SMALL).select("page_id", "type"), "page_id").filter("split = 'test'")
    assert sorted(r.page_id for r in QUERIES[name](spark, SF_SMALL).select("page_id").collect()) == sorted(r.page_id for r in test.select("page_id").collect())
