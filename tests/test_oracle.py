"""Every registered query against its DuckDB twin at sf0.01 (the driver's correctness gate)."""

import re

import pytest

import __spark_entry__ as E
from compare import compare, duck
from conftest import SF_ORACLE

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_is_registered_with_a_twin_or_is_ml():
    # op1_... to op10_... and the pipeline have their own tests
    rows_only = {k for k in set(QUERIES) - set(ORACLE) if k != "pipeline" and not re.match(r"op\d+_", k)}
    assert rows_only <= {"train_gbt", "train_forest", "train_text", "feature_importance", "score_batch",
                         "model_then_rules", "save_model"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SF_ORACLE), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", ["train_forest", "feature_importance", "score_batch"])
def test_ml_queries_run(spark, name):
    assert QUERIES[name](spark, SF_ORACLE).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"type", "sum_score", "max_score", "cnt", "avg_score"}
    assert df.count() > 0
