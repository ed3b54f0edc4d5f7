"""Registered queries and the pipeline over the driver's smallest tables."""

import inspect
import re

import pytest

import __spark_entry__ as E
import corpus_pipeline
from urlscope.llm import common
from urlscope.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
KEYS = {1: "doc_id n_bytes n_tokens ids_crc32 lossless", 2: "doc_id n_words n_hit n_items items_sha256 contaminated",
        3: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 4: "doc_id n_bytes n_removed n_spans kept_sha256",
        5: "doc_id fingerprint component_id", 6: "doc_id start n_tokens ids_crc32",
        7: "page_id payload_bytes payload_digest record_type refers_to", 8: "doc_id held_out n_tokens n_known train_tokens base_score score",
        9: "doc_id held_out score predicted", 10: "doc_id n_words votes weak_label score predicted",
        11: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", 12: "doc_id n_shingles component_id", 13: "item_id rank doc_id score"}


def test_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op13_shared_search"}))
def test_query_gives_a_row_for_every_row(spark, name):
    n = int(re.match(r"op(\d+)_", name)[1])
    out = QUERIES[name](spark, SMALL)
    assert set(KEYS[n].split()) <= set(out.columns)
    table = "pages" if n == 7 else "documents"
    assert out.count() == common.table(spark, SMALL, table).count()


def test_pipeline(spark):
    docs = common.table(spark, SMALL, "documents")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = common.stored(spark, stage(spark, docs, SMALL), "stage")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= seen and len(ids) == docs.count() and len(ids) > len(seen) / 2, name
        assert i == 4 or docs.columns == columns
        seen = ids
    assert not docs.where("not lossless").count()


def test_copies_without_an_id_go(spark):
    """Rows of a null id are copies like any other; of two without an id one stays."""
    a, b = "one two three four five six seven eight nine ten", "other words stand in this text than in the one before it"
    rows = [(None, a), (7, a), (3, a), (None, a), (None, b), (None, b), (4, "x y"), (4, "quite another text under the same number"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, {"k": 1}) for i, t in rows], "doc_id bigint, text string, about map<string,int>")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SMALL).collect()]
    assert sorted(got, key=str)[:4] == sorted([(3, a), (5, None), (None, b), *[x for x in got if x[0] == 4]], key=str)[:4] and len(got) == 4


def test_columns_with_an_operators_names_come_back_untouched(spark):
    names = ["toxicity", "worst_sentence", "sentence_score", "n_removed", "n_bytes", "n_spans", "kept", "row", "rest", "h", "n", "id", "fp"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    for c in names:
        docs = docs.withColumn(c, __import__("pyspark").sql.functions.expr(f"concat('{c}', doc_id)"))
    docs = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = common.stored(spark, stage(spark, docs, SMALL), "clash")
        assert out.dtypes == docs.dtypes, name
        for c in names:
            assert out.where(f"{c} != concat('{c}', doc_id)").count() == 0, (name, c)


def test_pipeline_takes_odd_rows(spark):
    odd = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "x y z", "en", "s", 5), (3, "x " * 500, None, None, 1000)]
    docs = spark.createDataFrame(odd, common.table(spark, SMALL, "documents").schema)
    for some in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            some = common.stored(spark, stage(spark, some, SMALL), "odd")
        assert set(some.columns) >= {"doc_id", "lossless"}
