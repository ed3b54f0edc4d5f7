"""Held-out accuracy of the fitted operators on the driver's tables."""

from urlscope.llm import common, ctw, quality, toxicity

TABLES = "/root/testdata/sf0.1"


def confusion(scored, truth):
    rows = scored.join(truth, "doc_id").groupBy("y", "predicted").count().collect()
    return {(r["y"], r["predicted"]): r["count"] for r in rows}


def test_toxicity(spark):
    labels = common.table(spark, TABLES, "labels").selectExpr("doc_id", "toxic as y").dropDuplicates(["doc_id"])
    got = confusion(toxicity.query(spark, TABLES).where("held_out"), labels)
    assert got[1, 1] >= 0.75 * (got[1, 1] + got.get((1, 0), 0)) and got.get((0, 1), 0) <= 0.02 * got[0, 0]


def test_quality(spark):
    labels = common.table(spark, TABLES, "labels").selectExpr("doc_id", "quality as y").dropDuplicates(["doc_id"])
    got = confusion(quality.query(spark, TABLES), labels)
    assert got[0, 0] >= 0.95 * (got[0, 0] + got.get((0, 1), 0)) and got.get((1, 0), 0) <= 0.03 * got[1, 1]


def test_code_length(spark):
    one = ctw.query(spark, TABLES).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "avg(bits_per_byte) as n").first()
    assert one["s"] > one["b"] and one["n"] < 2.2
