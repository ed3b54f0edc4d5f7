"""Texts of one id are told apart by all 64 bits of their hash."""

from pyspark.sql import functions as F

from urlscope.llm import suffix_array


def test_texts_of_a_null_id_that_agree_in_24_bits(spark):
    passage = "".join(chr(97 + i * i * 7 % 23) + str(i) for i in range(100))
    n = spark.range(12_000)
    low = F.pmod(F.xxhash64("text"), F.lit(1 << 24)).alias("low")
    with_it = n.select(F.concat(F.lit(passage), "id").alias("text")).select("text", low)
    without = n.select(F.concat(*[F.sha2(F.concat("id", F.lit(x)), 512) for x in "abc"]).alias("other")).select("other", F.pmod(F.xxhash64("other"), F.lit(1 << 24)).alias("low"))
    a, b = with_it.join(without, "low").orderBy("low").select("text", "other").first()
    docs = spark.createDataFrame([(None, a), (None, b), (7, "x" + passage)], "doc_id bigint, text string")
    got = {r["text"]: (r["n_removed"], r["kept"]) for r in suffix_array.Repeats(spark, docs).removed(docs).collect()}
    assert got[b] == (0, b.encode())
    assert got[a][0] == len(passage) and got["x" + passage] == (len(passage), b"x")
