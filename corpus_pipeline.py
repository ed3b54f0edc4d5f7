"""Pipeline over documents: each stage calls one operator, is written as Parquet and read again.

A stage works on all that its predecessor kept. All stages but the last return the columns of
documents; rows of null id or text are ordinary rows throughout.

1. toxicity: documents that score 0.5 or more go.
2. simhash near-dedup: of each group linked by at most 4 bits over 4-word shingles, the
   document with the smallest id stays, null ids last; of equal ids the one with the least hash of its text. Rows are
   documents of their own here; of those that stay under one id that isn't null, the one with the least hash does.
3. suffix-array dedup: strings of 200 bytes that start anywhere else too are taken out of the
   texts, a character only if all its bytes go; n_chars is that of the text that is left. Documents stay, if
   need be with an empty text.
4. benchmark decontamination: documents that hold a 10-word window of the benchmark go.
5. sentencepiece: every text as sampled pieces, with the result of decoding them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from urlscope.llm import common, decontaminate, lattice, simhash, suffix_array, toxicity


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the other columns as one, so that no operator meets a name of its own among them."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)).alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return rows.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c)
                         for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score_rows(_packed(docs), model).where("toxicity < 0.5"), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a number for each different id and text; a hot one is one row a task before texts are shuffled
    number = F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "text", F.col("text").isNull())
    rows = _packed(docs).withColumn("n", number)
    found = simhash.near_duplicates(spark, rows.select("n", "text"), id_col="n").select("n", "component_id").distinct()
    slim = rows.select("n", "doc_id", F.xxhash64("text").alias("h")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "n"))
    kept = slim.join(found, "n").groupBy("component_id").agg(first.alias("x")).select("x.*")
    once = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("x")).select("x.n")
    keep = common.stored(spark, once.unionByName(kept.where("doc_id is null").select("n")), "kept")
    return _unpacked(rows.dropDuplicates(["n"]).join(keep, "n", "left_semi"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _packed(docs)
    out = suffix_array.Repeats(spark, rows).removed(rows, characters=True)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept").cast("string"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("rest.n_chars"))
    return _unpacked(out, docs, **new)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = decontaminate.Index(spark, docs, common.table(spark, sf_dir, "benchmark"))
    bad = index.phrases().select(F.col("doc_id").alias("bad_id"), F.col("h").alias("bad_h")).distinct()
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (h == F.col("bad_h")), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids, ids_crc32, lossless)."""
    return lattice.round_trip(docs, lattice.piece_model(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Fitted scores, sampled lattices and repeated strings are beyond SQL; the tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
