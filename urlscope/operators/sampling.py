"""Reproducible sampling (M1-M4), the semi-join restriction (J1) and augmentation.

Random order is ``md5(seed || '|' || key)``: stable across runs, engines and partitionings.

``flag_smallest_k`` is the core. It marks, per group, the rows with the k smallest hashes
without ever sorting a whole group in one task (a hot label may hold a third of all rows), in two scans of its input:

1. the first counts rows per (group, 5-hex-digit hash prefix) - a partial aggregate, at most
   about a million buckets per group. The counts are stored; the groups' sizes, their k and the bucket where
   the k-th row falls all come from them;
2. the second labels every row and writes it: rows in earlier buckets are in, rows in later ones out, those of the boundary bucket
   (about 1/1,048,576 of the group) open. Only these are ranked by a window, as the written table is read. A sample
   writes no row that is out.

Both jobs run when the function is called; what it returns reads the written table only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import HOSTING_EXAMPLE_REPEATS, HOSTING_EXAMPLE_URLS
from ..functions.literals import literal_table
from ..session import scratch_path

PREFIX_DIGITS = 5


def hash_order(key: Column | str, seed: str = "42") -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(seed), F.lit("|"), k.cast("string")))


def flag_smallest_k(df: DataFrame, group: Column, h: Column, alloc: int | Callable[[DataFrame], DataFrame], only: bool = False) -> DataFrame:
    """``df`` with ``_in``: whether the row's hash ``h`` is among the k smallest of its ``group``; only: rows that are not are left out.

    ``alloc`` is k, or a function from the groups' sizes ``(_g, _c)`` to ``(_g, _k)`` with one row per group; null is
    a group like any other. Rows stay as they are: a repeated key is as many rows as before, and
    of rows with equal hashes at the edge as many are taken as fit.
    """
    base = df.withColumns({"_g": group, "_h": h}).withColumn("_b", F.substring("_h", 1, PREFIX_DIGITS))
    buckets = _stored(base.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_bc")), "buckets")
    sizes = buckets.groupBy("_g").agg(F.sum("_bc").alias("_c"))
    k = sizes.select("_g", F.lit(alloc).cast("bigint").alias("_k")) if isinstance(alloc, int) else alloc(sizes).select("_g", "_k")
    buckets = buckets.join(k.withColumnRenamed("_g", "_ag"), F.col("_g").eqNullSafe(F.col("_ag"))).drop("_ag")
    w = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("_cum", F.sum("_bc").over(w)).withColumn("_before", F.col("_cum") - F.col("_bc"))
    # Per group: the buckets entirely inside the sample, and the one boundary bucket.
    cut = (buckets.filter((F.col("_before") < F.col("_k")) | (F.col("_before") == 0)).groupBy(F.col("_g").alias("_cg"))
           .agg(F.max("_b").alias("_edge"), F.max_by("_before", "_b").alias("_edge_before"), F.first("_k").alias("_k")))
    # one row per group; Spark broadcasts it while it is small
    state = F.when(F.col("_b") < F.col("_edge"), F.lit(True)).when(F.col("_b") > F.col("_edge"), F.lit(False))
    rows = base.join(cut, F.col("_g").eqNullSafe(F.col("_cg")))
    if only:
        rows = rows.filter(F.col("_b") <= F.col("_edge"))
    rows = _stored(rows.select(*df.columns, "_g", "_h", state.alias("_in"), (F.col("_k") - F.col("_edge_before")).alias("_rest")), "labelled")
    rn = F.row_number().over(Window.partitionBy("_g").orderBy("_h"))
    edge = rows.filter(F.col("_in").isNull()).withColumn("_in", rn <= F.col("_rest"))
    return rows.filter(F.col("_in").isNotNull()).unionByName(edge).drop("_g", "_h", "_rest")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_k_per_group(df: DataFrame, group: Column, h: Column, alloc: int | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``df`` that ``flag_smallest_k`` marks."""
    return flag_smallest_k(df, group, h, alloc, only=True).filter("_in").drop("_in")


def fixed_sample(df: DataFrame, n: int, key: str, seed: str = "42") -> DataFrame:
    """M1: the ``n`` rows with the smallest hash (M4 is ``n = 1``)."""
    return smallest_k_per_group(df, F.lit(0), hash_order(key, seed), n)


def stratified_sample(df: DataFrame, n: int, key: str, label: str = "type",
                      floor: int = 1000, seed: str = "42") -> DataFrame:
    """M2: per class ``min(count, max(floor, int(n * count / total)))`` rows by hash order."""
    def alloc(sizes: DataFrame) -> DataFrame:
        total = F.sum("_c").over(Window.partitionBy())  # one row per class
        prop = F.floor(F.lit(n) * F.col("_c") / total).cast("bigint")
        return sizes.select("_g", F.least(F.col("_c"), F.greatest(F.lit(floor).cast("bigint"), prop)).alias("_k"))

    return smallest_k_per_group(df, F.col(label), hash_order(key, seed), alloc)


def stratified_split(df: DataFrame, key: str, label: str = "type", test_fraction_pct: int = 20,
                     seed: str = "42") -> DataFrame:
    """M3: ``split`` = ``test`` for the first ``floor(count * pct / 100)`` rows of each class."""
    def alloc(sizes: DataFrame) -> DataFrame:
        return sizes.select("_g", F.floor(F.col("_c") * F.lit(test_fraction_pct) / F.lit(100)).cast("bigint").alias("_k"))

    marked = flag_smallest_k(df, F.col(label), hash_order(key, seed), alloc)
    return marked.withColumn("split", F.when(F.col("_in"), F.lit("test")).otherwise(F.lit("train"))).drop("_in")


def restrict_to_sample(df: DataFrame, sample_keys: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is in the sample (left semi join).

    Spark broadcasts the keys while they are below ``spark.sql.autoBroadcastJoinThreshold`` and
    shuffles otherwise; adaptive execution looks at their real size.
    """
    return df.join(sample_keys.select(key).distinct(), key, "left_semi")


def augment_training(df: DataFrame, url: str = "url", label: str = "type") -> DataFrame:
    """Append the hosting-platform URLs, each repeated, labelled benign."""
    spark = df.sparkSession
    extra = (literal_table(spark, [(u,) for u in HOSTING_EXAMPLE_URLS], f"{url} string")
             .withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(HOSTING_EXAMPLE_REPEATS))))
             .select(url, F.lit("benign").alias(label)))
    return df.select(url, label).unionByName(extra)
