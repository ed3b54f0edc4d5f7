"""SimHash near-duplicates, verified through pivot distance tables.

1. Every text gets a 64-bit fingerprint: a bit is 1 if it is set in over half the hashes of
   the word shingles.
2. Equal fingerprints collapse to one row, so a hot group of copies costs one row from here on.
3. A pair within ``max_bits`` must agree on whole blocks of the bits (pigeonhole: of
   ``max_bits + agree`` blocks at least ``agree`` are untouched), so blocks deal the fingerprints
   into buckets, once for each choice of blocks. Buckets are only the way the work is cut.
4. In a bucket, the Hamming distances of every fingerprint to ``PIVOTS`` reference
   fingerprints are computed once. By the triangle inequality a pair whose distances to any
   one pivot differ by over ``max_bits`` can't be within ``max_bits``; such pairs go by the
   maximum coordinate difference, and the survivors are verified on the bits.
5. A bucket hands on a spanning forest of its links, never all its pairs. Buckets of over
   ``CHUNK`` fingerprints are cut into chunks and worked on chunk against chunk, so no task
   holds a whole large bucket.
6. Components over the links give every document the smallest id it reaches.

Defined cases: null and word-less texts have fingerprint zero, linked like any other. Texts of
fewer words than a shingle hash the whole sequence. Rows of a null id keep a fingerprint; a
component of null ids only is null. Repeated ids are one node. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .components import components

PIVOTS = 16
CHUNK = 16384


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    h64, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    hashes = np.fromiter((h64(b" ".join(words[i:i + shingle]), 42) for i in range(n)), np.uint64, n)
    # bit columns in blocks: a very long text takes no more memory than a long one
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at:at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) for every row; fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            got = [fingerprint(t, shingle) for t in common.utf8_lists(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, "id bigint, fp bigint")


def _blocks(n: int) -> list[tuple[int, int]]:
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _pivots() -> np.ndarray:
    """Reference fingerprints, the same in every task: hashes of their own numbers."""
    return np.array([xxhash.xxh64_intdigest(b"%d" % i, 42) for i in range(PIVOTS)], np.uint64)


def forest(fps: np.ndarray, side: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Links (i, j) that join what is within ``max_bits``: a spanning forest of the bucket.

    side: None, or a chunk number for each; then links within a chunk are left to its own task.
    Breadth first: a fingerprint is compared with those not reached yet only, so a dense group
    goes in a few steps, and every step throws out by the pivot table before it looks at bits.
    """
    table = np.bitwise_count(fps[:, None] ^ _pivots()[None, :]).astype(np.int8)
    left = np.arange(len(fps))
    links = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = left
            for p in range(PIVOTS):
                if not len(near):
                    break
                near = near[np.abs(table[near, p] - table[x, p]) <= max_bits]
            if side is not None and len(near):
                near = near[side[near] != side[x]]
            if len(near):
                near = near[np.bitwise_count(fps[near] ^ fps[x]) <= max_bits]
            if len(near):
                links.extend((int(x), int(y)) for y in near)
                todo.extend(near.tolist())
                left = left[~np.isin(left, near, assume_unique=True)]
    return links


def links(spark: SparkSession, distinct: DataFrame, max_bits: int = 4, agree: int = 2) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) whose closure joins all pairs within max_bits.

    agree: 2 deals out 15 copies of a fingerprint by 21 bits each; 3 deals out 35 by 27 bits, for
    more than some 100 million fingerprints. The links are whole either way.
    """
    cuts = _blocks(max_bits + agree)
    keys = []
    for k, chosen in enumerate(combinations(range(len(cuts)), agree)):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in (cuts[c] for c in chosen))
        keys.append(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("part")))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.t", "key.part", "fp")
    sizes = dealt.groupBy("t", "part").count().where("count > 1")
    sizes = sizes.withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count")
    mine = dealt.join(sizes, ["t", "part"])
    # chunk a of a large bucket meets every chunk b: one task for each pair (a, b), a <= b
    mine = mine.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    mine = mine.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    mine = mine.select("t", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")

    def run(batches):
        key, fps, own = None, [], []

        def flush():
            if sum(map(len, fps)) > 1:
                f = np.concatenate(fps).view(np.uint64)
                o = np.concatenate(own)
                got = forest(f, o if key[2] != key[3] else None, max_bits)
                if got:
                    return f[[i for i, _ in got]].view(np.int64), f[[j for _, j in got]].view(np.int64)
            return None

        us, vs = [], []
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(6)]
            n = len(cols[0])
            if not n:
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, n)):
                now = tuple(int(c[lo]) for c in cols[:4])
                if now != key:
                    if got := flush():
                        us.append(got[0])
                        vs.append(got[1])
                    key, fps, own = now, [], []
                # a bucket may go on in the next batch
                fps.append(cols[5][lo:hi])
                own.append(cols[4][lo:hi])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us, vs = [], []
        if got := flush():
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["u", "v"])

    dealt_out = mine.repartition("t", "part", "a", "b").sortWithinPartitions("t", "part", "a", "b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return dealt_out.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(id_col, fp, component_id): the smallest id that a document reaches over links of at most max_bits."""
    marks = common.stored(spark, fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # one row for each fingerprint, named by its smallest id
    distinct = common.stored(spark, marks.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    named = distinct.select("fp")
    # an id on rows of different texts links their fingerprints
    split = marks.where("id is not null").groupBy("id").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).where("u != v").select("id", "u")
    same_id = marks.join(split, "id").select("u", F.col("fp").alias("v"))
    found = components(spark, links(spark, named, max_bits).unionByName(same_id))
    classes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    classes = classes.withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = classes.join(least, "component").select("fp", "component_id")
    # a hot fingerprint is split by the skew join
    out = marks.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op5: four-word shingles, four bits."""
    out = near_duplicates(spark, common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
