"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band: in at least
``low`` and at most ``high`` of all documents. A document's distinct lexicon terms are sorted;
for each of ``len(RATES)`` random subsets of the lexicon the terms that fall into the subset are
hashed in that order, and the fingerprint is the row of these hashes. A subset takes one in
``rate`` terms; the rates run from coarse to fine, so that long and short texts both have
subsets that hold one to a few of their terms and outlive an edit.

A document holds on average T distinct terms, so at most T / low terms can be in a share
``low`` of the documents: the lexicon is bounded however many documents there are, and that
bound (not luck) lets it be sent to every task.

Likeness of two fingerprints: of the subsets that hold a term of either text, the share whose
hashes are equal, a subset weighted by its rate (the finest subsets that hold anything hold
single terms and tell most); 1 for equal fingerprints.

Defined cases: null text counts as empty; a text without a lexicon term takes all its terms
instead, one without a term the hash of its bytes, so equal texts always have equal fingerprints
and different empty-handed texts differ. Null ids come last in the order of edits. Repeated ids
are neighbours, in the order of their texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: One in so many terms is in the subset; powers of two.
RATES = (1, 2, 4, 8, *[16] * 6, *[64] * 18, *[256] * 18, *[1024] * 18)
LOW, HIGH = 0.0005, 0.05
_RATES = np.array(RATES, np.uint64)
_WEIGHTS = np.array(RATES, float)
_SEEDS = np.arange(1, len(RATES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_COUNT_WORDS = 300_000


def terms(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(common.WORDS).split())


def _document_counts(batches):
    """Documents of each term, added up within the task; handed on whenever the table is full."""
    found, n = Counter(), 0
    for b in batches:
        for t in common.utf8_lists(b, "text"):
            found.update(terms(t))
            n += 1
        if len(found) > _COUNT_WORDS:
            yield _counted(found)
            found = Counter()
    yield _counted(found)


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["term", "df"])


def lexicon(spark: SparkSession, docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> frozenset[bytes]:
    """Terms in at least ``low`` and at most ``high`` of all documents, counted over whole texts of all."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = common.map_arrow(rows, _document_counts, "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    n = docs.count()
    kept = counts.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n)))
    return frozenset(bytes(r["term"]) for r in kept.select("term").collect())


def fingerprint(text: bytes | None, lexicon: frozenset[bytes]) -> bytes:
    """Two bytes for each subset, zeros where it holds none of the text's terms."""
    own = terms(text)
    kept = sorted(own & lexicon) or sorted(own)
    if not kept:
        return hashlib.blake2b(text or b"", digest_size=2).digest() * len(RATES)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in kept), np.uint64, len(kept))
    out = np.zeros(len(RATES), "<u2")
    for lo in range(0, len(RATES), 8):  # some subsets at a time: a text of very many terms stays small
        mixed = (h[None, :] ^ _SEEDS[lo:lo + 8, None]) * np.uint64(0xC2B2AE3D27D4EB4F)
        subset, term = np.nonzero((mixed >> np.uint64(40)) & (_RATES[lo:lo + 8, None] - np.uint64(1)) == 0)
        picked = h[term].tobytes()  # by subset, in the terms' order
        cuts = np.searchsorted(subset, np.arange(9)).tolist()
        for j in range(min(8, len(RATES) - lo)):
            if cuts[j] < cuts[j + 1]:
                out[lo + j] = xxhash.xxh32_intdigest(picked[8 * cuts[j]:8 * cuts[j + 1]], lo + j) % 65535 + 1
    return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    used = (x != 0) | (y != 0)
    return float(((x == y) & used) @ _WEIGHTS / (used @ _WEIGHTS)) if used.any() else 0.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def edited_pairs(spark: SparkSession, docs: DataFrame, words: frozenset[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document in descending id order: its own, its edited and the next one's fingerprint.

    Documents are dealt by ranges of the id; each range also gets the first document of the
    next one, so neighbours meet in a task and texts are shuffled once. The bounds are as many
    numbers as there are ranges.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("id", F.xxhash64("text").alias("h"))
    q = ids.agg(F.percentile_approx("id", F.lit([i / n for i in range(1, n)] or [0.5]), 10000).alias("q"), F.count("*").alias("n")).first()
    bounds = sorted(set(q["q"] or []), reverse=True)
    # ranges in descending order: 0 holds the ids from the largest bound on, nulls come last. A range's
    # number is that of the bounds above the id, counted by whole blocks and then within one
    step = max(1, int(len(bounds) ** 0.5))
    every, last = (F.array(*[F.lit(b) for b in x]).cast("array<bigint>") for x in (bounds, bounds[step - 1::step]))
    above = lambda x: F.size(F.filter(x, lambda b: b > F.col("id")))
    block = above(last) * step
    part = F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(block + above(F.slice(every, block + 1, F.lit(step))))
    ids = ids.withColumn("part", part)
    heads = {r["part"]: (r["least"]["id"], r["least"]["h"]) for r in ids.groupBy("part").agg(
        F.min(F.struct((-F.col("id")).alias("o"), "h", "id")).alias("least")).collect()}
    used = sorted(heads)
    # the head of each range also goes to the range before it, the first of all to the last
    copies = [(heads[p][0], heads[p][1], used[i - 1]) for i, p in enumerate(used)]
    halo = spark.createDataFrame(copies or [(None, None, 0)], "id bigint, h bigint, to int")
    own = rows.withColumn("h", F.xxhash64("text")).withColumn("part", part)
    extra = (own.drop("part").join(F.broadcast(halo.withColumnRenamed("id", "i").withColumnRenamed("h", "g")),
                                   F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
             .select("id", "text", "h", F.col("to").alias("part")).dropDuplicates(["part"]).withColumn("halo", F.lit(True)))
    dealt = own.withColumn("halo", F.lit(False)).unionByName(extra)
    dealt = (dealt.repartitionById(len(bounds) + 2, F.col("part"))
             .sortWithinPartitions("part", "halo", F.col("id").desc_nulls_last(), "h"))
    sent = spark.sparkContext.broadcast(words)

    def run(batches):
        before = None
        for b in batches:
            out = []
            for i, t, p, halo in zip(*(b.column(c).to_pylist() for c in ("id", "text", "part", "halo"))):
                now = (i, t, fingerprint(t.encode(), sent.value), p, halo)
                if before is not None and not before[4] and before[3] == p:
                    e = edited(before[1], t).encode()
                    f = fingerprint(e, sent.value)
                    out.append((before[0], len(before[1]), hashlib.sha256(e).hexdigest(), before[2].hex(), f.hex(),
                                likeness(before[2], f), likeness(before[2], now[2])))
                before = now
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out = common.map_arrow(dealt.select("id", "text", "part", "halo"), run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                           "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, words: frozenset[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint as hex digits) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([fingerprint(t, sent.value).hex() for t in common.utf8_lists(b, "text")])],
                                             ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the lexicon of all documents, then every text, its edited text and its neighbour."""
    docs = common.table(spark, sf_dir, "documents")
    return edited_pairs(spark, docs, lexicon(spark, docs))
