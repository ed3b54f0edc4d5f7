"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability ``sigmoid(bias + sum of the
weights of its distinct words)``, a word's weight being its own and those of its first four and
five bytes, so that inflected forms share what was learned; a document is toxic with the noisy-or of its sentences,
``1 - prod(1 - p)``. Only document labels are needed to fit the weights, yet the sentences
that made a document toxic can be pointed at afterwards.

The fit sees at most ``max_docs`` labelled documents of each label (a documented bound; those
with the smallest hash of the id). Everything else covers all rows and whole texts.

Defined cases: null text counts as empty; a text without a sentence scores the probability of
one empty sentence. Several labels of one id: the largest non-null one. Labels null or of an
unknown id are left out. Without labels of both kinds all weights are zero. Repeated document rows are
scored one by one; extra columns, however named, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from . import common

#: Sentence ends become line feeds, every other separator a blank.
_SENTENCES = common.byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz\n", {c: 10 for c in b".!?"})

#: Most labelled documents of each label in the fit.
MAX_DOCS = 2000
#: A word needs so many fitted documents to get a weight.
MIN_DOCS = 10


def sentences(text: bytes | None) -> list[list[bytes]]:
    """Distinct words of each sentence that has any."""
    return [w for s in (text or b"").translate(_SENTENCES).split(b"\n") if (w := sorted(set(s.split())))]


def features(word: bytes) -> tuple[bytes, ...]:
    """The word and, of longer ones, its beginnings."""
    return (word, word[:4] + b"*", word[:5] + b"*") if len(word) > 5 else (word,)


class Weights(dict):
    """Weight of any word, from the weights of its features; words seen before are kept."""

    def __init__(self, model: dict):
        self.get_one = model.get

    def __missing__(self, word: bytes) -> float:
        w = sum(self.get_one(f, 0.0) for f in features(word))
        if len(self) < 300_000:
            self[word] = w
        return w


def fit(vocab: dict[bytes, int], ids: np.ndarray, starts: np.ndarray, owner: np.ndarray, labels: np.ndarray,
        steps: int = 120, l2: float = 5e-5) -> dict:
    """Weights by Adam on the noisy-or likelihood, classes weighted alike; {b"": bias, word: weight}.

    vocab: features to 1, 2, ...; ids: every sentence's word numbers behind a 0 for the bias;
    starts: where each sentence begins; owner: the document of each sentence, ascending; labels: of the documents.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return {b"": -4.0}
    lens = np.diff(np.append(starts, len(ids)))
    doc_at = np.searchsorted(owner, np.arange(len(y)))
    # the starting point: smoothed log odds of a word's documents
    word_doc = np.unique(np.repeat(owner, lens) * (len(vocab) + 1) + ids)
    word, doc = word_doc % (len(vocab) + 1), word_doc // (len(vocab) + 1)
    del word_doc
    pos, both = np.bincount(word, y[doc], len(vocab) + 1), np.bincount(word, minlength=len(vocab) + 1)
    del word, doc
    n1, n = y.sum(), len(y)
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((both - pos + 0.5) / (n - n1 + 1))
    w = np.where(odds > 2, odds, 0.0)
    w[0] = -6.0
    share = np.where(y == 1, 0.5 / n1, 0.5 / (n - n1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.clip(np.add.reduceat(w[ids], starts), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_none = np.minimum(np.add.reduceat(-np.logaddexp(0, z), doc_at), -1e-9)
        none = np.exp(log_none)
        slope = np.where(y == 1, -none / (1 - none), 1.0) * share
        g = np.bincount(ids, np.repeat(slope[owner] * p, lens), len(w)) + l2 * w * (np.arange(len(w)) > 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
    return {b"": float(w[0])} | {k: float(w[i]) for k, i in vocab.items() if abs(w[i]) > 1e-2}


def score(text: bytes | None, bias: float, weights: Weights) -> tuple[float, int, float]:
    """(document score, index of its worst sentence or -1, that sentence's probability)."""
    get, log_none, worst, at = weights.__getitem__, 0.0, -1e9, -1
    k = 0
    for s in (text or b"").translate(_SENTENCES).split(b"\n"):
        words = s.split()
        if not words:
            continue
        z = bias + sum(map(get, set(words)))
        if z > worst:
            worst, at = z, k
        log_none -= math.log1p(math.exp(z)) if z < 30 else z
        k += 1
    if at < 0:
        worst = bias
        log_none = -math.log1p(math.exp(bias))
    return -math.expm1(log_none), at, 1 / (1 + math.exp(-max(-30.0, min(30.0, worst))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_docs: int = MAX_DOCS) -> dict:
    """Fit on at most ``max_docs`` labelled documents of each label, by hash of the id; of rows of one id one is taken."""
    spark = docs.sparkSession
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
             .withColumn("h", F.xxhash64("id")))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "id").limit(max_docs)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * max_docs ids: small enough to send to every task
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(picked.drop("h")), "id"))
    rows = common.stored(spark, common.one_text_each(rows, "y"), "labelled")
    words = common.map_arrow(rows.select("text"), _word_batches, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    vocab = {bytes(r["word"]): i + 1 for i, r in enumerate(words.where(F.col("n") >= MIN_DOCS).orderBy("word").collect())}
    sent = spark.sparkContext.broadcast(vocab)

    def run(batches):
        for b in batches:
            get = sent.value.get
            bags = [b"".join(np.array([0, *(v for w in s for f in features(w) if (v := get(f)))], np.int32).tobytes()
                             for s in sentences(t) or [[]]) for t in common.utf8_lists(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("id"), pa.array(bags, pa.binary())], ["y", "id", "bag"])

    # word numbers of the bounded sample: some tens of MB at most
    got = common.map_arrow(rows, run, "y int, id bigint, bag binary").toArrow().sort_by([("id", "ascending"), ("bag", "ascending")])
    ids = [np.frombuffer(x, np.int32) for x in got["bag"].to_pylist()]
    sizes = np.array([len(x) for x in ids], np.int64)
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    starts = np.flatnonzero(ids == 0)
    return fit(vocab, ids, starts, np.repeat(np.arange(len(sizes)), sizes)[starts], got["y"].to_numpy())


def _word_batches(batches):
    """Documents of each word, counted within a task before they are shuffled."""
    for b in batches:
        found = Counter(f for t in common.utf8_lists(b, "text") for f in {f for s in sentences(t) for w in s for f in features(w)})
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])


def _scores(texts: list, bias: float, weights: Weights) -> list[pa.Array]:
    found = [score(t, bias, weights) for t in texts]
    return [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int32()),
            pa.array([x[2] for x in found], pa.float64())]


_NAMES = ["toxicity", "worst_sentence", "sentence_score"]
_TYPES = "toxicity double, worst_sentence int, sentence_score double"


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (id_col, toxicity, worst_sentence, sentence_score).

    The model holds words of the bounded fit only, so what is sent to the tasks is bounded too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = Weights(sent.value)
        for b in batches:
            scores = _scores(common.utf8_lists(b, "text"), sent.value[b""], weights)
            yield pa.RecordBatch.from_arrays([b.column("id"), *scores], ["id", *_NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    out = common.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run,
                           f"id {kind}, {_TYPES}")
    return out.withColumnRenamed("id", id_col)


def score_rows(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the three score columns behind them, without a join.
    Columns of ``docs`` that have a score column's name are replaced by it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in _NAMES or c == text_col]

    def run(batches):
        weights = Weights(sent.value)
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, *_scores(texts, sent.value[b""], weights)], [*own, *_NAMES])

    rows = docs.select(*own)
    schema = StructType(list(rows.schema))
    for name, kind in zip(_NAMES, ("double", "integer", "double")):
        schema = schema.add(name, kind)
    return common.map_arrow(rows, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document scored; labels of the held-out fifth are never read by the fit."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(common.crc_column("doc_id", 5) != 0))
    out = score_documents(docs, model)
    return out.select("doc_id", (common.crc_column("doc_id", 5) == 0).alias("held_out"),
                      F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
                      "worst_sentence", "sentence_score")
