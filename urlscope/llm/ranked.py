"""Ranked search of all documents for a set of queries (items) evaluated together.

1. The items' terms are mined for shared sets: terms that stand in exactly the same items become one
   node; then, again and again, the two nodes that stand together in the most items do, while
   that is at least two items. This gives a DAG whose leaves are terms: a node is the sum of its children, an
   item the sum of its nodes, and what several items share is summed up once.
2. One pass over the documents keeps, for each, its length and the frequencies of the items' terms; the terms'
   document frequencies and the lengths' sum are added up over all documents by Spark.
3. A second pass goes over these postings in blocks of documents. A block's accumulators, one number a
   document, are filled for the terms that occur in it and then along the DAG, each node once. A task
   keeps the best ``top`` documents of each item; Spark merges the tasks' lists in two steps.

Score: w = floor(1000 * ln((2 N + 2) / (2 df + 1))) for a term, m = 50 + (50 n N) div L for a document of n
terms, and the sum of w * ((10**9 tf) div (1000 tf + 20 m)) over the item's terms, once each; all but the
logarithm in 64-bit integers. N counts the documents with a term, L their terms.

Queries come in blocks of some ``CELLS`` (item, term) pairs; only a block's terms, plan and document
frequencies pass the driver and go to the tasks, and each block is one more pass over the documents.

Defined cases: null and term-less texts have no terms and are in no result; an item without terms has no rows. Item rows
of one id are one item with all their terms; a null item id is an item. Rows of a repeated or null doc_id
are ranked each on its own; equal scores go by doc_id, null last. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

TOP = 50
#: (item, term) pairs of a block of queries, on average.
CELLS = 200_000
#: Bytes of a task's accumulators, and least documents of a block.
_ROOM, _LEAST_DOCS = 64_000_000, 64
#: Lists of the tasks that are merged first.
_SALTS = 64
_NONE = -(1 << 63)


# ---- the query-sharing DAG -------------------------------------------------------------

def share(items: list[list[int]], n_terms: int) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """(children of the nodes n_terms, n_terms + 1, ..., the nodes of each item).

    A child's number is below its parent's. Expanding an item's nodes gives each of its terms once.
    """
    where = defaultdict(list)
    for i, terms in enumerate(items):
        for t in sorted(set(terms)):
            where[t].append(i)
    nodes, active = [], [set() for _ in items]
    alike = defaultdict(list)
    for t, at in where.items():
        alike[tuple(at)].append(t)
    for at, terms in alike.items():
        # terms of exactly the same items; those of one item are summed up in the item itself
        if len(at) > 1 and len(terms) > 1:
            nodes.append(tuple(terms))
            terms = [n_terms + len(nodes) - 1]
        for i in at:
            active[i].update(terms)
    holds = defaultdict(set)
    for i, own in enumerate(active):
        for x in own:
            holds[x].add(i)
    # what stands in one item only can't be shared
    common_nodes = [sorted(x for x in own if len(holds[x]) > 1) for own in active]
    pairs = Counter()
    for own in common_nodes:
        pairs.update(combinations(own, 2))
    heap = [(-n, p) for p, n in pairs.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = holds[a] & holds[b]
        if len(both) < 2:
            continue
        if len(both) != -n:  # items have gone to other nodes since
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        new = n_terms + len(nodes)
        nodes.append((a, b))
        near = Counter()
        for i in both:
            active[i] -= {a, b}
            near.update(x for x in active[i] if len(holds[x]) > 1)
            active[i].add(new)
        holds[a] -= both
        holds[b] -= both
        holds[new] = set(both)
        for x, n in near.items():
            if n > 1:
                heapq.heappush(heap, (-n, (x, new)))
    return nodes, [sorted(x) for x in active]


class Plan:
    """A block of items, ready for the tasks."""

    def __init__(self, items: list[list[int]], n_terms: int):
        self.n_terms = n_terms
        self.nodes, self.items = share(items, n_terms)

    def additions(self) -> int:
        """Vector additions of a block of documents in which all terms occur."""
        return sum(len(c) - 1 for c in self.nodes) + sum(max(0, len(x) - 1) for x in self.items)

    def scores(self, n_docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        """(item, its documents' scores) for the items with a term in the block: every node is summed up once."""
        acc: list = [None] * (self.n_terms + len(self.nodes))
        order = np.argsort(term, kind="stable")
        doc, term, value = doc[order], term[order], value[order]
        cuts = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)) if len(term) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            acc[term[lo]] = own = np.zeros(n_docs, np.int64)
            own[doc[lo:hi]] = value[lo:hi]
        for k, children in enumerate(self.nodes):
            acc[self.n_terms + k] = _total([acc[c] for c in children])
        for i, own in enumerate(self.items):
            total = _total([acc[x] for x in own])
            if total is not None:
                yield i, total


def _total(parts: list) -> np.ndarray | None:
    parts = [x for x in parts if x is not None]
    if len(parts) < 2:
        return parts[0] if parts else None
    out = parts[0] + parts[1]
    for x in parts[2:]:
        out += x
    return out


class Best:
    """The best documents of each item: highest score, then least id, null ids (as _NONE) last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least, self.kept = top, np.zeros(n_items, np.int64), [[] for _ in range(n_items)]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores > 0) & (scores >= self.least[item]))
        if len(at):
            self.kept[item].append((scores[at], ids[at]))
            if sum(len(s) for s, _ in self.kept[item]) > 4 * self.top:
                self._cut(item)

    def _cut(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        scores, ids = (np.concatenate(x) for x in zip(*self.kept[item]))
        order = np.lexsort((ids, ids == _NONE, -scores))[:self.top]
        self.kept[item] = [(scores[order], ids[order])]
        if len(order) == self.top:
            self.least[item] = scores[order[-1]]
        return self.kept[item][0]

    def rows(self):
        for i, kept in enumerate(self.kept):
            if kept:
                scores, ids = self._cut(i)
                yield np.full(len(ids), i, np.int32), ids, scores


# ---- passes over the documents ---------------------------------------------------------

def _postings(batches, words: dict):
    """(doc_id, n, terms, tfs) of each document that has a term of any kind; terms are those of the queries."""
    for b in batches:
        texts, out, rows = common.utf8_lists(b, "text"), [], []
        for i, t in enumerate(texts):
            own = (t or b"").translate(common.WORDS).split()
            if own:
                found = Counter(map(words.get, own))
                found.pop(None, None)
                rows.append(i)
                out.append((len(own), np.fromiter(found.keys(), np.int32, len(found)).tobytes(), np.fromiter(found.values(), np.int64, len(found)).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary())))],
                                         ["doc_id", "n", "terms", "tfs"])


def _block(spark: SparkSession, docs: DataFrame, cells: list[tuple[int, bytes]], n_items: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of a block of items."""
    names = sorted({w for _, w in cells})
    number = {w: i for i, w in enumerate(names)}
    items: list[list[int]] = [[] for _ in range(n_items)]
    for i, w in cells:
        items[i].append(number[w])
    plan = Plan(items, len(names))
    sent = spark.sparkContext.broadcast(number)
    postings = common.stored(spark, common.map_arrow(docs, lambda batches: _postings(batches, sent.value), "doc_id bigint, n bigint, terms binary, tfs binary"), "postings")

    def count(batches):
        df, n, total = np.zeros(len(number), np.int64), 0, 0
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), np.int32), minlength=len(number))
            n, total = n + b.num_rows, total + int(b.column("n").to_numpy().sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [n, total]))], ["t", "c"])

    # at most a block's terms and two numbers
    found = common.map_arrow(postings.select("n", "terms"), count, "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c")).toArrow()
    count_of = dict(zip(found["t"].to_pylist(), found["c"].to_pylist()))
    n_docs, n_words = count_of.get(-1, 0), count_of.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * count_of.get(t, 0) + 1))) for t in range(len(names))], np.int64)
    told = spark.sparkContext.broadcast((plan, weight))
    block = max(_LEAST_DOCS, _ROOM // (8 * (len(names) + len(plan.nodes) + 1)))

    def score(batches):
        plan, weight = told.value
        best = Best(len(plan.items), top)
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                terms = [np.frombuffer(x, np.int32) for x in part.column("terms").to_pylist()]
                doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
                term = np.concatenate(terms)
                tf = np.frombuffer(b"".join(part.column("tfs").to_pylist()), np.int64)
                m = np.array([50 + 50 * n * n_docs // n_words for n in part.column("n").to_pylist()], np.int64)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                ids = part.column("doc_id").fill_null(_NONE).to_numpy()
                for item, scores in plan.scores(len(terms), doc, term, value):
                    best.add(item, scores, ids)
        for item, ids, scores in best.rows():
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _NONE), pa.array(scores)], ["item", "doc_id", "score"])

    lists = common.map_arrow(postings, score, "item int, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = lists.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.drop("rank", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return last.where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def _terms(batches):
    for b in batches:
        found = [sorted(set((t or b"").translate(common.WORDS).split())) for t in common.utf8_lists(b, "text")]
        at = np.repeat(np.arange(len(found)), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(at)), pa.array([w for x in found for w in x], pa.binary())], ["item_id", "term"])


def search(spark: SparkSession, docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(item_col, rank, id_col, score): each item's ``top`` highest-scoring documents with a score above 0.

    cells: (item, term) pairs of a block of queries.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = queries.schema[item_col].dataType.simpleString()
    rows = queries.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    pairs = common.stored(spark, common.map_arrow(rows, _terms, f"item_id {kind}, term binary").distinct(), "terms")
    blocks = max(1, -(-pairs.count() // cells))
    out = None
    for k in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        ids = own["item_id"].unique()
        places = {x: i for i, x in enumerate(ids.to_pylist())}
        got = _block(spark, docs, [(places[i], w) for i, w in zip(own["item_id"].to_pylist(), own["term"].to_pylist())], len(places), top)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(places)), pa.int32()), "item_id": ids}))
        names = names.select("item", F.col("item_id").cast(kind).alias(item_col))
        got = got.join(F.broadcast(names), "item").select(item_col, F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")
        out = got if out is None else out.unionByName(got)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the 50 best documents for every item of the benchmark."""
    return search(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_words FROM d WHERE len(words) > 0),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY term),
docs AS (SELECT r, doc_id, 50 + (50 * CAST(len(words) AS BIGINT) * n_docs) // n_words AS m FROM d, total WHERE len(words) > 0),
scores AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM i JOIN postings USING (term) JOIN weights USING (term) JOIN docs USING (r) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
