"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

1. Every word of a document that stands in the benchmark at all is a posting (term, document,
   position). Postings are written in segments, each sorted by term, so a term's list is a
   range that the Parquet statistics find.
2. A test window is ``WINDOW`` consecutive words of an item (a shorter item is one window). The rarest of
   its terms, by the number of postings over all documents, is its seed (of those with a follower
   in the window): every place where the window occurs has a posting of the seed. Shifted back by the
   seed's place in the item, a posting names an alignment of item and document. A posting holds the
   term behind it too, so the seed's list and its follower's are intersected as the first is read.
3. Around the seeds of each alignment that is left the words of the item are expected at known positions;
   these offset-adjusted lists are intersected with the documents' words. A run of matching
   words as long as a window is an occurrence, and every word in it is hit.

The rarest terms cut the work down before any long list is touched; nothing is left out, as a
window can't occur without its rarest term. Only the benchmark's own tables are broadcast, and only
while their number of rows is below ``SMALL``; beyond that they are joined by shuffles.

``proximity`` gives looser matches from the same index: the rarest terms of a window in any order
within a number of words.

Defined cases: null text has no words, no words no hits, and no items the digest of the empty
string. Rows of equal id and text are counted alike, each on its own row. Equal ids with
different texts are kept apart. Item rows of one id are separate texts of that id; the id counts
once. A null item id hits words but isn't listed. Empty tables give no rows or no hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

WINDOW = 10
#: Most rows of a benchmark table that goes to every task (some 100 bytes a row).
SMALL = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that parts words: ASCII but digits and letters.
_PARTS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: F.Column) -> F.Column:
    """Words of a text: A-Z lowered, runs of digits, letters and non-ASCII characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # plain ASCII has a faster way to lower case, which does the same there
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    low = F.btrim(low, F.lit(_PARTS))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, _SPLIT))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


class Index:
    """Postings of documents for the terms of a benchmark.

    items: (b, item_id, n, at, word, t) one row for each word of each item; t numbers the terms.
    postings: (t, doc_id, h, n_words, pos, next); next is the term of the word behind, -2 if that is no
    term; t = -1 stands once for each document, at position -1.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text"):
        self.spark, self.docs, self.id_col, self.text_col = spark, docs, id_col, text_col
        rows = common.stored(spark, benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
                             .withColumn("b", F.monotonically_increasing_id()), "items")
        cells = rows.select("b", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
        terms = cells.select("word").distinct().withColumn("t", F.monotonically_increasing_id())
        terms = common.stored(spark, terms, "terms")
        self.n_terms, self.n_cells = terms.count(), cells.count()
        self.items = common.stored(spark, cells.join(_small(terms, self.n_terms), "word"), "cells")
        # the empty word stands for the document itself
        marks = terms.unionByName(spark.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("long").alias("t")))
        words = self._keyed().select("doc_id", "h", words_of(F.col("text")).alias("words"))
        none = F.array(F.lit(None).cast("string"))
        pairs = F.arrays_zip(F.concat(F.array(F.lit("")), "words").alias("word"), F.concat("words", none).alias("follower"))
        words = words.select("doc_id", "h", F.size("words").alias("n_words"), F.posexplode(pairs).alias("pos", "pair"))
        words = words.select("doc_id", "h", "n_words", "pos", "pair.word", "pair.follower")
        followers = terms.select(F.col("word").alias("follower"), F.col("t").alias("next"))
        postings = (words.join(_small(marks, self.n_terms + 1), "word").join(_small(followers, self.n_terms), "follower", "left")
                    .select("t", "doc_id", "h", "n_words", (F.col("pos") - 1).alias("pos"), F.coalesce("next", F.lit(-2)).alias("next")))
        self.postings = common.stored(spark, postings.sortWithinPartitions("t", "doc_id", "h", "pos"), "postings")

    def _keyed(self) -> DataFrame:
        """Documents under their id and the hash of their text, which keeps texts of one id apart."""
        text = F.coalesce(F.col(self.text_col).cast("string"), F.lit(""))
        return self.docs.select(F.col(self.id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def windows(self, window: int = WINDOW) -> DataFrame:
        """(b, ws, size): where each window of an item begins, and its words."""
        size = F.least("n", F.lit(window))
        return (self.items.select("b", "n").distinct()
                .select("b", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("ws")))

    def ranked(self, window: int = WINDOW) -> DataFrame:
        """(b, ws, size, at, t, tf, rank): the words of each window from the rarest on; windows with a
        term that no document has are left out, as they can't occur."""
        tf = self.postings.where("t >= 0").groupBy("t").agg(F.count("*").alias("tf"))
        cells = self.items.join(tf, "t", "left").select("b", "at", "t", F.coalesce("tf", F.lit(0)).alias("tf"))
        spread = self.windows(window).select("b", "ws", "size", F.explode(F.expr("sequence(ws, ws + size - 1)")).alias("at"))
        rank = F.row_number().over(Window.partitionBy("b", "ws").orderBy("tf", "at"))
        least = F.min("tf").over(Window.partitionBy("b", "ws"))
        return spread.join(cells, ["b", "at"]).withColumn("rank", rank).withColumn("least", least).where("least > 0").drop("least")

    def _aligned(self, window: int) -> DataFrame:
        """(doc_id, h, b, seed, shift): alignments where a window's seed and the word behind it stand at their places."""
        ranked = self.ranked(window)
        # the rarest term that has a follower in its window; windows of one word have none to ask for
        last = (F.col("at") == F.col("ws") + F.col("size") - 1) & (F.col("size") > 1)
        seeds = ranked.where(~last).groupBy("b", "ws", "size").agg(F.min_by(F.struct("at", "t"), "rank").alias("x"))
        behind = self.items.select("b", (F.col("at") - 1).alias("at"), F.col("t").alias("wanted"))
        seeds = (seeds.select("b", "size", "x.at", "x.t").distinct().join(behind, ["b", "at"], "left")
                 .select("b", "at", "t", F.when(F.col("size") > 1, F.col("wanted")).alias("wanted")).distinct())
        seeds = common.stored(self.spark, seeds, "seeds")
        lists = self.postings.join(_small(seeds, seeds.count()), "t").where("wanted is null or wanted = next")
        return common.stored(self.spark, lists.select("doc_id", "h", "b", F.col("at").alias("seed"), (F.col("pos") - F.col("at")).alias("shift")), "alignments")

    def phrases(self, window: int = WINDOW) -> DataFrame:
        """(doc_id, h, b, lo, hi): maximal runs of words that belong to occurrences of windows of item b."""
        found = self._aligned(window)
        seeds = self.items.select("b", F.least("n", F.lit(window)).alias("size")).distinct().join(found.select("b", "seed").distinct(), "b")
        # the words expected around each seed, at their positions in the document
        cells = self.items.select("b", "at", "word")
        near = (seeds
                .select("b", "seed", F.explode(F.expr("sequence(seed - size + 1, seed + size - 1)")).alias("at")).join(cells, ["b", "at"]))
        n_near = near.count()
        wanted = found.select("doc_id", "h", "b", "shift", "seed").join(_small(near, n_near), ["b", "seed"])
        wanted = (wanted.withColumn("pos", F.col("shift") + F.col("at")).where("pos >= 0")
                  .select("doc_id", "h", "pos", "word", "b", "shift", "at").distinct())
        # null ids stand under an own key, so that plain equality joins them
        key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("h"))
        wanted = (wanted.withColumn("key", key).groupBy("key")
                  .agg(F.first("doc_id").alias("id"), F.collect_list(F.struct("pos", "word", "b", "shift", "at")).alias("cells")))
        docs = self._keyed().select(key.alias("key"), "text").join(wanted, "key")
        # one row for each key; the aggregate also keeps a text from being split for every cell again
        docs = docs.groupBy("key").agg(F.first(words_of(F.col("text"))).alias("words"), F.first("id").alias("doc_id"), F.first("cells").alias("cells"))
        there = F.filter("cells", lambda c: F.get("words", c["pos"].cast("int")) == c["word"])
        hit = docs.select("doc_id", F.col("key.h").alias("h"), F.explode(there).alias("c")).select("doc_id", "h", "c.*")
        # islands of consecutive words of one alignment; at most an item's words in a group
        island = F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "h", "b", "shift").orderBy("at"))
        runs = (hit.withColumn("island", island).groupBy("doc_id", "h", "b", "shift", "island")
                .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")))
        sizes = self.items.select("b", F.least("n", F.lit(window)).alias("size")).distinct()
        return (runs.join(_small(sizes, self.n_cells), "b").where("hi - lo + 1 >= size").select("doc_id", "h", "b", "lo", "hi"))

    def contamination(self, window: int = WINDOW) -> DataFrame:
        """One row for every document row: (doc_id, h, n_words, n_hit, n_items, items), items as sorted strings."""
        runs = common.stored(self.spark, self.phrases(window), "runs")
        ids = self.items.select("b", "item_id").distinct()
        found = runs.join(_small(ids, self.n_cells), "b").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        hits = (runs.select("doc_id", "h", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct()
                .groupBy("doc_id", "h").agg(F.count("*").alias("n_hit")))
        every = self.postings.where("t = -1").select("doc_id", "h", "n_words")
        key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("h"))
        facts = hits.withColumn("key", key).drop("doc_id", "h").join(found.withColumn("key", key).drop("doc_id", "h"), "key")
        return (every.withColumn("key", key).join(facts, "key", "left")
                .select("doc_id", "h", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                        F.coalesce("items", F.array().cast("array<string>")).alias("items")))

    def proximity(self, window: int = WINDOW, terms: int = 3, slop: int = 20) -> DataFrame:
        """(doc_id, h, b, ws, pos): places where the ``terms`` rarest words of a window stand in any
        order within ``slop`` words of its rarest one, which is at ``pos``."""
        ranked = common.stored(self.spark, self.ranked(window).where(F.col("rank") <= terms).select("b", "ws", "rank", "t", "size"), "rarest")
        n = ranked.count()
        out = None
        # null ids stand under an own key, so that plain equality joins them
        key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("none"))
        for rank in range(1, terms + 1):
            part = (self.postings.join(_small(ranked.where(F.col("rank") == rank), n), "t")
                    .select("doc_id", key.alias("key"), "h", "b", "ws", "pos", F.least("size", F.lit(terms)).alias("need")))
            if out is None:
                out = part
                continue
            # buckets of slop words: what is near is in the same bucket or a neighbouring one
            part = part.select("key", "h", "b", "ws", F.col("pos").alias("other"),
                               F.explode(F.array(*[F.floor(F.col("pos") / slop) + i for i in (-1, 0, 1)])).alias("bucket"))
            met = (out.withColumn("bucket", F.floor(F.col("pos") / slop)).join(part, ["key", "h", "b", "ws", "bucket"])
                   .where(F.abs(F.col("pos") - F.col("other")) <= slop).select("doc_id", "key", "h", "b", "ws", "pos", "need").distinct())
            out = met.unionByName(out.where(F.col("need") < rank))
        return out.drop("need", "key").distinct()


def query(spark, sf_dir: str) -> DataFrame:
    """op2: ten-word windows of the benchmark against all documents."""
    index = Index(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return index.contamination().select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                                        (F.col("n_hit") > 0).alias("contaminated"))


#: The same by plain joins over all windows, for the small tables of the SQL check.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(len(words), 10) AS size FROM i WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[s:s + size - 1], ' ') AS gram
        FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM sized)),
places AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM w, (SELECT DISTINCT size FROM sized)
        WHERE len(words) >= size),
grams AS (SELECT doc_id, s, size, array_to_string(words[s:s + size - 1], ' ') AS gram FROM places),
hits AS (SELECT g.doc_id, g.s, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.gram = x.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
        FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
