"""The tree's contexts grow with the input, and its buckets give what the whole tree gives."""

import numpy as np
from pyspark.sql import functions as F

from urlscope.llm import ctw


def test_a_rare_context_of_a_large_corpus_is_kept(spark):
    common = spark.range(3_000).select("id", F.repeat(F.lit("the same words again "), 20).alias("text"))
    docs = common.unionByName(spark.createDataFrame([(-1, "qzxjvkw"), (-2, "qzxjvkw")], "id bigint, text string"))
    tree = ctw.load(ctw.train(spark, docs))
    context = np.array([int.from_bytes(b"qzxjvk", "big")], np.uint64)
    assert tree.contexts[6].find(context)[0].all()


def test_buckets_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(ctw, "_BUCKET", 2_000)
    monkeypatch.setattr(ctw, "_PIECE", 3_000)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" some words "), F.col("id") % 7).alias("text"))
    known = docs.where("doc_id < 200")
    folder = ctw.train(spark, known)
    tree = ctw.load(folder)
    for r in docs.join(ctw.score_documents(spark, docs, folder, ctw.word_counts(spark, known)), "doc_id").collect():
        assert abs(r["score"] - tree.log10(ctw.gram_codes([r["text"].encode()])[0]).astype(float).sum()) < 1e-3


def test_frequent_contexts_belong_to_the_top(spark, monkeypatch):
    """However subtrees are dealt out, the tree is the same, and no bucket gets what stands behind a frequent context."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit(" the the th"), F.repeat(F.concat(F.lit(" the"), F.sha2(F.col("id").cast("string"), 256)), 3)).alias("text"))
    plain = ctw.train(spark, docs)
    assert not any(len(x) for x in ctw._layout(plain).hot)
    monkeypatch.setattr(ctw, "_BUCKET", 500)
    monkeypatch.setattr(ctw, "HOT", 1 / 2000)
    dealt = ctw.train(spark, docs)
    layout = ctw._layout(dealt)
    assert int.from_bytes(b" th", "big") in layout.hot[0].tolist() and len(layout.hot[1]) and len(layout.hot[2])
    one, other = ctw.load(plain), ctw.load(dealt)
    assert all((a == b).all() for a, b in zip(one.codes, other.codes))
    sizes = [sum(int(n.sum()) for own in ctw._levels(dealt, b).values() for _, n in own[:1]) for b in range(layout.buckets)]
    assert max(sizes) < sum(sizes) / 20
    words = ctw.word_counts(spark, docs)
    got, want = ({r["doc_id"]: r["score"] for r in ctw.score_documents(spark, docs, f, words).collect()} for f in (dealt, plain))
    assert len(got) == 400 and all(abs(got[i] - want[i]) < 1e-3 for i in got)


def test_a_lost_bucket_is_an_error(spark, monkeypatch):
    import os

    import pytest
    monkeypatch.setattr(ctw, "_BUCKET", 2_000)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    folder = ctw.train(spark, docs)
    path = folder.removeprefix("file://")
    assert len([f for f in os.listdir(path) if f.startswith("bucket-")]) == ctw._layout(folder).buckets > 1
    os.rename(f"{path}/bucket-1", f"{path}/moved")
    with pytest.raises(Exception, match="bucket-1"):
        ctw.score_documents(spark, docs, folder, ctw.word_counts(spark, docs)).collect()


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(ctw, "_PIECE", 50)
    docs = spark.createDataFrame([(1, "ab cd " * 100), (2, None), (3, ""), (4, "x"), (5, "Zz " * 33), (None, "ab cd " * 100)], "doc_id bigint, text string").repartition(2)
    folder = ctw.train(spark, docs)
    tree = ctw.load(folder)
    for reread in (False, True):
        rows = ctw.score_documents(spark, docs if not reread else docs.cache(), folder, ctw.word_counts(spark, docs), reread=reread).join(docs, "doc_id", "left").collect()
        assert len(rows) == 6
        for r in rows:
            text = "ab cd " * 100 if r["doc_id"] is None else r["text"] or ""
            assert abs(r["score"] - tree.log10(ctw.gram_codes([text.encode()])[0]).astype(float).sum()) < 1e-3


def test_buckets_without_a_kept_context(spark, monkeypatch):
    """Training texts in which no context of three bytes or more comes twice, and a bucket without any."""
    monkeypatch.setattr(ctw, "_BUCKET", 8)
    docs = spark.createDataFrame([(1, "abcdefghijkl"), (2, "zyxwvuts")], "doc_id bigint, text string")
    folder = ctw.train(spark, docs)
    tree = ctw.load(folder)
    for r in docs.join(ctw.score_documents(spark, docs, folder, ctw.word_counts(spark, docs)), "doc_id").collect():
        assert abs(r["score"] - tree.log10(ctw.gram_codes([r["text"].encode()])[0]).astype(float).sum()) < 1e-3


def test_codes_of_a_piece_are_held_once():
    """Fewer, larger pieces ask for fewer codes; their codes (eight bytes a byte of text) are never held twice."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, int(n), np.uint8)) for n in rng.integers(0, 9_000, 400)]
    parts = [(b"\0" * ctw.DEPTH, t) for t in texts]
    n = sum(map(len, texts))
    tracemalloc.start()
    codes, starts = ctw._codes(parts, ctw.DEPTH)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * n and len(codes) == n and starts.tolist() == np.cumsum([0, *map(len, texts)])[:-1].tolist()
    assert codes.tolist() == [c for t in texts for c in ctw._codes([(b"\0" * ctw.DEPTH, t)], ctw.DEPTH)[0].tolist()]
    seen, times = ctw._counted(codes)
    assert int(times.sum()) == n and (seen[1:] > seen[:-1]).all() and len(np.unique(codes)) == len(seen)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 1_000_000] * 18)], ["text"])
    assert [rows for rows, _ in ctw._pieces([batch], ctw.DEPTH, ctw._PIECE)] == [10, 8]


def _scored_as_by_the_whole_tree(docs, folder, words):
    tree, spark = ctw.load(folder), docs.sparkSession
    rows = docs.join(ctw.score_documents(spark, docs, folder, words), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(r["score"] - tree.log10(ctw.gram_codes([r["text"].encode()])[0]).astype(float).sum()) < 1e-3


def test_scoring_holds_the_codes_of_a_run_only(spark, monkeypatch):
    """A piece's codes, eight bytes for each of its bytes, are made in runs while it is scored; a text may be longer than a run."""
    monkeypatch.setattr(ctw, "_PIECE", 20_000)
    monkeypatch.setattr(ctw, "_RUN", 1_000)
    text = F.repeat(F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") % 50 == 0, 60).otherwise(3).cast("int"))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(2)
    folder, words, codes = ctw.train(spark, docs), ctw.word_counts(spark, docs), ctw._codes

    def few(parts, depth):
        if sum(len(t) for _, t in parts) > 1_000:
            raise MemoryError("codes of more than a run")
        return codes(parts, depth)

    with monkeypatch.context() as m:
        m.setattr(ctw, "_codes", few)
        scored = ctw.score_documents(spark, docs, folder, words)
        scored.count()
    _scored_as_by_the_whole_tree(docs, folder, words)


def test_the_different_codes_of_runs_are_those_of_the_piece(monkeypatch):
    monkeypatch.setattr(ctw, "_RUN", 700)
    rng = np.random.default_rng(2)
    for letters in (3, 200):
        parts = [(i, b"\0" * ctw.DEPTH, bytes(rng.integers(1, 1 + letters, int(n), np.uint8))) for i, n in enumerate(rng.integers(1, 3_000, 40))]
        assert ctw._distinct(parts, ctw.DEPTH).tolist() == ctw._counted(ctw._codes([p[1:] for p in parts], ctw.DEPTH)[0])[0].tolist()


def test_places_of_numbers():
    rng = np.random.default_rng(3)
    for keys in (np.array([7], np.uint64), np.arange(5_000, dtype=np.uint64) << np.uint64(48), np.unique(rng.integers(0, 1 << 56, 20_000, np.uint64)), np.arange(3_000, dtype=np.uint64)):
        at = rng.integers(0, len(keys), 50_000)
        assert (ctw.Places(keys).of(keys[at]) == at).all()
    # whatever the tables say, the search finds them
    blind = ctw.Places(keys)
    blind.tables = [np.zeros_like(t) for t in blind.tables]
    assert (blind.of(keys[at]) == at).all()


def test_a_text_that_ends_where_the_piece_does(spark, monkeypatch):
    """The next text begins in the next piece, not with none of its bytes in the one that is full."""
    monkeypatch.setattr(ctw, "_PIECE", 50)
    monkeypatch.setattr(ctw, "_RUN", 25)
    docs = spark.createDataFrame([(i, ("ab cd %03d " % i * 6)[:49 if i % 3 else 24]) for i in range(30)], "doc_id bigint, text string").coalesce(1)
    _scored_as_by_the_whole_tree(docs, ctw.train(spark, docs), ctw.word_counts(spark, docs))
