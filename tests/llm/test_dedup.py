"""SimHash groups, repeated byte strings and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_data import brute_bits, brute_components, docs, no_docs, pairs, prose  # noqa: F401

from pyspark.sql import functions as F

from urlscope.llm import decontaminate, simhash, suffix_array
from urlscope.llm.components import components


def test_fingerprint_is_majority_of_hash_bits():
    for _, t in pairs():
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_bits(t)


def test_near_duplicates(spark, docs):
    got = simhash.near_duplicates(spark, docs).collect()
    want = brute_components([(i, brute_bits(t)) for i, t in pairs()], 4)
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == Counter(
        (i, brute_bits(t), c) for (i, t), c in zip(pairs(), want))


@pytest.mark.parametrize("chunk", [8, 16384])
def test_links_of_dense_groups(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(6)]
    for c in fps[:3]:
        for _ in range(60):
            x = c
            for b in r.sample(range(20), r.randint(0, 7)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    for agree in (2, 3):
        out = components(spark, simhash.links(spark, df, 4, agree))
        got = {r["node"] & (1 << 64) - 1: r["component"] for r in out.collect()}
        want = brute_components([(i, x) for i, x in enumerate(fps)], 4)
        groups = Counter(frozenset(fps[j] for j, w in enumerate(want) if w == c) for c in want if want.count(c) > 1)
        have = {}
        for x, c in got.items():
            have.setdefault(c, set()).add(x)
        assert {frozenset(x) for x in have.values()} == set(groups)


def test_components_of_long_chains(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components(spark, df).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_no_documents(spark, no_docs):
    assert simhash.near_duplicates(spark, no_docs).count() == 0
    assert suffix_array.Repeats(spark, no_docs).removed(no_docs).count() == 0
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate.Index(spark, no_docs, bench).contamination().count() == 0


def brute_repeats(texts: list[bytes], length: int = 200):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        covered = np.cumsum(mark)[:len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~covered].tobytes()
        out.append((len(t), int(covered.sum()), int((np.diff(np.append(0, covered.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, occurrences, piece", [(1, False, 100_000), (20_000, False, 100_000), (20_000, True, 100_000), (20_000, True, 4), (1, False, 1), (1, True, 4)])
def test_repeats(spark, docs, hot, occurrences, piece, monkeypatch):
    monkeypatch.setattr(suffix_array, "PIECE", piece)
    found = suffix_array.Repeats(spark, docs, hot=hot, occurrences=occurrences)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
                  for r in found.removed(docs).collect())
    texts = [(t or "").encode() for _, t in pairs()]
    assert got == Counter((i, *x) for (i, _), x in zip(pairs(), brute_repeats(texts)))
    assert sum(x[1] for x in brute_repeats(texts)) > 1000


def test_segments_of_very_long_texts(monkeypatch):
    texts = [(t or "").encode() for _, t in pairs()]
    whole = suffix_array.anchors(texts)
    monkeypatch.setattr(suffix_array, "_SEGMENT", 700)
    assert all((a == b).all() for a, b in zip(whole, suffix_array.anchors(texts)))


def test_intervals_and_maximal_repeats():
    text = "mississippi"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] + [next(n for n in range(12) if text[a + n:a + n + 1] != text[b + n:b + n + 1] or not text[a + n:a + n + 1] or not text[b + n:b + n + 1])
                 for a, b in zip(order, order[1:])]
    got = {text[order[lo]:order[lo] + size]: {order[i] for i in range(lo, hi + 1)} for size, lo, hi in suffix_array.intervals(lcp)}
    assert got == {"i": {1, 4, 7, 10}, "issi": {1, 4}, "p": {8, 9}, "s": {2, 3, 5, 6}, "si": {3, 6}, "ssi": {2, 5}}


@pytest.mark.parametrize("piece", [1, 2, 3, 4, 5, 100_000])
def test_runs_over_several_pieces(spark, piece, monkeypatch):
    """One string in many equal documents, and in some with other surroundings: no row of a long run is lost."""
    monkeypatch.setattr(suffix_array, "PIECE", piece)
    shared, same = prose(3, 60), prose(4, 90)
    texts = [same] * 12 + [prose(10 + i, 5) + shared + prose(50 + i, 5) for i in range(9)] + [prose(7, 80) + same[:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(20, "doc_id")
    found = suffix_array.Repeats(spark, df)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found.removed(df).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts])))


@pytest.mark.parametrize("hot", [1, 20_000])
def test_groups_hold_all_occurrences(spark, hot):
    shared = prose(5, 30).encode()[:210].decode("utf-8", "ignore")
    rows = [(i, prose(40 + i, 20) + f"#{i}" + shared + f"{i}# " + prose(60 + i, 20)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = {}
    for r in suffix_array.Repeats(spark, df, occurrences=True, hot=hot).groups().collect():
        t = rows[r["doc_id"]][1].encode()
        groups.setdefault(r["number"], set()).add((r["doc_id"], r["start"], t[r["start"]:r["start"] + r["length"]]))
    for members in groups.values():
        assert len({m[2] for m in members}) == 1 and len(members) > 1
    assert any({m[0] for m in members} == set(range(5)) for members in groups.values())


def test_characters_stay_whole():
    text = "aéb".encode()
    assert suffix_array._cut(text, [{"start": 2, "end": 4}], True)[3] == "aé".encode()
    assert suffix_array._cut(text, [{"start": 0, "end": 2}], True)[3] == "éb".encode()
    assert suffix_array._cut(text, [{"start": 1, "end": 3}], True)[3] == b"ab"


BENCH = [(1, prose(0, 200)[60:200]), (2, "x"), (2, prose(6, 40)), (3, None), (4, ""), (None, prose(1, 30)), (10, prose(2, 25).upper()), (5, "de de de")]


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, bench, window=10):
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            b = words(b)
            n = min(window, len(b))
            grams = {tuple(b[s:s + n]) for s in range(len(b) - n + 1)} if b else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s:s + n]) in grams:
                    hit.update(range(s, s + n))
                    items.add(item)
        items = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(items), ",".join(items)))
    return out


@pytest.mark.parametrize("small", [0, 500_000])
def test_contamination(spark, docs, small, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in BENCH], "item_id bigint, text string, b string, n int")
    got = decontaminate.Index(spark, docs, bench).contamination().collect()
    want = brute_contamination(pairs(), BENCH)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in got) == Counter(want)
    assert sum(x[2] > 0 for x in want) > 3


def test_empty_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.Index(spark, docs, bench).contamination().collect()
    assert len(got) == len(pairs()) and not any(r["n_hit"] for r in got)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha one two beta three gamma"), (2, "gamma " + "w " * 30 + "beta alpha"), (3, "beta alpha")],
                               "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    got = decontaminate.Index(spark, df, bench).proximity(terms=3, slop=6).collect()
    assert {r["doc_id"] for r in got} == {1}


def brute_near(rows, bench, terms, slop, window=10):
    """Windows by their texts' number: (doc_id, item, window, place) where the rarest words stand near each other."""
    docs = [(i, words(t)) for i, t in rows]
    items = [(i, words(t)) for i, t in bench]
    known = {w for _, x in items for w in x}
    tf = Counter(w for _, x in docs for w in x if w in known)
    out = set()
    for i, x in items:
        size = min(window, len(x))
        for ws in range(len(x) - size + 1) if x else ():
            own = sorted(range(ws, ws + size), key=lambda at: (tf[x[at]], at))
            if not tf[x[own[0]]]:
                continue
            rare = [x[at] for at in own[:min(terms, size)]]
            for d, y in docs:
                for pos, w in enumerate(y):
                    if w == rare[0] and all(any(z == r and abs(k - pos) <= slop for k, z in enumerate(y[max(0, pos - slop):pos + slop + 1], max(0, pos - slop))) for r in rare[1:]):
                        out.add((d, len(y), i, ws, pos))
    return out


@pytest.mark.parametrize("terms,slop,small", [(3, 6, 500_000), (2, 1, 500_000), (1, 4, 500_000), (3, 20, 0)])
def test_proximity_against_brute_force(spark, docs, no_docs, terms, slop, small, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    items = [(i, t) for i, t in BENCH if i is not None]
    items = [(k, t) for k, (_, t) in enumerate(items)] + [(90, "ta lo ta"), (91, "mir"), (92, ""), (93, None), (94, "nowhere ta")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontaminate.Index(spark, docs, bench)
    names = index.items.select("b", F.col("item_id").cast("long").alias("item")).distinct()
    sizes = index.postings.where("t = -1").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_words").distinct()
    got = index.proximity(terms=terms, slop=slop).join(names, "b").join(sizes, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    got = {(r["doc_id"], r["n_words"], r["item"], r["ws"], r["pos"]) for r in got.collect()}
    assert got == brute_near(pairs(), items, terms, slop) and got
    assert decontaminate.Index(spark, no_docs, bench).proximity().count() == 0
