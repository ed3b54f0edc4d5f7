"""Fingerprints, archives, token files, lattices and scores."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_data import docs, no_docs, pairs, prose  # noqa: F401

from urlscope.llm import common, ctw, imatch, lattice, quality, tokens, toxicity, warc


# ---- I-Match ---------------------------------------------------------------------------

def test_edited_pairs(spark, docs):
    words = imatch.lexicon(spark, docs, low=0.05, high=0.9)
    got = imatch.edited_pairs(spark, docs, words).collect()
    assert len(got) == len(pairs())
    own = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    order = sorted({i for i, _ in pairs() if i is not None and i not in (30, 31)}, reverse=True)
    texts = {i: t or "" for i, t in pairs()}
    for i, j in zip(order, order[1:]):
        t, n = texts[i], len(texts[i]) // 3
        e = t[:len(t) - n] + texts[j][:n]
        r = own[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == imatch.fingerprint(t.encode(), words).hex()
        assert r["edited_fingerprint"] == imatch.fingerprint(e.encode(), words).hex()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert own[2]["fingerprint"] == own[3]["fingerprint"]


def test_last_document_is_followed_by_the_first(spark):
    df = spark.createDataFrame([(i, prose(i, 40)) for i in range(9)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.edited_pairs(spark, df, frozenset()).collect()}
    t, first = prose(0, 40), prose(8, 40)
    n = len(t) // 3
    assert got[0] == hashlib.sha256((t[:len(t) - n] + first[:n]).encode()).hexdigest()
    one = spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")
    assert imatch.edited_pairs(spark, one, frozenset()).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def brute_fingerprint(text, lexicon):
    """Subset by subset and term by term."""
    import struct

    import xxhash
    own = {w for w in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", text) if w}
    own = {"".join(c.lower() if c.isascii() else c for c in w).encode() for w in own}
    kept = sorted(w for w in own if w in lexicon) or sorted(own)
    if not kept:
        return hashlib.blake2b(text.encode(), digest_size=2).digest() * len(imatch.RATES)
    out = []
    for i, rate in enumerate(imatch.RATES):
        seed = (i + 1) * 0x9E3779B97F4A7C15 % 2 ** 64
        picked = b""
        for w in kept:
            h = xxhash.xxh64_intdigest(w, 1)
            if ((h ^ seed) * 0xC2B2AE3D27D4EB4F % 2 ** 64 >> 40) % rate == 0:
                picked += struct.pack("<Q", h)
        out.append(xxhash.xxh32_intdigest(picked, i) % 65535 + 1 if picked else 0)
    return struct.pack(f"<{len(out)}H", *out)


def test_fingerprints_against_brute_force():
    texts = [t or "" for _, t in pairs()] + [prose(2, 30)[:k] for k in range(0, 60, 7)]
    words = sorted({w for t in texts for w in imatch.terms(t.encode())})
    for lexicon in (frozenset(), frozenset(words[::3]), frozenset(words[::50])):
        made = [imatch.fingerprint(t.encode(), lexicon) for t in texts]
        assert made == [brute_fingerprint(t, lexicon) for t in texts]
        for a, b in itertools.islice(itertools.combinations(made, 2), 60):
            x, y = (np.frombuffer(f, "<u2").tolist() for f in (a, b))
            used = [(r, p == q) for r, p, q in zip(imatch.RATES, x, y) if p or q]
            want = 1.0 if a == b else sum(r for r, same in used if same) / sum(r for r, _ in used) if used else 0.0
            assert abs(imatch.likeness(a, b) - want) < 1e-12


def test_lexicon_band(spark):
    df = spark.createDataFrame([(i, f"all {'half' if i % 2 else ''} {'few' if i < 3 else ''} only{i}") for i in range(20)], "doc_id bigint, text string")
    assert imatch.lexicon(spark, df, low=0.1, high=0.6) == {b"half", b"few"}
    assert imatch.lexicon(spark, df.where("false")) == frozenset()
    assert imatch.edited_pairs(spark, df.where("false"), frozenset()).count() == 0


def test_likeness_falls_with_edits():
    a = " ".join(f"w{i}" for i in range(200))
    near = " ".join(f"w{i}" for i in range(30, 200)) + " more"
    far = " ".join(f"v{i}" for i in range(200))
    f = [imatch.fingerprint(x.encode(), frozenset()) for x in (a, near, far)]
    assert imatch.likeness(f[0], f[0]) == 1 and imatch.likeness(f[0], f[1]) > 0.3 > imatch.likeness(f[0], f[2])


# ---- archive ---------------------------------------------------------------------------

PAGES = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, ""), (7, "http://c/\r\nX: y", None), (9, "http://d/", "x" * 50_000),
         (None, "http://e/", "x" * 50_000), (11, "http://f/", "one"), (11, "http://f/", "one"), (12, "http://g/", "two")]


def test_archive(spark, tmp_path):
    df = spark.createDataFrame([(*p, "a", "b") for p in PAGES], "page_id bigint, url string, html string, sha256 string, payload string")
    warc.write_store(spark, df, str(tmp_path / "store"))
    got = warc.parse(warc.records(spark, str(tmp_path / "store"))).collect()
    want = Counter()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        least = min((p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        kind = "response" if i == least else "revisit"
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else least] += 1
    one = (11, 3, base64.b32encode(hashlib.sha1(b"one").digest()).decode())
    want[(*one, "response", None)] -= 1  # of two equal rows one revisits the other
    want[(*one, "revisit", 11)] += 1
    assert Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert spark.read.parquet(str(tmp_path / "store/payloads")).count() == 5
    warc.export_files(spark, str(tmp_path / "store"), str(tmp_path / "out"))
    text = b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and text.count("<p>é</p>".encode()) == 1 and b"\r\nX: y" not in text


def test_exported_files_are_read_again(spark, tmp_path):
    """Store, WARC files and back: every record with its exact header and payload."""
    df = spark.createDataFrame([(*p,) for p in PAGES], "page_id bigint, url string, html string").repartition(3)
    warc.write_store(spark, df, str(tmp_path / "store"))
    warc.export_files(spark, str(tmp_path / "store"), str(tmp_path / "out"))
    back = Counter((r["id"], bytes(r["header"]), bytes(r["payload"])) for r in warc.restored(warc.read_files(spark, str(tmp_path / "out"))).collect())
    assert back == Counter((r["id"], bytes(r["header"]), bytes(r["payload"])) for r in warc.records(spark, str(tmp_path / "store")).collect())
    assert Counter((i, p) for i, _, p in back.elements()) == Counter((p[0], (p[2] or "").encode()) for p in PAGES)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="cut short"):
        warc.read_files(spark, str(tmp_path / "bad")).collect()
    empty = df.where("false")
    warc.write_store(spark, empty, str(tmp_path / "none"))
    warc.export_files(spark, str(tmp_path / "none"), str(tmp_path / "no-files"))
    assert warc.restored(warc.read_files(spark, str(tmp_path / "no-files"))).collect() == []


def test_damaged_archive(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:2], "page_id bigint, url string, html string")
    warc.write_store(spark, df, str(tmp_path / "store"))
    bad = warc.records(spark, str(tmp_path / "store")).selectExpr("header", "cast('other' as binary) as payload", "intact")
    with pytest.raises(Exception, match="digest"):
        warc.parse(bad).collect()


def test_empty_archive(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_store(spark, df, str(tmp_path / "store"))
    assert warc.parse(warc.records(spark, str(tmp_path / "store"))).count() == 0


# ---- token files -----------------------------------------------------------------------

def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("hot", [7, None])
def test_an_id_with_many_rows_fills_several_files(spark, tmp_path, hot):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer())
    rows = [(hot, prose(i, 12)) for i in range(120)] + [(i, prose(900 + i, 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    listed = tokens.write_files(spark, df, tokenizer(), f"file://{tmp_path}/t", files=12)
    assert listed.agg({"n_docs": "max"}).first()[0] < 60 and listed.agg({"n_docs": "sum"}).first()[0] == 180
    got = sorted(tokens.read_files(listed).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))
    crcs = [zlib.crc32(np.frombuffer(r["ids"], "<u4").astype("<u2").tobytes()) for r in got if r["doc_id"] == hot]
    assert len(crcs) >= 120 and crcs == sorted(crcs)
    want = Counter((i, np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in rows)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer())
    listed = tokens.write_files(spark, docs, tokenizer(), f"file://{tmp_path}/t", files=4)
    got = tokens.read_files(listed).collect()
    ids = {}
    for i, t in pairs():
        ids.setdefault(i, []).append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, x) for i, v in ids.items() for x in v)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)


def test_no_token_files(spark, no_docs, tmp_path):
    assert tokens.read_files(tokens.write_files(spark, no_docs, tokenizer(), f"file://{tmp_path}/t", files=4)).count() == 0


@pytest.mark.parametrize("n", [1, 511, 512, 513, 1024, 5000])
def test_any_token_without_decoding(n):
    r = np.random.default_rng(n)
    ids = (r.integers(0, 1 << 24, n) >> r.integers(0, 24, n)).astype(np.uint32)
    raw = tokens.pack(np.array([1]), np.array([n]), ids)
    seen = []
    reader = tokens.Reader(lambda offset, size: seen.append(size) or raw[offset:offset + size])
    assert (reader.tokens(0, n) == ids).all()
    del seen[:]
    for i in {0, n - 1, n // 2, min(n - 1, 512), min(n - 1, 511)}:
        assert reader.token(i) == ids[i] and (reader.tokens(i, min(n, i + 7)) == ids[i:i + 7]).all()
    assert max(seen) <= 64


# ---- lattices --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lat():
    return lattice.Lattice(lattice.piece_model())


def test_lossless_round_trip(spark, docs, lat):
    got = lattice.encode(docs, lattice.piece_model())
    back = Counter((r["doc_id"], r["text"]) for r in lattice.decode(got, lattice.piece_model()).collect())
    assert back == Counter((i, t or "") for i, t in pairs())
    assert all(r["lossless"] for r in lattice.round_trip(docs, lattice.piece_model()).collect())
    for t in ("x" * 5000, "漢字" * 300 + "￾▁ ", "  a  b ", "\x00", "é" * 47 + " " * 60):
        assert lat.decode(lat.sample([t], [1])[0]) == t


def test_draws_depend_on_the_row_only(spark, docs):
    a = sorted((str(r["doc_id"]), r["ids"]) for r in lattice.encode(docs, lattice.piece_model()).collect())
    b = sorted((str(r["doc_id"]), r["ids"]) for r in lattice.encode(docs.repartition(7).orderBy("text"), lattice.piece_model()).collect())
    c = sorted((str(r["doc_id"]), r["ids"]) for r in lattice.encode(docs, lattice.piece_model(), seed=1).collect())
    assert a == b != c


def test_draws_have_the_paths_shares():
    lat = lattice.Lattice(lattice.piece_model(), alpha=0.3)
    word, n = " thein", 20_000
    spelled = word.replace(" ", lattice.BLANK)

    def paths(i):
        if i == len(word):
            yield (), 1.0
        for j in range(i + 1, len(word) + 1):
            if spelled[i:j] in lat.pieces:
                p = lat.pieces[spelled[i:j]]
                yield from (((p, *rest), lat.weight[p] * w) for rest, w in paths(j))

    want = dict(paths(0))
    total = sum(want.values())
    got = Counter(tuple(x.tolist()) for x in lat.sample([word] * n, [lattice.row_key(i) for i in range(n)]))
    assert set(got) <= set(want)
    for p, w in want.items():
        share = w / total
        assert abs(got[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_long_runs_keep_their_shares(lat):
    # a run longer than a kept word is filtered in the same way
    run = "thein" * 40
    got = lat.sample([run] * 50, list(range(50)))
    assert len({tuple(x.tolist()) for x in got}) > 1 and all(lat.decode(x) == run for x in got)


def test_no_texts(spark, no_docs, lat):
    assert lattice.encode(no_docs, lattice.piece_model()).count() == 0
    assert lat.sample([], []) == [] and lat.sample([""], [1])[0].tolist() == []


# ---- context trees ---------------------------------------------------------------------

def brute_tree(texts, depth):
    """log block probability of every binary node by the definition, all contexts kept."""
    counts = Counter()
    for t in texts:
        raw = b"\0" * depth + t.lower() + b"\0"
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[raw[i - d:i], 1 << j | raw[i] >> 8 - j, raw[i] >> 7 - j & 1] += 1

    def pe(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    nodes = {(c, p) for c, p, _ in counts}

    def block(c, p):
        own = pe(counts[c, p, 0], counts[c, p, 1])
        if len(c) == depth:
            return own
        below = sum(block(x, p) for x in (bytes([b]) + c for b in range(256)) if (x, p) in nodes)
        return np.logaddexp(own, below) - math.log(2)

    def one(c, p, d):
        """Probability of a one, from the node of depth d on."""
        s = c[len(c) - d:]
        a, b = counts[s, p, 0], counts[s, p, 1]
        kt = (b + .5) / (a + b + 1)
        if d == depth or (c[len(c) - d - 1:], p) not in nodes:
            return kt
        w = math.exp(pe(a, b) - math.log(2) - block(s, p))
        return w * kt + (1 - w) * one(c, p, d + 1)

    def log10(c, byte):
        out = 0.0
        for j in range(8):
            p, bit = 1 << j | byte >> 8 - j, byte >> 7 - j & 1
            x = one(c, p, 0) if (b"", p) in nodes else .5
            out += math.log10(x if bit else 1 - x)
        return out

    return log10


def test_tree_against_the_definition(spark):
    texts = [b"abracadabra", b"Abra abra", b"cad cab"]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")
    tree = ctw.load(ctw.train(spark, df, depth=2, least=0.0, minimum=1))
    want = brute_tree(texts, 2)
    for c in (b"ab", b"ra", b"\0a", b"zz", b"a ", b"br", b"qa"):
        codes = np.array([int.from_bytes(c, "big") << 8 | b for b in range(256)], np.uint64)
        got = tree.log10(codes)
        assert abs((10.0 ** got.astype(float)).sum() - 1) < 1e-4
        assert np.allclose(got, [want(c, b) for b in range(256)], atol=1e-5)


def test_contexts_that_are_not_kept(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abracadabra", "abra abra", "cad cab"])], "doc_id bigint, text string")
    tree = ctw.load(ctw.train(spark, df, depth=2, least=0.08))
    assert 0 < tree.contexts[2].used.sum() < 12
    for c in (b"ab", b"ra", b"zz", b"a "):
        codes = np.array([int.from_bytes(c, "big") << 8 | b for b in range(256)], np.uint64)
        assert abs((10.0 ** tree.log10(codes).astype(float)).sum() - 1) < 1e-4


def test_one_context_against_the_definition(spark):
    texts = [b"ababababab"] * 4
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")
    tree = ctw.load(ctw.train(spark, df, depth=1, least=0.0))
    want = brute_tree(texts, 1)
    for c in (b"a", b"b", b"\0"):
        codes = np.array([c[0] << 8 | b for b in range(256)], np.uint64)
        assert np.allclose(tree.log10(codes), [want(c, b) for b in range(256)], atol=1e-5)


@pytest.mark.parametrize("least_word", [1e-6, 0.5])
def test_scores(spark, docs, least_word, monkeypatch):
    monkeypatch.setattr(ctw, "LEAST_WORD", least_word)
    known = docs.where("doc_id is null or doc_id < 25")
    tree = ctw.train(spark, known, depth=3, least=1e-4)
    got = ctw.score_documents(spark, docs, tree, ctw.word_counts(spark, known)).collect()
    counts = Counter(w for i, t in pairs() if i is None or i < 25 for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    loaded = ctw.load(tree)
    for i, t in pairs():
        raw = (t or "").encode()
        own = [*raw.lower().split(), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        score = loaded.log10(ctw.gram_codes([raw], 3)[0]).astype(float).sum()
        want[i, len(own), sum(w in counts for w in own), n, round(base, 6), round(score, 3)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 3)) for r in got) == want


def test_nothing_to_learn_from(spark, docs, no_docs):
    tree = ctw.train(spark, no_docs)
    got = ctw.score_documents(spark, docs, tree, ctw.word_counts(spark, no_docs)).collect()
    assert len(got) == len(pairs()) and all(abs(r["score"] + 8 * math.log10(2) * (r["n_bytes"] + 1)) < 1e-3 * (r["n_bytes"] + 1) for r in got)
    assert ctw.score_documents(spark, no_docs, tree, ctw.word_counts(spark, docs)).count() == 0


def test_filtered_words_do_not_depend_on_each_other():
    """A word's shares are the same bits whether it is filtered alone or with others."""
    import public_tokenizers
    words = sorted({w for i in range(30) for w in (" " + prose(i, 60)).replace(" ", "| ").split("|") if w})
    together, alone = (lattice.Lattice(public_tokenizers.path("piece_bpe_32k.model")) for _ in range(2))
    ends = together.states(words)
    for w, end in zip(words[:200], ends):
        alone.clear()
        one = int(alone.states([w])[0])
        for back in range(len(w)):
            x, y = int(end) - back, one - back
            lo, hi = together.first[x], together.first[x + 1] if x + 1 < together.n_states else together.n_edges
            at, to = alone.first[y], alone.first[y + 1] if y + 1 < alone.n_states else alone.n_edges
            assert (together.share[lo:hi] == alone.share[at:to]).all() and (together.id[lo:hi] == alone.id[at:to]).all()


def test_a_hot_id_brings_one_row_to_the_fit(spark):
    """The fits see one row of each id, however many there are, and the same one however rows are dealt."""
    rows = [(i, prose(i, 40) + (" vilebadword" if i % 2 else "")) for i in range(40)]
    many = spark.createDataFrame(rows + [(1, prose(500 + k, 40)) for k in range(300)], "doc_id bigint, text string").repartition(7)
    once = common.one_text_each(many.selectExpr("doc_id as id", "text"))
    assert once.count() == 40 and once.dtypes == [("id", "bigint"), ("text", "string")]
    once = once.withColumnRenamed("id", "doc_id")
    posterior = quality.weak_model(many)[2]
    assert (quality.train(many, posterior) == quality.train(once, posterior)).all()
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    assert toxicity.train(many, labels) == toxicity.train(once, labels)
    names = spark.createDataFrame([("a", "x"), ("a", None), ("b", None)], "id string, text string")
    assert common.one_text_each(names).count() == 2


# ---- toxicity --------------------------------------------------------------------------

def toxic_rows():
    out = []
    for i in range(400):
        t = prose(5000 + i, 60)
        if i % 4 == 0:
            half = len(t) // 2
            t = t[:half] + f" you vilebad{'abcdefgh'[i // 4 % 8]} thing. " + t[half:]
        out.append((i, t, int(i % 4 == 0)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(None, 1), (3, None), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    assert sum((got[i]["toxicity"] >= .5) == y for i, _, y in rows if i >= 300) >= 97
    for i, t, y in rows[300:]:
        if y and got[i]["toxicity"] >= .5:
            assert any(w.startswith(b"vilebad") for w in toxicity.sentences(t.encode())[got[i]["worst_sentence"]])


def test_toxicity_defined_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(pairs()) and all(0 <= r["toxicity"] <= 1 for r in got)
    assert {r["worst_sentence"] for r in got if r["doc_id"] in (20, 21, 22)} == {-1}
    assert len(toxicity.score_rows(docs, model).columns) == len(docs.columns) + 2  # one name was there before
    assert toxicity.train(docs, labels.where("false")).keys() == {b""}
    assert toxicity.score_documents(no_docs, model).count() == 0 and toxicity.train(no_docs, labels).keys() == {b""}


def test_noisy_or():
    weights = toxicity.Weights({b"bad": 3.0})
    p = lambda z: 1 / (1 + math.exp(-z))
    got, worst, top = toxicity.score(b"fine words. bad words! bad bad", -2.0, weights)
    assert abs(got - (1 - (1 - p(-2)) * (1 - p(1)) ** 2)) < 1e-12 and worst == 1 and abs(top - p(1)) < 1e-12


# ---- quality ---------------------------------------------------------------------------

def test_expectation_maximisation_finds_the_classes():
    r = np.random.default_rng(1)
    counts, truth = Counter(), Counter()
    for _ in range(5000):
        good = r.random() < .8
        p = 0
        for name, _ in quality.LABELLERS:
            bad_only = name in dict(quality.BAD)
            vote = (0 if not good and r.random() < .4 else 1) if bad_only else (2 if r.random() < (.95 if good else .1) else 1)
            p = p * 3 + vote
        counts[p] += 1
        truth[p] += good
    share, table, post = quality.expectation_maximisation(counts)
    assert abs(share - .8) < .03
    assert sum(truth[p] if post[p] >= .5 else counts[p] - truth[p] for p in counts) > .97 * 5000
    assert table.shape == (len(quality.LABELLERS), 2, 3)


def test_quality_held_out(spark):
    rows = [(i, prose(9000 + i, 80) + ".") for i in range(300)]
    junk = [(1000 + i, " | ".join(prose(9500 + i, 60).split()) if i % 2 else " ".join(w + "%%%" for w in prose(9500 + i, 60).split())) for i in range(60)]
    df = spark.createDataFrame(rows + junk, "doc_id bigint, text string")
    _, _, post = quality.weak_model(df)
    got = {r["doc_id"]: r["predicted"] for r in quality.score_documents(df, post, quality.train(df, post)).collect()}
    assert sum(got[i] for i, _ in rows) > 290 and sum(got[i] for i, _ in junk) < 3


def test_quality_defined_cases(spark, docs, no_docs):
    _, _, post = quality.weak_model(docs)
    weights = quality.train(docs, post)
    got = quality.score_documents(docs, post, weights).collect()
    assert len(got) == len(pairs()) and all(0 <= r["score"] <= 1 and len(r["votes"]) == len(quality.LABELLERS) for r in got)
    assert quality.score_documents(no_docs, post, weights).count() == 0
    _, _, none = quality.weak_model(no_docs)
    assert none == {} and not quality.train(no_docs, none).any()


def test_votes_text():
    f = quality.facts(b"")[1]
    assert quality.votes_text(quality.votes(f))[8] == "-" and list(itertools.islice(quality.votes_text(0), 2)) == ["-", "-"]
    assert zlib.crc32(b"") == 0
