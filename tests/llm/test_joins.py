"""Cross-tokenizer alignment, n-gram join and ranked search against brute force."""

import bisect
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_data import docs, no_docs, pairs, prose  # noqa: F401
from urlscope.llm import crosstok, jaccard, ranked

# ---- alignment -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tool():
    return crosstok.Aligner(*crosstok.vocabularies())


def spelled(tool, text):
    """Whole texts by the libraries, without units."""
    raw = (" " + text).encode()
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    if b"".join(tool.bytes_a[i] for i in a) != raw or b"".join(tool.bytes_b[i] for i in b) != raw:
        return [], []
    return a, b


def brute_alignments(tool, texts):
    found, count = [], Counter()
    for t in texts:
        a, b = spelled(tool, t) if t else ([], [])
        ends_a, ends_b = (np.cumsum([len(tab[i]) for i in x], dtype=int).tolist() for x, tab in ((a, tool.bytes_a), (b, tool.bytes_b)))
        starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        links, j = [], 0
        for i in range(len(a)):
            while ends_b[j] <= starts_a[i]:
                j += 1
            k = j
            while k < len(b) and starts_b[k] < ends_a[i]:
                links.append((a[i], b[k]))
                k += 1
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((len(a), len(b), len(cuts), links, sum(len(x) * len(y) for x, y in groups), hashlib.sha256(text.encode()).hexdigest() if a else ""))
        count.update(set(links))
    best = {}
    for (a, _), c in count.items():
        best[a] = max(c, best.get(a, 0))
    return [(n, m, g, len(ls), s, sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), d) for n, m, g, ls, s, d in found]


def test_units_are_spelled_as_whole_texts_are(tool):
    r = random.Random(1)
    parts = ["a", "b", "Ab", "the", " ", " ", "  ", "\n", "\n\n", "\t", "é", "1", "23", ".", "'s", "'", "<|endoftext|>", "　", "\x00", "😀", "\r", "\x1c", "​", "<s>", "́"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        raw, a, b = tool.spelled(crosstok.units(t))
        assert b"".join(raw).decode() == " " + t
        assert (sum(a, []), sum(b, [])) == (tool.a.encode(" " + t, add_special_tokens=False).ids, tool.b.encode(t)), repr(t)


def test_slices_give_the_units_of_the_whole(tool, monkeypatch):
    text = prose(5, 400) + " \n x" + prose(6, 50)
    whole = crosstok.units(text)
    monkeypatch.setattr(crosstok, "_SLICE", 40)
    parts = list(crosstok._slices(text))
    assert len(parts) > 10 and sum(tool.spelled(sum(parts, []))[1], []) == sum(tool.spelled(whole)[1], [])


def test_products_are_those_of_dense_matrices():
    r = np.random.default_rng(2)
    for _ in range(20):
        n, m, k = r.integers(1, 8, 3)
        a, b = r.integers(0, 3, (n, k)) * (r.random((n, k)) < 0.5), r.integers(0, 3, (k, m)) * (r.random((k, m)) < 0.5)

        def csr(x):
            rows, columns = np.nonzero(x)
            return crosstok.Csr(np.append(0, np.cumsum(np.bincount(rows, minlength=len(x)))), columns, x[rows, columns], x.shape[1])
        got = csr(a).times(csr(b))
        dense = np.zeros((n, m), int)
        dense[got.rows(), got.indices] = got.values
        assert (dense == a @ b).all()
        back = csr(a).transposed()
        dense = np.zeros((k, n), int)
        dense[back.rows(), back.indices] = back.values
        assert (dense == a.T).all()


@pytest.mark.parametrize("least,kept", [(1e-6, 300_000), (1e-2, 300_000), (2.0, 60)])
def test_alignment_numbers(spark, docs, tool, monkeypatch, least, kept):
    monkeypatch.setattr(crosstok, "_KEPT", kept)
    rows = pairs()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_alignments(tool, [t for _, t in rows])))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in crosstok.summaries(spark, docs, *crosstok.vocabularies(), least=least).select(columns).collect()) == want


def test_alignments_as_rows(spark, docs, no_docs, tool):
    files = crosstok.vocabularies()
    assert not crosstok.alignments(no_docs, *files).collect() and not crosstok.summaries(spark, no_docs, *files).collect()
    for r in crosstok.alignments(docs, *files).where("doc_id in (2, 20, 24)").collect():
        text = dict(pairs())[r.doc_id]
        a, b = spelled(tool, text) if text else ([], [])
        assert (r.a, r.b) == (a, b)
        assert sum(x.bytes for x in r.links) == (len((" " + text).encode()) if a else 0)
        assert len(r.groups) <= len(r.links) and (not a or r.groups[0] == (0, 0))


# ---- n-gram join -----------------------------------------------------------------------

def brute_join(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    holders = defaultdict(list)
    for k, own in enumerate(sets):
        shared = Counter(j for g in own for j in holders[g])
        for g in own:
            holders[g].append(k)
        for j, c in shared.items():
            if 100 * c >= 80 * (len(own) + len(sets[j]) - c):
                up[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def crowded():
    r = random.Random(3)
    base = [[r.choice("abcdefghijklmnop") + str(r.randint(0, 30)) for _ in range(120)] for _ in range(5)]
    rows = [(None, None), (1, ""), (2, " \t"), (3, "x"), (4, "X"), (5, "x y"), (None, "x y"), (None, "q r s t u v")]
    for i in range(200):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice("zyxw") + str(r.randint(0, 50))
        rows.append((100 + i, " ".join(w[:r.randint(60, 120)] if r.random() < 0.3 else w)))
    rows += [(1000 + i, " ".join(r.choice("ab") for _ in range(r.randint(1, 14)))) for i in range(60)]
    rows += [rows[20]] * 3 + [(20, " ".join(base[0])), (20, " ".join(base[1]))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bounds", [{}, {"CHUNK": 7, "GROUP": 5, "PIECE": 2000, "RANGE": 900, "LARGE": 20_000}, {"ROUNDS": 0}, {"ROUNDS": 1}])
def test_join_components(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = crowded()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, h string, s int").repartition(3)
    assert Counter(tuple(r) for r in jaccard.near_duplicates(spark, df).collect()) == brute_join(rows)


def test_join_of_odd_rows(spark, docs, no_docs):
    assert not jaccard.near_duplicates(spark, no_docs).collect()
    assert Counter(tuple(r) for r in jaccard.near_duplicates(spark, docs).collect()) == brute_join(pairs())


def test_filters_lose_no_alike_pair():
    """The first shared shingle of an alike pair lies in both prefixes and passes."""
    r = random.Random(8)
    hit = 0
    for _ in range(400):
        x = set(r.sample(range(1 << 60), r.randint(1, 60)))
        y = set(r.sample(sorted(x), r.randint(max(1, len(x) * 7 // 10), len(x)))) | set(r.sample(range(1 << 60), r.randint(0, 8)))
        both = len(x & y)
        alike = 100 * both >= 80 * (len(x) + len(y) - both)
        assert alike == (both >= jaccard.needed(len(x), len(y), 80))
        if not alike:
            continue
        hit += 1
        sides = []
        for own, other in ((x, y), (y, x)):
            order = sorted(own)
            pos = next(i for i, h in enumerate(order) if h in other)
            assert pos < jaccard.prefix(len(own), 80)
            parts = np.bincount([h >> 60 & 15 for h in order[pos + 1:]], minlength=16).astype(np.uint8).view(np.int64)
            sides.append([np.array([v]) for v in (len(own), pos, *parts)])
        assert jaccard._passes(*sides, 80).all()
    assert hit > 100


# ---- ranked search ---------------------------------------------------------------------

def brute_search(rows, items, top):
    def terms(t):
        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)
    own = [(i, Counter(terms(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in own]
    n_docs, n_words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in own for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, words in asked.items():
        scores = []
        for (d, c), n in zip(own, sizes):
            m = 50 + 50 * n * n_docs // n_words if n else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(scores[:top])]
    return Counter(out)


ITEMS = [(1, prose(1000, 12)), (2, prose(1000, 12) + " " + prose(3, 8)), (3, prose(1000, 6)), (4, None), (5, " ,.; "), (6, "De TA lo"), (6, "mir"), (None, "ta ta lo"), (8, "nowhere-at-all")]


@pytest.mark.parametrize("cells,top", [(200_000, 50), (10, 50), (200_000, 2)])
def test_search(spark, docs, cells, top):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id int, text string, doc_id string")
    got = ranked.search(spark, docs, items, cells=cells, top=top)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(pairs(), ITEMS, top)


def test_search_of_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "ta")], "item_id int, text string")
    assert not ranked.search(spark, no_docs, items).collect()
    assert not ranked.search(spark, docs, items.where("false")).collect()


def test_shared_sets_are_summed_once():
    r = random.Random(4)
    core = [list(range(100 * k, 100 * k + 12)) for k in range(4)]
    items = [sorted({*core[r.randrange(4)], *core[r.randrange(4)][:7], *r.sample(range(400, 460), 5)}) for _ in range(30)]
    plan = ranked.Plan(items, 460)

    def leaves(x):
        return [x] if x < 460 else [t for c in plan.nodes[x - 460] for t in leaves(c)]
    assert [sorted(t for x in own for t in leaves(x)) for own in plan.items] == items
    assert all(max(c) < 460 + k for k, c in enumerate(plan.nodes))
    used = Counter(x for own in [*plan.items, *plan.nodes] for x in own)
    assert plan.additions() < sum(len(x) - 1 for x in items) / 2
    assert all(used[460 + k] > 1 for k in range(len(plan.nodes))) or plan.additions() < 200
