"""Quality scores without hand labels: a weak-label model trains a hashed linear scorer.

1. Overlapping heuristic labellers vote good (+), bad (-) or nothing (0) on every document.
2. The votes of all documents are counted by pattern (at most 2 ** len(LABELLERS) rows reach the
   driver). Expectation-maximisation estimates each labeller's accuracies, that is the
   probability of its three votes given either class, and the share of good documents.
3. The posterior of its vote pattern is a document's weak label. A logistic scorer over hashed
   features (words, word shapes, repeats) is fitted to these posteriors, on at most ``max_docs``
   documents (a documented bound; those with the smallest hash of the id).
4. Every document gets its weak label and its score. Scores generalise where no labeller votes.

Defined cases: null text counts as empty; a text without words gets no vote but that of the labeller
of empty texts, and the scorer's bias as its score. Repeated rows are scored one by one, null ids too
(the fit leaves them out). An empty table gives no rows. Extra columns are ignored; labels,
source and lang are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

MAX_DOCS = 4000
BUCKETS = 1 << 16
_SYMBOLS = re.compile(rb"[%&$#*|{}<>\[\]@^~\\_=+]")
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


#: Name and rule of each labeller over what ``facts`` gives. The first nine say bad or nothing,
#: the last three, which overlap them and each other, good or nothing.
BAD = (
    ("symbols", lambda f: f["symbols"] > 0.03),
    ("bare marks", lambda f: f["n"] >= 5 and f["bare"] > 0.1),
    ("repeats", lambda f: f["n"] >= 5 and f["repeats"] > 0.1),
    ("variety", lambda f: f["n"] >= 20 and f["distinct"] < 2.2 / math.sqrt(f["n"])),
    ("short words", lambda f: f["n"] >= 20 and f["short"] < 0.12),
    ("sentences", lambda f: f["n"] >= 30 and not 0 < f["ends"] <= 0.5),
    ("digits", lambda f: f["digits"] > 0.2),
    ("capitals", lambda f: f["n"] >= 10 and f["capitals"] > 0.6),
    ("empty", lambda f: f["n"] == 0),
)
GOOD = (
    ("prose", lambda f: f["n"] > 0 and f["symbols"] < 0.004 and f["repeats"] < 0.02 and (f["n"] < 30 or 0 < f["ends"] < 0.4)),
    ("words", lambda f: f["n"] > 0 and f["symbols"] < 0.01 and f["bare"] < 0.01 and (f["n"] < 20 or 0.15 < f["short"] < 0.75)),
    ("flow", lambda f: f["n"] > 0 and f["bare"] < 0.01 and f["repeats"] < 0.02 and (f["n"] < 20 or f["distinct"] > 3 / math.sqrt(f["n"]))),
)
LABELLERS = tuple((name, lambda f, rule=rule: 0 if rule(f) else 1) for name, rule in BAD) + tuple(
    (name, lambda f, rule=rule: 2 if rule(f) else 1) for name, rule in GOOD)


def facts(text: bytes) -> tuple[list[bytes], dict]:
    words = text.split()
    n = len(words)
    k = max(1, n)
    return words, {
        "n": n, "symbols": len(_SYMBOLS.findall(text)) / max(1, len(text)), "distinct": len(set(words)) / k,
        "repeats": sum(map(bytes.__eq__, words, words[1:])) / k, "short": sum(len(w) <= 3 for w in words) / k,
        "bare": sum(len(w) == 1 and not w.isalnum() for w in words) / k,
        "ends": sum(map(bytes.endswith, words, [(b".", b"!", b"?")] * n)) / k,
        "digits": sum(map(bytes.isdigit, words)) / k, "capitals": sum(65 <= w[0] <= 90 for w in words) / k}


def votes(f: dict) -> int:
    """All votes in one number, three values a labeller."""
    out = 0
    for _, rule in LABELLERS:
        out = out * 3 + rule(f)
    return out


def votes_text(pattern: int) -> str:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append("-0+"[v])
    return "".join(reversed(out))


def expectation_maximisation(counts: dict[int, int], steps: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of good documents, [labeller, class, vote] probabilities, posterior of each pattern)."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[p // 3 ** (len(LABELLERS) - 1 - j) % 3 for j in range(len(LABELLERS))] for p in patterns]).reshape(-1, len(LABELLERS))
    one_hot = (v[:, :, None] == np.arange(3)).astype(float)
    # the first guess: the share of votes cast that say good
    post = (0.5 + (v == 2).sum(1)) / (1 + (v != 1).sum(1))
    share, table = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(steps):
        both = np.stack([n * (1 - post), n * post])
        share = (both[1].sum() + 1) / (n.sum() + 2)
        table = np.einsum("cp,pjv->jcv", both, one_hot) + 0.1
        table /= table.sum(2, keepdims=True)
        log = np.einsum("pjv,jcv->pc", one_hot, np.log(table)) + np.log([1 - share, share])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return share, table, dict(zip(patterns, post.tolist()))


def _bucket(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


def buckets(word: bytes) -> tuple[int, int]:
    """Hashed features of a word: itself and its shape (runs of letters, digits and marks)."""
    return _bucket(word), _bucket(b"\0" + _RUNS.sub(rb"\1", word.translate(_SHAPE)))


_REPEAT = _bucket(b"\1repeat")


class WordWeights(dict):
    """A word's weight, kept for words seen before."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        a, b = buckets(word)
        w = float(self.weights[a] + self.weights[b])
        if len(self) < 300_000:
            self[word] = w
        return w


def score(words: list[bytes], f: dict, weights: np.ndarray, of_word: WordWeights) -> float:
    """Probability of good: the mean weight of the words, the repeats' weight and the bias (last)."""
    z = float(weights[-1])
    if words:
        z += sum(map(of_word.__getitem__, words)) / len(words) + float(weights[_REPEAT]) * f["repeats"]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 150, l2: float = 1e-6) -> np.ndarray:
    """Logistic weights for soft targets by Adam; rows: (buckets, values) of each document."""
    w = np.zeros(BUCKETS + 1)
    if not len(rows):
        return w
    sizes = np.array([len(b) for b, _ in rows])
    ids = np.concatenate([b for b, _ in rows]).astype(np.int64)
    values = np.concatenate([v for _, v in rows]).astype(float)
    owner = np.repeat(np.arange(len(rows)), sizes)
    good = np.clip(target, 1e-6, 1 - 1e-6)
    weight = good * (0.5 / good.sum()) + (1 - good) * (0.5 / (1 - good).sum())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[ids] * values, len(rows)) + w[-1]
        r = (1 / (1 + np.exp(-z)) - target) * weight
        g = np.bincount(ids, values * r[owner], len(w)) + l2 * w
        g[-1] = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
    return w


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def weak_model(docs: DataFrame, text_col: str = "text") -> tuple[float, np.ndarray, dict[int, float]]:
    """The labellers' votes on all documents, and what EM makes of them."""

    def run(batches):
        found = Counter()
        for b in batches:
            found.update(votes(facts(t or b"")[1]) for t in common.utf8_lists(b, "text"))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["pattern", "n"])

    got = common.map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "pattern int, n bigint")
    return expectation_maximisation({r["pattern"]: r["n"] for r in got.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def train(docs: DataFrame, posterior: dict[int, float], id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> np.ndarray:
    """The hashed scorer, fitted to the posteriors of at most ``max_docs`` documents; of rows of one id one is taken."""
    picked = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_docs)

    def run(batches):
        for b in batches:
            out = []
            for t in common.utf8_lists(b, "text"):
                words, f = facts(t or b"")
                found = Counter(k for w, n in Counter(words).items() for k in buckets(w) for _ in range(n))
                ids = np.fromiter(found.keys(), np.int32, len(found))
                values = np.fromiter(found.values(), np.float32, len(found)) / max(1, len(words))
                if f["repeats"]:
                    ids, values = np.append(ids, np.int32(_REPEAT)), np.append(values, np.float32(f["repeats"]))
                out.append((votes(f), ids.tobytes(), values.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x[i] for x in out], k) for i, k in
                                             enumerate((pa.int32(), pa.binary(), pa.binary())))], ["id", "pattern", "ids", "vals"])

    rows = common.one_text_each(_texts(docs, id_col, text_col).join(F.broadcast(picked), "id"))  # at most max_docs ids and as many rows
    got = common.map_arrow(rows, run, "id bigint, pattern int, ids binary, vals binary").toArrow().sort_by("id")
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["ids"].to_pylist(), got["vals"].to_pylist())]
    return fit(pairs, np.array([posterior[p] for p in got["pattern"].to_pylist()], float))


def score_documents(docs: DataFrame, posterior: dict[int, float], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, votes, weak_label, score, predicted) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast((posterior, weights.astype(np.float32)))

    def run(batches):
        posterior, weights = sent.value
        of_word = WordWeights(weights)
        for b in batches:
            out = []
            for t in common.utf8_lists(b, "text"):
                words, f = facts(t or b"")
                p, s = votes(f), score(words, f, weights, of_word)
                out.append((f["n"], votes_text(p), posterior.get(p, 0.5), s, int(s >= 0.5)))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))],
                                             ["id", "n_words", "votes", "weak_label", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = common.map_arrow(_texts(docs, id_col, text_col), run,
                           f"id {kind}, n_words bigint, votes string, weak_label double, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: labellers over all documents, EM, the scorer, then every document's score."""
    docs = common.table(spark, sf_dir, "documents")
    _, _, posterior = weak_model(docs)
    return score_documents(docs, posterior, train(docs, posterior))
