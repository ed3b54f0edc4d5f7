"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision has a context tree: its nodes are the last
0, 1, ... ``DEPTH`` bytes before, a node counts the zeros and ones that followed, and its block
probability is the even mixture of the Krichevsky-Trofimov estimate of its own counts and the
product of its children's block probabilities:

    Pw(s) = 1/2 Pe(s) + 1/2 * Pe(rest of s) * product of Pw(cs) over the kept children cs

Contexts of at least ``minimum`` bytes (two) are kept apart, however large the corpus is; what follows the others
in a parent counts as the parent's "rest". Subtrees are dealt out by their root's context to buckets whose number
follows the training bytes; a root has ``ROOT`` bytes, or one more than a frequent context: those that hold over a share ``HOT`` of
all bytes (by a sample, which changes the layout only) belong to the top, so that no bucket gets all that stands behind
one frequent context. A bucket's task builds its subtrees and hands up the sums of their roots, and one task builds the top, which has
the contexts of fewer than ``ROOT`` bytes and at most 1 / HOT frequent ones of each length.

To score, texts are cut in pieces; the different codes of a piece go to their buckets, whose tasks load the bucket's
subtrees and send back the values alone, in the order in which they were asked; a file a piece holds them for the
pass that adds them up. A piece's codes are made in runs of ``_RUN`` there, never whole, and a task gives free memory back after each
piece and bucket. Every bucket has a file, so one that is lost is an error. Pieces and buckets grow with the root of the input beyond
``LARGE``, so that the rows between them grow no faster than the input.

Prediction mixes along the path with the posterior weights of the trained tree: with
w = 1/2 Pe(s) / Pw(s), a decision has the probability w * KT(s) + (1 - w) * (that of the child on the path, or
of the rest where the child isn't kept; an empty rest predicts as the node itself does).

The score of a text is the log10 probability of its bytes, A-Z lower-cased, and one end byte (0);
code length per byte is ``-score * log2(10) / bytes``. The base score is that of an add-one
unigram model over words. Words in at least a share ``LEAST_WORD`` of all tokens are looked up in the
tasks (at most 1 / LEAST_WORD words), all others are joined with the table of counts.

Defined cases: null text counts as empty and is scored as one end. Repeated rows are scored one by one;
a null id counts as the empty text for the split. Without training rows every byte costs eight bits. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .packed import pack, read_whole, runs, spread, squeeze, unpack

DEPTH = 6
#: Least bytes of a context by which subtrees are dealt out; the top has the shorter contexts.
ROOT = 3
#: Share of all bytes from which on a longer context belongs to the top, and bytes of text by which these are found.
HOT, _SAMPLE = 1 / 16384, 20_000_000
LEAST_WORD = 2.5e-7
#: Training bytes of a bucket of subtrees, and bytes of text that are scored as one piece, up to LARGE bytes of text.
_BUCKET, _PIECE, LARGE = 2_000_000, 10_000_000, 10_000_000_000
#: Words that are counted, and codes that are looked up, at once.
_WORDS, _RUN = 600_000, 1_000_000


# ---- grams -----------------------------------------------------------------------------

def gram_codes(texts: list, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(code of every byte with its context, where each text's codes begin); a text ends with byte 0."""
    return _codes([(b"\0" * depth, (t or b"").lower() + b"\0") for t in texts], depth)


def _codes(parts: list[tuple[bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for parts of texts, each given as (the ``depth`` bytes before it, its own)."""
    buf = np.frombuffer(b"".join([x for p in parts for x in p]), np.uint8)
    sizes = np.array([len(t) for _, t in parts], np.int64)
    code = np.zeros(len(buf) - depth, np.uint64) if len(buf) else np.zeros(0, np.uint64)
    # byte k of a number is the k-th byte before
    each = code.view(np.uint8).reshape(len(code), 8)
    for k in range(depth + 1):
        each[:, k] = buf[depth - k:len(buf) - k]
    starts = np.cumsum(sizes) - sizes
    # codes that end in the padding between two texts go: each text's move up in place, as a copy would hold all codes twice
    for i, (to, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        if i:
            code[to:to + n] = code[to + i * depth:to + i * depth + n]
    return code[:int(sizes.sum())], starts


def _cut(parts, depth: int, size: int):
    """Runs of some ``size`` bytes of parts, each given as (place, bytes before, own bytes): a longer one goes on in the next run."""
    out, room = [], size
    for place, before, own in parts:
        while len(own) > room:
            if room:
                out.append((place, before, own[:room]))
                before, own = (before + own[:room])[-depth:] if depth else b"", own[room:]
            yield out
            out, room = [], size
        out.append((place, before, own))
        room -= len(own)
    if out:
        yield out


def _pieces(batches, depth: int, size: int):
    """(rows, [(row, bytes before, own bytes)]) of runs of some ``size`` bytes: a longer text goes on in the next piece.
    ``rows`` counts those that begin in the piece."""
    texts, begun = (t for b in batches for t in common.utf8_lists(b, "text")), 0
    for parts in _cut(((row, b"\0" * depth, (t or b"").lower() + b"\0") for row, t in enumerate(texts)), depth, size):
        yield parts[-1][0] + 1 - begun, parts
        begun = parts[-1][0] + 1
        common.give_back()


def _distinct(parts, depth: int) -> np.ndarray:
    """The different codes of a piece in order. They are gathered in runs: its codes, eight bytes a byte of text, are never held whole."""
    own, more = np.zeros(0, np.uint64), []
    for some in _cut(parts, depth, _RUN):
        codes = _codes([p[1:] for p in some], depth)[0]
        codes.sort()
        more.append(_different(codes))
        if sum(map(len, more)) > max(4 * _RUN, len(own)):
            own, more = _merged([own, *more]), []
    return _merged([own, *more])


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    codes = np.concatenate(parts)
    codes.sort()
    return _different(codes)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different codes in order, how often each is there). The given codes are sorted in place."""
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
    return codes[first], np.diff(np.append(first, len(codes)))


def _sum(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, each once, with the sums of their counts."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _different(codes: np.ndarray) -> np.ndarray:
    """Sorted codes, each once."""
    return codes[np.append(True, codes[1:] != codes[:-1])[:len(codes)]]


class Layout:
    """Where subtrees lie: ``hot[k]`` has the contexts of ROOT + k bytes that belong to the top; ``total`` counts the training bytes."""

    def __init__(self, depth: int, buckets: int, hot: list[np.ndarray], total: int = 0):
        self.depth, self.buckets, self.hot, self.total = depth, buckets, hot, total
        self.first = np.zeros(1 << 8 * ROOT, bool)
        self.first[hot[0].astype(np.int64)] = True

    def __getstate__(self):
        return self.depth, self.buckets, self.hot, self.total

    def __setstate__(self, state):
        self.__init__(*state)

    def roots(self, codes: np.ndarray) -> np.ndarray:
        """Bytes of the context at which each code's subtree begins."""
        context = codes >> np.uint64(8)
        out = np.full(len(codes), ROOT, np.uint8)
        left = np.flatnonzero(self.first[(context & np.uint64((1 << 8 * ROOT) - 1)).view(np.int64)])
        for k in range(1, self.depth - ROOT + 1):
            out[left] = ROOT + k
            if k == len(self.hot) or not len(left):
                break
            left = left[Ordered(self.hot[k]).find(context[left] & np.uint64((1 << 8 * (ROOT + k)) - 1))[0]]
        return out

    def dealt(self, codes: np.ndarray):
        """(bucket, the places of its codes) for each bucket that has any."""
        size = self.roots(codes).astype(np.uint64)
        root = codes >> np.uint64(8) & ((np.uint64(1) << np.uint64(8) * size) - np.uint64(1))
        bucket = ((root + size) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(self.buckets)
        # 16-bit numbers are sorted in one step
        bucket = bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket.view(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])[:len(order)])
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
            yield int(bucket[order[lo]]), order[lo:hi]


# ---- the tree --------------------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma by Stirling's series, moved up by eight."""
    x = np.asarray(x, float)
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(low)


def _kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


_SMALL = _kt_log(*np.meshgrid(np.arange(64.0), np.arange(64.0), indexing="ij"))


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    out = _SMALL[np.minimum(a, 63).astype(np.int64), np.minimum(b, 63).astype(np.int64)]
    large = np.flatnonzero((a > 63) | (b > 63))
    out[large] = _kt_log(a[large], b[large])
    return out


class Ordered:
    """Sorted numbers to be found."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    @property
    def used(self) -> np.ndarray:
        return np.ones(len(self.keys), bool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, place)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


class Places:
    """Where numbers are among sorted different ones that have them all: by a table of hashes, two more for those that fell
    together in the one before, and a search for what is left."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys), dtype=np.int32)
        for k in range(3):
            self.tables.append(np.zeros(1 << max(1, (2 * len(left)).bit_length()), np.int32))
            slots = self._slots(keys[left], k)
            self.tables[k][slots] = left
            left = left[self.tables[k][slots] != left]

    def _slots(self, keys: np.ndarray, k: int) -> np.ndarray:
        bits, factor = len(self.tables[k]).bit_length() - 1, (0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1)
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(factor) >> np.uint64(64 - bits)).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = self.tables[0][self._slots(keys, 0)]
        left = np.flatnonzero(self.keys[out] != keys)
        for k in range(1, len(self.tables)):
            out[left] = self.tables[k][self._slots(keys[left], k)]
            left = left[self.keys[out[left]] != keys[left]]
        out[left] = np.searchsorted(self.keys, keys[left])
        return out


def _level(codes: np.ndarray, counts: np.ndarray) -> list:
    """(keys, zeros, ones, each code's node) of the nodes before each of the eight decisions; keys are context << 8 | prefix.
    Codes are sorted, so the keys of a decision are too."""
    out, n = [], counts.astype(float)
    for j in range(8):
        keys = Tree._prefix(codes, j)
        new = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
        first = np.flatnonzero(new)
        bit = (codes >> np.uint64(7 - j) & np.uint64(1)).astype(float)
        every, ones = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (n, n * bit))
        out.append((keys[first], every - ones, ones, np.cumsum(new) - 1))
    return out


class Tree:
    """Depths low, low + 1, ... of the trained tree: all of it, the top, or subtrees of a bucket.

    grams: for each depth the sorted (codes, counts) of context + byte, of the kept contexts only.
    below: for a depth and each decision (keys, zeros, ones, log Pw) of its nodes, added up over the kept children
    in other parts. ``finish`` makes it ready for prediction.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], low: int = 0, below: dict[int, list] | None = None):
        self.low, self.depth, below = low, low + len(grams) - 1, below or {}
        self.codes = [np.zeros(0, np.uint64)] * low + [c.astype(np.uint64) for c, _ in grams]
        self.levels = [None] * low + [_level(c.astype(np.uint64), n) for c, n in grams]
        # upwards: block probabilities, and what isn't in a kept child
        self.log_w, self.rest, self.weight = ([[None] * 8 for _ in self.levels] for _ in range(3))
        for d in range(self.depth, low - 1, -1):
            for j, (keys, a, b, _) in enumerate(self.levels[d]):
                own = kt_log(a, b)
                if d == self.depth and d not in below:
                    self.log_w[d][j], self.weight[d][j], self.rest[d][j] = own, np.ones(len(keys)), (np.zeros(len(keys)), np.zeros(len(keys)))
                    continue
                ra, rb, inner = a.copy(), b.copy(), np.zeros(len(keys))
                parts = [below[d][j]] if d in below else []
                if d < self.depth:
                    child, ca, cb, _ = self.levels[d + 1][j]
                    parts.append((self._shorter(child, d), ca, cb, self.log_w[d + 1][j]))
                for child, ca, cb, cw in parts:
                    up = np.searchsorted(keys, child)
                    ra -= np.bincount(up, ca, len(keys))
                    rb -= np.bincount(up, cb, len(keys))
                    inner += np.bincount(up, cw, len(keys))
                inner += kt_log(ra, rb)
                self.log_w[d][j] = np.logaddexp(own, inner) - math.log(2)
                self.weight[d][j] = np.exp(own - math.log(2) - self.log_w[d][j])
                self.rest[d][j] = (ra, rb)

    def for_parents(self):
        """(keys, zeros, ones, log Pw) of the nodes above, added up over this part's first depth."""
        for (keys, a, b, _), w in zip(self.levels[self.low], self.log_w[self.low]):
            own, at = np.unique(self._shorter(keys, self.low - 1), return_inverse=True)
            yield own, *(np.bincount(at, x, len(own)) for x in (a, b, w))

    def finish(self, above: Tree | None = None) -> Tree:
        """Downwards: probability of a one where the path ends at a node, as an affine map of its own."""
        self.sure = [] if above is None else above.sure[:self.low]
        self.nodes, self.contexts, self.values = [], [], []
        for d in range(self.low, self.depth + 1):
            nodes, passed, value = [], [], np.zeros(len(self.codes[d]))
            for j, ((keys, a, b, of), one) in enumerate(zip(self.levels[d], self._ones(self.codes[d]))):
                w, (ra, rb) = self.weight[d][j], self.rest[d][j]
                kt = (b + 0.5) / (a + b + 1)
                end = np.where(ra + rb > 0, (rb + 0.5) / (ra + rb + 1), kt)
                if d == 0:
                    add, times = np.zeros(len(keys)), np.ones(len(keys))
                else:
                    up = np.searchsorted(self.sure[d - 1][j][0], self._shorter(keys, d - 1))
                    add, times = self.sure[d - 1][j][1][up], self.sure[d - 1][j][2][up]
                ends = add + times * (w * kt + (1 - w) * end)
                passed.append((keys, add + times * w * kt, times * (1 - w)))
                nodes.append((Ordered(keys), ends))
                value += np.log10(np.where(one, ends[of], 1 - ends[of]))
            self.sure.append(passed)
            self.nodes.append(nodes)
            self.values.append(value.astype(np.float32))
            self.contexts.append(Ordered(_different(self.codes[d] >> np.uint64(8))))
        self.levels, self.log_w, self.rest, self.weight = None, None, None, None
        self.grams = [Ordered(c) for c in self.codes[self.low:]]
        if above is not None:
            for name in ("nodes", "contexts", "values", "grams"):
                setattr(self, name, getattr(above, name)[:self.low] + getattr(self, name))
        return self

    @staticmethod
    def _shorter(keys: np.ndarray, d: int) -> np.ndarray:
        """Node keys with the context cut to d bytes."""
        return keys & np.uint64((1 << 8 * (d + 1)) - 1)

    @staticmethod
    def _ones(codes: np.ndarray):
        return ((codes >> np.uint64(7 - j) & np.uint64(1)).astype(bool) for j in range(8))

    @staticmethod
    def _prefix(codes: np.ndarray, j: int) -> np.ndarray:
        return (codes & ~np.uint64(255)) | np.uint64(1 << j) | ((codes & np.uint64(255)) >> np.uint64(8 - j))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code given the bytes before it."""
        out = np.zeros(len(codes), np.float32)
        left, now = np.arange(len(codes)), codes
        for d in range(self.depth, -1, -1):
            now = self._shorter(now, d)
            hit, at = self.grams[d].find(now)
            out[left[hit]] = self.values[d][at[hit]]
            left, now = left[~hit], now[~hit]
            if not len(left):
                return out
            # the context is kept, but the byte never followed it: decision by decision
            kept = self.contexts[d].find(now >> np.uint64(8))[0] if d else np.ones(len(now), bool)
            if kept.any():
                new, at = np.unique(now[kept], return_inverse=True)
                out[left[kept]] = self._unseen(d, new)[at]
                left, now = left[~kept], now[~kept]
        return out

    def _unseen(self, depth: int, codes: np.ndarray) -> np.ndarray:
        """Each decision at the deepest node that has seen its prefix; an even chance where none has."""
        out = np.zeros(len(codes))
        for j, one in enumerate(self._ones(codes)):
            p, left, key = np.full(len(codes), 0.5), np.arange(len(codes)), self._prefix(codes, j)
            for d in range(depth, -1, -1):
                place, ends = self.nodes[d][j]
                hit, at = place.find(self._shorter(key[left], d))
                p[left[hit]] = ends[at[hit]]
                left = left[~hit]
            out += np.log10(np.where(one, p, 1 - p))
        return out.astype(np.float32)


def _kept(codes: np.ndarray, counts: np.ndarray, high: int, low: int, enough: float) -> list:
    """(codes, counts) of the depths low to high, of the contexts with enough bytes. A kept context's shorter
    contexts are kept too: their counts are no smaller."""
    out = []
    for d in range(high, low - 1, -1):
        if d < high:
            codes, counts = _sum(codes & np.uint64((1 << 8 * (d + 1)) - 1), counts)
        keep = np.ones(len(codes), bool)
        if d and len(codes):
            own, at = np.unique(codes >> np.uint64(8), return_inverse=True)
            keep = (np.bincount(at, counts, len(own)) >= enough)[at]
        out.append((codes[keep], counts[keep]))
    return out[::-1]


def _frequent(rows: DataFrame, depth: int, total: int) -> list[np.ndarray]:
    """The contexts of ROOT, ROOT + 1, ... bytes, shorter than the depth, that hold over a share HOT of the bytes of a sample of texts."""
    lengths = list(range(ROOT, depth))
    some = rows.sample(min(1.0, _SAMPLE / max(1, total)), seed=1)

    def count(batches):
        for _, parts in _pieces(batches, depth, _SAMPLE):
            codes = _codes([p[1:] for p in parts], depth)[0] >> np.uint64(8)
            for k in lengths:
                # what is frequent overall is so in some piece; all others stay here
                got, n = _counted(codes & np.uint64((1 << 8 * k) - 1))
                own = n >= HOT * len(codes) / 8
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(own.sum()), k, np.int32)), pa.array(got[own].view(np.int64)), pa.array(n[own])], ["k", "context", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([len(codes)], pa.int64())], ["k", "context", "n"])

    found = common.map_arrow(some, count, "k int, context bigint, n bigint").groupBy("k", "context").agg(F.sum("n").alias("n"))
    # every context of one length holds a share HOT, so at most 1 / HOT of them come here
    whole = F.max(F.when(F.col("k") == 0, F.col("n"))).over(Window.partitionBy())
    limit = F.greatest(F.lit(HOT), F.lit(_BUCKET / max(1, total))) * whole
    hot = found.withColumn("least", limit).where("k > 0 and n > least").select("k", "context").toArrow()
    k, context = hot["k"].to_numpy(), hot["context"].to_numpy().view(np.uint64)
    out = [np.sort(context[k == n]) for n in lengths]
    # a context is in the top only if the shorter ones are
    for i in range(1, len(out)):
        shorter = out[i] & np.uint64((1 << 8 * lengths[i - 1]) - 1)
        out[i] = out[i][Ordered(out[i - 1]).find(shorter)[0]]
    return out


def train(spark: SparkSession, docs: DataFrame, text_col: str = "text", depth: int = DEPTH, least: float = 0.0, minimum: int = 2) -> str:
    """The tree of all rows of ``docs``: the shared folder it is written to, a file a bucket of subtrees, the top and the layout.
    minimum: bytes that a context needs to be kept; least: a share of all bytes that it needs besides."""
    from urlscope.session import scratch_path  # here, as task functions take this module along by value

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    grown = max(1.0, (total / LARGE) ** 0.5)
    buckets, enough, high = max(1, -(-total // int(_BUCKET * grown))), max(minimum, least * total), min(ROOT - 1, depth)
    layout = Layout(depth, buckets, _frequent(rows, depth, total) if depth > ROOT else [np.zeros(0, np.uint64)], total)
    folder, piece_size = scratch_path(spark, "tree"), int(_PIECE * grown)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(layout))

    def count(batches):
        layout = cloudpickle.loads(sent.value)
        for _, parts in _pieces(batches, depth, piece_size):
            codes, counts = _counted(_codes([p[1:] for p in parts], depth)[0])
            dealt = [(bucket, len(at), pack(codes[at]), squeeze(counts[at])) for bucket, at in layout.dealt(codes)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in dealt], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "n", "codes", "counts"])

    def grow(batches):
        layout = cloudpickle.loads(sent.value)
        for bucket, held in runs(batches, "bucket"):
            codes, counts = _sum(np.concatenate([unpack(r["codes"], r["n"]) for r in held if r["n"]] or [np.zeros(0, np.uint64)]),
                                 np.concatenate([spread(r["counts"], np.int64, r["n"]) for r in held if r["n"]] or [np.zeros(0, np.int64)]))
            root, parts = layout.roots(codes), {}
            if depth >= ROOT:
                for low in np.unique(root).tolist():
                    levels = _kept(codes[root == low], counts[root == low], depth, low, enough)
                    parts[low] = [(len(c), pack(c), squeeze(n)) for c, n in levels]
                    for key, *sums in Tree(levels, low).for_parents():
                        yield part(low, key, *sums)
                    # what stands behind a frequent context is counted there, too
                    if low > ROOT:
                        for d in range(ROOT, low):
                            key, n = _sum(codes[root == low] & np.uint64((1 << 8 * (d + 1)) - 1), counts[root == low])
                            yield part(-d, key, n.astype(float), np.zeros(len(key)), np.zeros(len(key)))
            # every bucket has a file, empty or not
            common.write_whole(folder, f"bucket-{bucket}", cloudpickle.dumps(parts))
            codes, counts = _sum(codes & np.uint64((1 << 8 * (high + 1)) - 1), counts)
            yield part(0, codes, counts.astype(float), np.zeros(len(codes)), np.zeros(len(codes)))
            common.give_back()

    def part(kind, key, a, b, w):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), *(pa.array(x.astype(float)) for x in (a, b, w))],
                                          ["kind", "key", "a", "b", "w"])

    def top(batches):
        parts = [[b.column(k).to_numpy() for k in range(5)] for b in batches]
        kind, key, a, b, w = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
        key, order = key.view(np.uint64), np.argsort(key.view(np.uint64), kind="stable")
        kind, key, a, b, w = (x[order] for x in (kind, key, a, b, w))
        levels = _kept(key[kind == 0], a[kind == 0].astype(np.int64), high, 0, enough)
        below = {}
        if depth >= ROOT:
            levels += [(key[kind == -d], a[kind == -d].astype(np.int64)) for d in range(ROOT, depth)]
            for low in range(ROOT, depth + 1):
                own = [(kind == low) & (key & np.uint64(255) >= np.uint64(1 << j)) & (key & np.uint64(255) < np.uint64(2 << j)) for j in range(8)]
                below[low - 1] = [tuple(x[at] for x in (key, a, b, w)) for at in own]
        common.write_whole(folder, "top", cloudpickle.dumps((levels, Tree(levels, 0, below).finish())))
        common.write_whole(folder, "layout", sent.value)
        yield pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int64())], ["rows"])

    grams = common.map_arrow(rows, count, "bucket int, n int, codes binary, counts binary")
    empty = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("counts"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with common.batches_of(spark, 64):
        sums = grams.unionByName(empty).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(grow, "kind int, key bigint, a double, b double, w double")
        sums = common.stored(spark, sums, "sums")
    # contexts of fewer than ROOT bytes and the frequent ones only, whatever the input; a row of no kind, so that the task
    # runs without training rows too
    sums = sums.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in "abw"])
    none = spark.range(1).select(F.lit(99).alias("kind"), F.lit(0).cast("long").alias("key"), *[F.lit(0.0).alias(c) for c in "abw"])
    with common.batches_of(spark, 100_000):
        sums.unionByName(none).repartition(1).mapInArrow(top, "rows bigint").collect()
    return folder


def _levels(folder: str, bucket: int) -> dict[int, list]:
    """A bucket's subtrees by the bytes of their roots; an error if its file is lost."""
    return {low: [(unpack(c, n), spread(k, np.int64, n)) for n, c, k in levels] for low, levels in cloudpickle.loads(read_whole(folder, f"bucket-{bucket}")).items()}


def _layout(folder: str) -> Layout:
    return cloudpickle.loads(read_whole(folder, "layout"))


def load(folder: str) -> Tree:
    """The whole tree, for small ones."""
    layout = _layout(folder)
    levels = list(cloudpickle.loads(read_whole(folder, "top"))[0])
    levels += [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * (layout.depth + 1 - len(levels))
    for b in range(layout.buckets):
        for low, own in _levels(folder, b).items():
            for d, (codes, counts) in enumerate(own, low):
                levels[d] = tuple(np.concatenate(x) for x in zip(levels[d], (codes, counts)))
    return Tree([_sum(*x) for x in levels]).finish()


# ---- words -----------------------------------------------------------------------------

def _word_counts(batches):
    found = Counter()
    for b in batches:
        for t in common.utf8_lists(b, "text"):
            found.update((t or b"").lower().split())
            found[b""] += 1  # the end
        if len(found) > _WORDS:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "c"])
            found = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "c"])


def word_counts(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all rows, the end as the empty word."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = common.map_arrow(rows, _word_counts, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    return common.stored(spark, counts.where("c > 0"), "words")


# ---- scores ----------------------------------------------------------------------------

def score_documents(spark: SparkSession, docs: DataFrame, tree: str, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", reread: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_tokens, n_known, train_tokens, base_score, score) for every row.

    reread: ``docs`` comes from files in the same parts each time it is read; else it is stored first, as it is read twice. A piece
    is known by its content, so one that differs the second time is an error.
    """
    from urlscope.session import scratch_path  # here, as task functions take this module along by value

    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = words.where(F.col("c") >= LEAST_WORD * total).toArrow()
    sent = spark.sparkContext.broadcast((hot["word"].to_pylist(), np.log10(hot["c"].to_numpy() + 1.0)))
    folder, answers = tree, scratch_path(spark, "answers")
    depth, size, kind = _layout(folder).depth, _layout(folder).total, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not reread:
        rows = common.stored(spark, rows, "texts")
    piece_size = int(_PIECE * max(1.0, (size / LARGE) ** 0.5))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def name(parts) -> str:
        out = xxhash.xxh128()
        for _, before, own in parts:
            out.update(before)
            out.update(own)
        return out.hexdigest()

    def ask(batches):
        layout = _layout(folder)
        for _, parts in _pieces(batches, depth, piece_size):
            codes, piece = _distinct(parts, depth), name(parts)
            dealt = [(piece, b, len(at), pack(codes[at])) for b, at in layout.dealt(codes)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in dealt], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["piece", "bucket", "n", "codes"])

    def answer(batches):
        layout, top, now, trees = _layout(folder), cloudpickle.loads(read_whole(folder, "top"))[1], None, {}
        for b in batches:
            out, sizes, bucket = [], b.column("n").to_numpy(), b.column("bucket").to_numpy()
            asked = b.column("codes").to_pylist()
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
            for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist()):
                if bucket[lo] != now:
                    now, trees = int(bucket[lo]), {}  # the last one's memory is free before the next is built
                    common.give_back()
                    trees = {low: Tree(levels, low).finish(top) for low, levels in _levels(folder, now).items()}
                # what several pieces ask of a bucket is looked up together
                codes = np.concatenate([unpack(x, n) for x, n in zip(asked[lo:hi], sizes[lo:hi].tolist())])
                root, values = layout.roots(codes), np.zeros(len(codes), np.float32)
                for low in np.unique(root).tolist():
                    own = np.flatnonzero(root == low)
                    # a subtree that was never seen is left to the contexts above it
                    values[own] = (trees[low] if low in trees else top).log10(codes[own])
                out += map(squeeze, np.split(values, np.cumsum(sizes[lo:hi])[:-1]))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(out, pa.binary())], ["piece", "bucket", "n", "values"])

    def keep(batches):
        for piece, held in runs(batches, "piece"):
            # equal pieces ask alike
            held = {r["bucket"]: r for r in held}
            values = np.concatenate([spread(r["values"], np.float32, r["n"]) for _, r in sorted(held.items())])
            common.write_whole(answers, piece, len(values).to_bytes(8, "little") + squeeze(values))
            yield pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int64())], ["codes"])

    def add_up(parts, layout: Layout) -> np.ndarray:
        """The sum of the values of each part's codes."""
        own, known = _distinct(parts, depth), read_whole(answers, name(parts))
        told = spread(known[8:], np.float32, int.from_bytes(known[:8], "little"))
        if len(told) != len(own):
            raise ValueError("a piece was answered in part")
        values, sums = np.empty(len(own), np.float32), np.zeros(len(parts))
        values[np.concatenate([at for _, at in layout.dealt(own)])] = told
        places = Places(own)
        for some in _cut(((i, *p[1:]) for i, p in enumerate(parts)), depth, _RUN):
            codes, starts = _codes([p[1:] for p in some], depth)
            sums[[p[0] for p in some]] += np.add.reduceat(values[places.of(codes)].astype(float), starts)
        return sums

    def run(batches):
        from pyspark import TaskContext
        # the value of a word's count, so that a token costs one lookup
        value, row = dict(zip(sent.value[0], sent.value[1].tolist())), TaskContext.get().partitionId() << 40
        layout, held = _layout(folder), []

        def seen():
            for b in batches:
                held.append(b)
                yield b

        scores, done = {}, 0
        for _, parts in _pieces(seen(), depth, piece_size):
            for (i, _, _), x in zip(parts, add_up(parts, layout).tolist()):
                scores[i] = scores.get(i, 0.0) + x
            # the last row may go on
            while held and done + held[0].num_rows <= parts[-1][0]:
                b = held.pop(0)
                yield told(b, row + done, [scores.pop(done + k) for k in range(b.num_rows)], value)
                done += b.num_rows
        for b in held:
            yield told(b, row + done, [scores.pop(done + k) for k in range(b.num_rows)], value)
            done += b.num_rows

    def told(b, row, scores, value):
        out = []
        for t in common.utf8_lists(b, "text"):
            own = (t or b"").lower().split()
            own.append(b"")
            got, rare = list(map(value.get, own)), {}
            if None in got:
                rare = Counter(w for w, x in zip(own, got) if x is None)
                got = [x for x in got if x is not None]
            out.append((len(t or b""), len(own), len(got), math.fsum(got), list(rare.keys()), list(rare.values())))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column("id"), pa.array(scores, pa.float64()), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))],
                                          ["row", "id", "score", "n_bytes", "n_tokens", "n_known", "logs", "rare", "times"])

    # a piece's different codes go to the buckets of the tree, the values back to a file a piece
    asking = common.map_arrow(rows, ask, "piece string, bucket int, n int, codes binary")
    with common.batches_of(spark, 64):
        values = asking.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "piece string, bucket int, n int, values binary")
        values.repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(keep, "codes bigint").agg(F.sum("codes")).first()
    parts = common.stored(spark, common.map_arrow(
        rows, run, f"row bigint, id {kind}, score double, n_bytes bigint, n_tokens bigint, n_known bigint, logs double, "
                   "rare array<binary>, times array<int>"), "scored")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = (rare.join(words, "word").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"), F.sum("times").alias("more_known")))
    floor = math.log10(total + distinct + 1)
    return parts.drop("rare", "times").join(rare, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: learn from six sevenths of the documents, score all."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_column("doc_id", 7) == 2
    known = docs.where(~held_out)
    out = score_documents(spark, docs, train(spark, known), word_counts(spark, known), reread=True)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                      (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
