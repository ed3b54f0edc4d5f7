"""Multiclass gradient boosting (L3): one ensemble with softmax gradients, grown level by level.

Every round fits one regression tree for each class to the residuals ``y - p``, all classes together: for each level, tasks
add up (class, node, feature, bin) histograms of their rows, Spark sums them by ``groupBy``, and the best cut of every node comes
from the sums. What reaches the driver is bounded by the model (classes x nodes x features x bins), whatever the
number of rows. Rows lie in blocks of binned features with their scores so far; each round writes them anew to the
shared folder, so no lineage grows and a lost executor costs no more than reading a file.

Residuals are summed as integers (2 ** -40), so the sums, and with them the trees, don't depend on partitions. A leaf is worth
(K - 1) / K * sum(r) / sum(|r| (1 - |r|)). A tenth of the rows, by hash of the key, is held out: boosting ends when the
loss there has not fallen by ``tol`` for ``patience`` rounds. Each round draws ``subsample`` of the other rows, by a hash of
the row's place and the round.

Rows of a null label are left out of the fit; null and NaN features count as 0. A table without rows can't be fitted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TRAINING_FEATURES
from ..session import scratch_path

BINS = 32
BLOCK_ROWS = 8192
_ONE = float(1 << 40)
_SUMS = "class int, node int, feature int, bin int, g bigint, h bigint, n bigint"


def _softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _drawn(rows: np.ndarray, number: int, share: float, seed: int) -> np.ndarray:
    """Which rows a round draws."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((number + 1) * 0xBF58476D1CE4E5B9 + seed & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) < share * float(1 << 53)


def _nodes(x: np.ndarray, tree: dict) -> np.ndarray:
    """The node of each row in a tree as far as it is grown: {node: (feature, bin)}, children of node i are 2 i + 1 and 2 i + 2."""
    at = np.zeros(len(x), np.int64)
    left = np.arange(len(x))
    cut_f, cut_b = _arrays(tree)
    while len(left):
        inner = left[cut_f[at[left]] >= 0]
        at[inner] = 2 * at[inner] + 1 + (x[inner, cut_f[at[inner]]] > cut_b[at[inner]])
        left = inner
    return at


def _arrays(tree: dict) -> tuple[np.ndarray, np.ndarray]:
    n = 2 * max(tree, default=0) + 3
    feature, cut = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for k, (f, b) in tree.items():
        feature[k], cut[k] = f, b
    return feature, cut


def _histograms(x, y, f, rows, valid, trees: list[dict], level: int, number: int, share: float, seed: int) -> list[np.ndarray]:
    """Sums of a block for the nodes of a level, as columns of _SUMS; level 0 also has class -1: the loss of the rows held out and their number."""
    p, k = _softmax(f), f.shape[1]
    use = ~valid & _drawn(rows, number, share, seed)
    xs, out = x[use], []
    for c in range(k):
        r = (y[use] == c) - p[use, c]
        g, h = np.rint(r * _ONE).astype(np.int64), np.rint(np.abs(r) * (1 - np.abs(r)) * _ONE).astype(np.int64)
        node = _nodes(xs, trees[c])
        at = np.flatnonzero(node >= (1 << level) - 1)
        if not len(at):
            continue
        own, local = np.unique(node[at], return_inverse=True)
        # one number for (node, feature, bin)
        key = ((local[:, None] * x.shape[1] + np.arange(x.shape[1])[None, :]) * 256 + xs[at]).ravel()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        sums = [np.add.reduceat(np.repeat(v[at], x.shape[1])[order], first) for v in (g, h)] + [np.diff(np.append(first, len(key)))]
        key = key[order][first]
        out.append([np.full(len(key), c), own[key // 256 // x.shape[1]], key // 256 % x.shape[1], key % 256, *sums])
    if level == 0 and valid.any():
        loss = -np.log(np.maximum(p[valid, y[valid]], 1e-300))
        out.append([np.array([-1]), np.array([0]), np.array([0]), np.array([0]), np.array([int(np.rint(loss * _ONE).sum())]), np.array([0]), np.array([int(valid.sum())])])
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 7


def _best_cuts(sums: list[np.ndarray], n_features: int, min_leaf: int, min_split: int) -> dict:
    """{(class, node): (gain, feature, bin, (g, h, n) on the left, the same in all)}; gain is None for a node that isn't cut."""
    kind, node, feature, bin_, g, h, n = (c.astype(np.int64) for c in sums)
    out = {}
    for c in np.unique(kind[kind >= 0]).tolist():
        at = kind == c
        own, local = np.unique(node[at], return_inverse=True)
        shape = (len(own), n_features, 256)
        place = (local * n_features + feature[at]) * 256 + bin_[at]
        table = []
        for v in (g, h, n):
            t = np.zeros(shape[0] * n_features * 256, np.int64)
            np.add.at(t, place, v[at])
            table.append(np.cumsum(t.reshape(shape), 2))
        (lg, lh, ln), (tg, th, tn) = table, [t[:, 0, -1] for t in table]
        rn, rg = tn[:, None, None] - ln, tg[:, None, None] - lg
        ok = (ln >= min_leaf) & (rn >= min_leaf) & (tn[:, None, None] >= min_split)
        gain = np.where(ok, (lg / _ONE) ** 2 / np.maximum(ln, 1) + (rg / _ONE) ** 2 / np.maximum(rn, 1), -1.0) - ((tg / _ONE) ** 2 / np.maximum(tn, 1))[:, None, None]
        flat = gain.reshape(len(own), -1)
        best = flat.argmax(1)
        for i, (k, b) in enumerate(zip(own.tolist(), best.tolist())):
            whole = (int(tg[i]), int(th[i]), int(tn[i]))
            f, cut = divmod(b, 256)
            good = ok[i, f, cut] and flat[i, b] > 1e-12
            out[c, k] = (float(flat[i, b]), f, cut, (int(lg[i, f, cut]), int(lh[i, f, cut]), int(ln[i, f, cut])), whole) if good else (None, 0, 0, (0, 0, 0), whole)
    return out


@dataclass
class Boosted:
    """The fitted ensemble. rounds: for each round and class (cuts, values) as ``_nodes`` takes them, values by node."""

    labels: list[str]
    features: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    step: float
    rounds: list[list[tuple[dict, dict]]] = field(default_factory=list)
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(self.edges)], 1).astype(np.uint8) if len(values) else np.zeros((0, len(self.edges)), np.uint8)

    def added(self, x: np.ndarray, number: int) -> np.ndarray:
        """What a round adds to the scores."""
        out = np.zeros((len(x), len(self.labels)))
        for c, (cuts, values) in enumerate(self.rounds[number]):
            worth = np.zeros(2 * max(cuts, default=0) + 3)
            for k, v in values.items():
                worth[k] = v
            out[:, c] = self.step * worth[_nodes(x, cuts)]
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        x = self.binned(values)
        f = np.tile(self.start, (len(x), 1))
        for r in range(len(self.rounds)):
            f += self.added(x, r)
        return _softmax(f)

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's share of all gains."""
        total = self.gains.sum()
        return [(f, float(g / total) if total else 0.0) for f, g in zip(self.features, self.gains)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities`` (a number for each label) and ``prediction``; Arrow batches of the features only."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        values = F.array(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in self.features])
        names = F.array(*[F.lit(x) for x in self.labels])
        return (df.withColumn("probabilities", _list_udf(sent)(values))
                .withColumn("prediction", F.element_at(names, F.array_position("probabilities", F.array_max("probabilities")).cast("int"))))


def _list_udf(sent):
    @F.pandas_udf("array<double>")
    def score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        return pd.Series([*sent.value.probabilities(np.stack(values.to_list()))])

    return score


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to bins - 1 cuts of each feature, at its quantiles (x <= edge goes left)."""
    cuts = df.select(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in features]).approxQuantile(features, [i / bins for i in range(1, bins)], 1e-4)
    return [np.unique(np.array(c, float)) for c in cuts]


def train(df: DataFrame, features: list[str] = TRAINING_FEATURES, label: str = "type", key: str = "page_id", max_iter: int = 100, max_depth: int = 8,
          step: float = 0.1, subsample: float = 0.8, min_leaf: int = 10, min_split: int = 20, patience: int = 3, tol: float = 1e-4, seed: int = 42, bins: int = BINS) -> Boosted:
    """L3: fit on all rows of ``df``."""
    spark = df.sparkSession
    rows = df.filter(F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(label).collect()}
    if not sizes:
        raise ValueError("there are no labelled rows")
    labels, k, width = sorted(sizes), len(sizes), len(features)
    counts = np.array([sizes[x] for x in labels], float)
    model = Boosted(labels, list(features), bin_edges(rows, features, bins), np.log(counts / counts.sum()), step, [], np.zeros(width))
    number = F.element_at(F.create_map(*[v for i, x in enumerate(labels) for v in (F.lit(x), F.lit(i))]), F.col(label))
    values = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    ready = rows.select(number.alias("y"), (F.pmod(F.xxhash64(key), F.lit(10)) == 0).alias("valid"), F.xxhash64(key).alias("row"), *values)

    def pack(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                x = model.binned(np.stack([part.column(3 + i).to_numpy() for i in range(width)], 1))
                f = np.tile(model.start, (len(x), 1))
                cells = (x, part.column("y").to_numpy().astype(np.int64), part.column("valid").to_numpy(zero_copy_only=False), part.column("row").to_numpy(), f)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells], names)

    names = ["x", "y", "valid", "row", "f"]
    schema = ", ".join(f"{c} binary" for c in names)

    def blocks(batches):
        for b in batches:
            for x, y, valid, row, f in zip(*(b.column(c).to_pylist() for c in names)):
                yield (np.frombuffer(x, np.uint8).reshape(-1, width), np.frombuffer(y, np.int64), np.frombuffer(valid, bool), np.frombuffer(row, np.int64), np.frombuffer(f).reshape(-1, k))

    def stored(some: DataFrame) -> DataFrame:
        path = scratch_path(spark, "boost")
        some.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def summed(state: DataFrame, trees: list[dict], level: int, r: int) -> list[np.ndarray]:
        def run(batches):
            for x, y, valid, row, f in blocks(batches):
                cols = _histograms(x, y, f, row, valid, trees, level, r, subsample, seed)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if i < 4 else np.int64)) for i, c in enumerate(cols)], [c.split()[0] for c in _SUMS.split(", ")])

        found = state.mapInArrow(run, _SUMS).groupBy("class", "node", "feature", "bin").agg(F.sum("g"), F.sum("h"), F.sum("n")).toArrow()
        return [c.to_numpy() for c in found.columns]

    state, losses = stored(ready.mapInArrow(pack, schema)), []
    while len(model.rounds) < max_iter:
        r, trees, leaves = len(model.rounds), [{} for _ in labels], [{} for _ in labels]
        gains = np.zeros(width)
        for level in range(max_depth):
            sums = summed(state, trees, level, r)
            if level == 0:
                held = sums[0] == -1
                losses.append(sums[4][held].sum() / _ONE / sums[6][held].sum() if held.any() else None)
                if losses[-1] is not None and len(losses) > patience and min(losses[-patience:]) > min(losses[:-patience]) - tol:
                    return model
            open_ = False
            for (c, node), (gain, f, cut, (lg, lh, ln), (g, h, n)) in _best_cuts(sums, width, min_leaf, min_split).items():
                leaves[c][node] = _worth(g, h, k)
                if gain is not None:
                    trees[c][node] = (f, cut)
                    leaves[c].pop(node)
                    leaves[c][2 * node + 1], leaves[c][2 * node + 2] = _worth(lg, lh, k), _worth(g - lg, h - lh, k)
                    gains[f] += gain
                    open_ = True
            if not open_:
                break
        model.rounds.append(list(zip(trees, leaves)))
        model.gains = model.gains + gains

        def add(batches, model=model, r=r):
            for x, y, valid, row, f in blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (x, y, valid, row, f + model.added(x, r))], names)

        state = stored(state.mapInArrow(add, schema))
    return model


def _worth(g: int, h: int, k: int) -> float:
    return (k - 1) / k * g / h if h > 0 else 0.0
