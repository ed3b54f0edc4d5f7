"""The boosted ensemble against a plain version in one array, and the choice of grams against brute force."""

import numpy as np
import pytest
from conftest import SF_ORACLE

from urlscope.operators import boost
from urlscope.operators import ml as ML
from urlscope.plans import catalog_more as C
from urlscope.plans.catalog import urls


def table(spark, n=700, seed=3):
    r = np.random.default_rng(seed)
    a, b, c = r.normal(size=n), r.integers(0, 6, n).astype(float), r.normal(size=n)
    label = np.where(a + 0.3 * b > 1.2, "x", np.where(c * a > 0.2, "y", "z"))
    rows = [(int(i), float(a[i]), float(b[i]), None if i % 50 == 7 else float(c[i]), None if i % 97 == 5 else str(label[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "page_id bigint, a double, b double, c double, type string").repartition(5)


def plain(rows, model, keys, max_iter, depth, step, subsample, min_leaf, min_split, patience, tol, seed):
    """The same by loops over all rows at once, from the same cuts of the features."""
    rows = [r for r in rows if r[4] is not None]
    x = np.array([[np.searchsorted(model.edges[i], r[1 + i] or 0.0) for i in range(3)] for r in rows])
    labels = sorted({r[4] for r in rows})
    y = np.array([labels.index(r[4]) for r in rows])
    key = np.array([keys[r[0]] for r in rows], np.int64)
    valid = key % 10 == 0
    k = len(labels)
    share = np.array([(y == c).mean() for c in range(k)])
    f = np.tile(np.log(share), (len(x), 1))
    losses, rounds = [], 0
    while True:
        e = np.exp(f - f.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        losses.append(-np.log(p[valid, y[valid]]).mean())
        if rounds == max_iter or len(losses) > patience and min(losses[-patience:]) > min(losses[:-patience]) - tol:
            return rounds, {r[0]: q for r, q in zip(rows, p)}, losses
        use = ~valid & boost._drawn(key, rounds, subsample, seed)
        add = np.zeros_like(f)
        for c in range(k):
            r = np.rint(((y == c) - p[:, c]) * 2.0 ** 40) / 2.0 ** 40
            h = np.rint(np.abs((y == c) - p[:, c]) * (1 - np.abs((y == c) - p[:, c])) * 2.0 ** 40) / 2.0 ** 40

            def grow(here, level):
                mine = here & use
                n = mine.sum()
                worth = (k - 1) / k * r[mine].sum() / h[mine].sum() if h[mine].sum() > 0 else 0.0
                best = (1e-12, None)
                if level < depth and n >= min_split:
                    for i in range(3):
                        for b in range(x[:, i].max()):
                            left = mine & (x[:, i] <= b)
                            m = left.sum()
                            if m >= min_leaf and n - m >= min_leaf:
                                gain = r[left].sum() ** 2 / m + r[mine & ~left].sum() ** 2 / (n - m) - r[mine].sum() ** 2 / n
                                if gain > best[0] + 1e-12:
                                    best = (gain, (i, b))
                if best[1] is None:
                    add[here, c] = step * worth
                else:
                    i, b = best[1]
                    grow(here & (x[:, i] <= b), level + 1)
                    grow(here & (x[:, i] > b), level + 1)
            if use.any():
                grow(np.ones(len(x), bool), 0)
        f = f + add
        rounds += 1


@pytest.mark.parametrize("max_iter,depth,block", [(6, 3, 8192), (4, 5, 37)])
def test_ensemble_equals_the_plain_version(spark, monkeypatch, max_iter, depth, block):
    monkeypatch.setattr(boost, "BLOCK_ROWS", block)
    rows, df = table(spark)
    model = ML.train_gbt(df, ["a", "b", "c"], max_iter=max_iter, max_depth=depth)
    keys = {r[0]: r[1] for r in df.selectExpr("page_id", "xxhash64(page_id)").collect()}
    rounds, want, _ = plain(rows, model, keys, max_iter, depth, 0.1, 0.8, 10, 20, 3, 1e-4, 42)
    assert model.labels == ["x", "y", "z"] and len(model.rounds) == rounds == max_iter
    got = {r["page_id"]: r["probabilities"] for r in ML.predict(model, df).collect()}
    assert len(got) == len(rows)
    assert all(np.allclose(got[i], p, atol=1e-9) for i, p in want.items())
    assert abs(sum(v for _, v in ML.feature_importance(model)) - 1) < 1e-9


def test_boosting_ends_early(spark):
    rows, df = table(spark, 400)
    model = ML.train_gbt(df, ["a", "b", "c"], max_iter=60, max_depth=4, step_size=0.6)
    keys = {r[0]: r[1] for r in df.selectExpr("page_id", "xxhash64(page_id)").collect()}
    rounds, _, losses = plain(rows, model, keys, 60, 4, 0.6, 0.8, 10, 20, 3, 1e-4, 42)
    assert len(model.rounds) == rounds < 60 and losses[-1] < losses[0]


def test_odd_tables_are_fitted(spark):
    _, df = table(spark, 60)
    one = ML.train_gbt(df.filter("type = 'x'"), ["a", "b"], max_iter=2)
    assert {tuple(r) for r in ML.score_batch(one, df).select("prediction", "confidence").collect()} == {("x", 1.0)}
    with pytest.raises(ValueError, match="no labelled rows"):
        ML.train_gbt(df.filter("false"), ["a"])
    few = ML.train_gbt(df.limit(8), ["a", "b"], max_iter=2)  # too few rows for any cut
    assert ML.predict(few, df.filter("false")).collect() == [] and ML.predict(few, df).count() == 60


def test_chi_square(spark):
    rows = [("abab", "x"), ("abc", "x"), ("bcd", "y"), ("bc", "y"), ("zabz", "z"), (None, "z"), ("abq", None)]
    df = spark.createDataFrame(rows, "url string, type string")
    got = {r["gram"]: (r["df"], r["chi2"]) for r in ML.chi_square(df.withColumn("g", ML.url_grams("url", 2)), "g").collect()}
    sets = [({u[i:i + 2] for i in range(len(u) - 1)} if u else set(), t) for u, t in rows if t]
    assert set(got) == set().union(*(s for s, _ in sets))
    for gram, (df_, value) in got.items():
        want, n = 0.0, len(sets)
        have = sum(gram in s for s, _ in sets)
        for label in "xyz":
            n_c, a = sum(t == label for _, t in sets), sum(gram in s and t == label for s, t in sets)
            for seen, part in ((a, have), (n_c - a, n - have)):
                want += (seen - part * n_c / n) ** 2 / (part * n_c / n)
        assert df_ == have and abs(value - want) < 1e-9


def test_chosen_grams_are_as_good_as_all(spark):
    """A bounded vocabulary predicts the test part no worse than hashing all grams to 2^18 numbers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer
    fit, test = C._text_split(spark, SF_ORACLE)
    small = ML.train_text(fit, max_iter=30)
    assert len(small.vocabulary) <= 20_000
    right = ML.accuracy(ML.predict(small, test)).first()[0]
    grams = [d.withColumn("_grams", ML.url_grams("url")) for d in (fit, test)]
    hashed = Pipeline(stages=[StringIndexer(inputCol="type", outputCol="label", handleInvalid="keep"), HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=1 << 18),
                              IDF(inputCol="_tf", outputCol="features"), LogisticRegression(family="multinomial", maxIter=30)]).fit(grams[0])
    other = hashed.transform(grams[1]).selectExpr("avg(cast(label = prediction as double))").first()[0]
    assert right >= other - 1e-9
