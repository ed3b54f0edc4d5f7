"""Machine learning on URL features (L1-L10, R6) with Spark ML.

Feature columns come from the F2/F1 jobs; models are Spark ML pipelines, trained and applied
by Spark across partitions. Metrics (L6-L8) are plain aggregates over ``(label, prediction)``
pairs, so they apply to any predictor, the rule scorer included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (IDF, CountVectorizerModel, IndexToString, StandardScaler,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import TRAINING_FEATURES
from . import boost
from .boost import Boosted


def index_labels(df: DataFrame, label: str = "type", out: str = "label") -> DataFrame:
    """L1: label → integer in alphabetical order (0 = first label)."""
    model = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df).withColumn(out, F.col(out).cast("bigint"))


def scale_exact(df: DataFrame, cols: list[str]) -> DataFrame:
    """L2 with population deviation: ``(x - mean) / stddev_pop``; constant columns give 0.

    Means and deviations are one global aggregate (partial per partition); the 2×len(cols)
    numbers return as literals, so rows are never gathered.
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    st = df.agg(*aggs).first()
    out = df
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        if m is None:
            out = out.withColumn(c, F.lit(None).cast("double"))
        elif not s:
            out = out.withColumn(c, F.lit(0.0))
        else:
            out = out.withColumn(c, (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)))
    return out


def _front(features: list[str], scale: bool = True) -> list:
    stages = [StringIndexer(inputCol="type", outputCol="label", stringOrderType="alphabetAsc",
                            handleInvalid="skip"),
              VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return stages


def train_gbt(train: DataFrame, features: list[str] = TRAINING_FEATURES, max_iter: int = 100, max_depth: int = 8,
              step_size: float = 0.1, subsampling_rate: float = 0.8, min_instances: int = 10, min_split: int = 20, seed: int = 42,
              patience: int = 3, key: str = "page_id") -> Boosted:
    """L3: gradient-boosted trees, one ensemble over all labels; boosting ends early as ``boost.train`` says."""
    return boost.train(train, features, key=key, max_iter=max_iter, max_depth=max_depth, step=step_size, subsample=subsampling_rate,
                       min_leaf=min_instances, min_split=min_split, patience=patience, seed=seed)


def train_forest(train: DataFrame, features: list[str] = TRAINING_FEATURES, num_trees: int = 100,
                 max_depth: int = 10, seed: int = 42) -> PipelineModel:
    """L4: random forest (the analysed script's fallback model)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, predictionCol="prediction_idx")
    return Pipeline(stages=_front(features) + [rf]).fit(train)


def url_grams(url: Column | str, n: int = 3) -> Column:
    """The runs of n characters of a URL, lower-cased; none if it is shorter."""
    low = F.lower(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")))
    last = F.length(low) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def chi_square(df: DataFrame, grams: str, label: str = "type") -> DataFrame:
    """(gram, df, chi2): how far a gram's rows by label are from what its frequency alone gives, for every gram.

    The statistic of the table of labels by presence is N^2 / (df (N - df)) * (sum of A^2 / N_c - df^2 / N), where A counts the rows of
    a label with the gram, so labels without it need no row. A gram that all rows have tells nothing and gets 0.
    """
    rows = df.filter(F.col(label).isNotNull())
    by_label = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    by_label = by_label.withColumn("n", F.sum("n_c").over(Window.partitionBy()))  # one row per label
    each = rows.select(F.col(label).alias("label"), F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram", "label").agg(F.count(F.lit(1)).alias("a"))
    each = each.join(by_label, "label")
    sums = each.groupBy("gram").agg(F.sum("a").alias("df"), F.sum(F.col("a").cast("double") * F.col("a") / F.col("n_c")).alias("s"), F.first("n").cast("double").alias("n"))
    value = F.col("n") * F.col("n") / (F.col("df") * (F.col("n") - F.col("df"))) * (F.col("s") - F.col("df").cast("double") * F.col("df") / F.col("n"))
    return sums.select("gram", "df", F.when(F.col("df") < F.col("n"), value).otherwise(F.lit(0.0)).alias("chi2"))


@dataclass
class TextModel:
    """L5's model: the chosen grams' counts, weighted by IDF, into a multinomial regression."""

    labels: list[str]
    vocabulary: list[str]
    n: int
    model: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``prediction_idx``."""
        return self.model.transform(df.withColumn("_grams", url_grams("url", self.n))).drop("_grams")


def train_text(train: DataFrame, url: str = "url", n: int = 3, vocabulary: int = 20_000,
               max_iter: int = 100, reg: float = 0.0) -> TextModel:
    """Classifier on the raw URL text: the ``vocabulary`` character n-grams of the highest chi-square against the label → TF → IDF →
    multinomial regression. The statistic is computed by Spark over all grams; the fit holds ``vocabulary`` numbers a label."""
    rows = train.select(F.col(url).alias("url"), "type").withColumn("_grams", url_grams("url", n))
    chosen = [r["gram"] for r in chi_square(rows, "_grams").orderBy(F.col("chi2").desc(), "gram").limit(vocabulary).collect()]
    index = StringIndexer(inputCol="type", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
    count = CountVectorizerModel.from_vocabulary(chosen or [""], "_grams", "_tf")
    fitted = Pipeline(stages=[count, IDF(inputCol="_tf", outputCol="features"),
                              LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=max_iter, regParam=reg,
                                                 predictionCol="prediction_idx")]).fit(index.transform(rows))
    return TextModel(list(index.labels), chosen, n, fitted)


def labels_of(model: PipelineModel | Boosted | TextModel) -> list[str]:
    return list(model.stages[0].labels if isinstance(model, PipelineModel) else model.labels)


def predict(model: PipelineModel | Boosted | TextModel, df: DataFrame) -> DataFrame:
    """Apply a model; ``prediction`` is the label string again.

    The label indexer only serves the fit (null labels are skipped there): rows of any label are scored.
    """
    if isinstance(model, Boosted):
        return model.transform(df)
    out = (PipelineModel(model.stages[1:]) if isinstance(model, PipelineModel) else model).transform(df)
    back = IndexToString(inputCol="prediction_idx", outputCol="prediction", labels=labels_of(model))
    return back.transform(out)


def score_batch(model: PipelineModel | Boosted | TextModel, df: DataFrame) -> DataFrame:
    """Prediction, confidence (largest class probability) and a per-class probability map."""
    out = predict(model, df)
    probs = F.col("probabilities") if isinstance(model, Boosted) else vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in labels_of(model)])
    return out.withColumns({
        "confidence": F.array_max(probs),
        "probabilities": F.map_from_arrays(names, F.slice(probs, 1, len(labels_of(model)))),
    })


def feature_importance(model: PipelineModel | Boosted, features: list[str] = TRAINING_FEATURES) -> list[tuple[str, float]]:
    """(feature, importance), which sum to 1: the shares of the gains of the boosted ensemble, or those of the forest."""
    if isinstance(model, Boosted):
        return model.importances()
    return [(f, float(i)) for f, i in zip(features, model.stages[-1].featureImportances.toArray())]


def metrics_rows(pairs: DataFrame, importance: list[tuple[str, float]] = (), label: str = "type", prediction: str = "prediction") -> DataFrame:
    """A model's whole metrics in long form, (part, a, b, value): accuracy; precision, recall, f1 and support of each class and of
    the averages; the confusion matrix (label a, prediction b); the importance of each feature."""
    report = classification_report(pairs, label, prediction)
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("double").alias("value")) for c in ("precision", "recall", "f1", "support")])
    long = report.filter(F.col("class").isNull() | (F.col("class") != "accuracy")).select(F.col("class").alias("a"), F.explode(parts).alias("x"))
    out = accuracy(pairs, label, prediction).select(F.lit("accuracy").alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.col("accuracy").alias("value"))
    out = out.unionByName(long.select("x.part", "a", F.lit("").alias("b"), "x.value"))
    matrix = confusion_matrix(pairs, label, prediction)
    out = out.unionByName(matrix.select(F.lit("matrix").alias("part"), F.col("label").alias("a"), F.col("prediction").alias("b"), F.col("cnt").cast("double").alias("value")))
    if importance:
        rows = pairs.sparkSession.createDataFrame([("importance", f, "", float(v)) for f, v in importance], "part string, a string, b string, value double")
        out = out.unionByName(rows)
    return out


# --- metrics over (label, prediction) pairs (L6-L8) -----------------------------------------

def accuracy(pairs: DataFrame, label: str = "type", prediction: str = "prediction") -> DataFrame:
    """L6."""
    hit = F.when(F.col(label) == F.col(prediction), F.lit(1.0)).otherwise(F.lit(0.0))
    return pairs.agg(F.avg(hit).alias("accuracy"))


def pair_counts(pairs: DataFrame, label: str = "type", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, cnt): the one aggregate that the report and the matrix are made of."""
    return pairs.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("cnt"))


def classification_report(pairs: DataFrame, label: str = "type", prediction: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1, support, then accuracy, macro and weighted rows.

    Zero divisions give 0. The rows are scored and counted once; each count then stands once for
    its label and once for its prediction, in a table of classes squared.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(F.lit(0))
    sides = F.array(F.struct(F.col("label").alias("class"), F.col("cnt").alias("support"), hit.alias("tp"), F.lit(0).cast("bigint").alias("predicted")),
                    F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("tp"), F.col("cnt").alias("predicted")))
    per = (pair_counts(pairs, label, prediction).select(F.explode(sides).alias("s")).select("s.*").groupBy("class")
           .agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted")]))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = per.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    per = per.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support", "tp")
    tot = per.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n = F.col("n").cast("double")
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.try_divide(F.col("tp").cast("double"), n).alias("f1"),
                 F.col("n").cast("bigint").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.try_divide(F.col("wp"), n).alias("precision"),
                 F.try_divide(F.col("wr"), n).alias("recall"), F.try_divide(F.col("wf"), n).alias("f1"),
                 F.col("n").cast("bigint").alias("support")))).alias("s")).select("s.*")
    return per.drop("tp").unionByName(summary)


def confusion_matrix(pairs: DataFrame, label: str = "type", prediction: str = "prediction") -> DataFrame:
    """Long-form matrix over all classes that occur on either side, absent pairs counted 0.

    The classes come from the pair counts, so the rows are scored once; nothing is collected.
    """
    counts = pair_counts(pairs, label, prediction)
    classes = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("label", "prediction")))))
    # one row: the classes and the counts by pair
    whole = counts.agg(F.filter(classes, lambda c: c.isNotNull()).alias("classes"),
                       F.map_from_entries(F.collect_list(F.struct(F.struct("label", "prediction").alias("k"), "cnt"))).alias("by_pair"))
    cells = whole.select("classes", "by_pair", F.explode("classes").alias("label"))
    cells = cells.select("by_pair", "label", F.explode("classes").alias("prediction"))
    found = F.try_element_at("by_pair", F.struct("label", "prediction"))
    return cells.select("label", "prediction", F.coalesce(found, F.lit(0)).cast("bigint").alias("cnt"))
