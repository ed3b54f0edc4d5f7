"""Structured Streaming jobs.

New URL rows arrive as parquet files in a folder. Every job is checkpointed in the shared
checkpoint folder, so a restart resumes from the last committed batch and adds nothing twice.
``availableNow`` processes what is there and stops (used by tests and scheduled runs); a
long-running deployment uses ``processingTime`` instead.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.features import lexical_features
from ..operators.enrich import enrich_urls
from ..operators.rules import malicious, model_then_rules, score_rules
from ..session import exists


def read_feed(spark: SparkSession, folder: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """W1 source: parquet files dropped into ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def alerts(stream: DataFrame) -> DataFrame:
    """Enrich, score and keep the URLs the rules call malicious (stateless, append)."""
    scored = score_rules(lexical_features(enrich_urls(stream)))
    return malicious(scored, "event_id", "url", "type", "prediction", "rule_score", "confidence")


def publish(spark: SparkSession, versions: str, number: int, rules: DataFrame | None = None, model: PipelineModel | None = None) -> None:
    """Write version ``number`` of the suffix rules and the fitted model below ``versions``; it is marked as ready last, so a
    reader sees all of it or nothing. What is left out is the built-in list, and the rules alone."""
    folder = f"{versions.rstrip('/')}/{number:06d}"
    if rules is not None:
        rules.write.parquet(f"{folder}/rules")
    if model is not None:
        model.write().save(f"{folder}/model")
    spark.range(1).write.parquet(f"{folder}/ready")


def newest_version(spark: SparkSession, versions: str) -> int | None:
    """The largest number that is ready."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(versions)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    ready = [int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{versions.rstrip('/')}/{n}/ready/_SUCCESS"))]
    return max(ready, default=None)


def run_versioned_alerts(stream: DataFrame, versions: str, sink: str, checkpoint: str, available_now: bool = True, interval: str = "30 seconds"):
    """W2 with what is newest: every micro-batch is enriched and scored with the newest version that is ready as it begins, so a new suffix
    list or model takes effect without a restart. Alerts carry their version; a micro-batch writes a folder of its own number, so
    one that runs twice writes the same folder again. Without any version the built-in list and the rules alone are used (version 0)."""
    loaded: dict[int, tuple] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = newest_version(spark, versions) or 0
        if number not in loaded:
            folder = f"{versions.rstrip('/')}/{number:06d}"
            rules = spark.read.parquet(f"{folder}/rules") if exists(spark, f"{folder}/rules") else None
            model = PipelineModel.load(f"{folder}/model") if exists(spark, f"{folder}/model") else None
            loaded.clear()
            loaded[number] = (rules, model)
        rules, model = loaded[number]
        rows = model_then_rules(lexical_features(enrich_urls(batch, rules)), model)
        (malicious(rows, "event_id", "url", "type", "tld", "prediction", "rule_score", "confidence").withColumn("version", F.lit(number))
         .write.mode("overwrite").parquet(f"{sink}/batch={batch_id}"))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
    if available_now:
        q.awaitTermination()
    return q


def counts(stream: DataFrame) -> DataFrame:
    """Running count per label (state kept in the checkpoint)."""
    return enrich_urls(stream).groupBy("type").agg(F.count(F.lit(1)).alias("cnt"))


def run_append(df: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Append-mode parquet sink; exactly-once through the file sink log and the checkpoint."""
    w = (df.writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def run_update(df: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Update-mode aggregate: a micro-batch writes only the groups it changed, to a folder of its own
    number, so a batch that runs twice writes the same folder again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    w = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def from_state(spark: SparkSession, checkpoint: str, key: str, values: dict[str, str]) -> DataFrame:
    """The running table itself, read from the state that the checkpoint keeps: its cost is that of the groups, however
    many batches there were. values: the name of each value for its place in the state (``count`` for a count)."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col(f"key.{key}").alias(key), *[F.col(f"value.{place}").alias(name) for place, name in values.items()])


def latest(spark: SparkSession, sink: str, key: str, values: list[str]) -> DataFrame:
    """The table that ``run_update`` keeps: each key's row of the last batch that changed it."""
    rows = spark.read.parquet(sink)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("x"))
    return last.select(key, *[F.col(f"x.{v}").alias(v) for v in values])
