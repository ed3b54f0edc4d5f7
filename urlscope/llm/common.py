"""Helpers shared by the operators: reading, shared scratch tables, Arrow batches, words."""

from __future__ import annotations

import ctypes
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch; with whole documents of up to some 100 kB a batch stays small.
BATCH_ROWS = 512

#: A-Z to a-z, every other byte as it is.
_UPPER = bytes(range(65, 91))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage ends there,
    and a lost executor costs no more than reading files that all executors share."""
    from urlscope.session import scratch_path  # here, as task functions take this module along by value

    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside, and as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_arrow(df: DataFrame, func, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches, so that very long texts stay within a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(func, schema)


def give_back() -> None:
    """Return memory that is free within this worker to the machine: else an idle worker goes on holding what a step took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed arrays of up to 32 MB
    if trim:
        trim(0)


def one_text_each(rows: DataFrame, *others: str) -> DataFrame:
    """(others..., id, text): of the rows of one id the one with the least hash of its text, so that a bound on ids is one on rows.
    ``id`` comes as a number: its own, or its hash if it is no number."""
    kind = rows.schema["id"].dataType.simpleString()
    number = F.col("id").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("id")
    own = rows.groupBy("id", *others).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return own.select(*others, number.alias("id"), "text")


def utf8_lists(batch: pa.RecordBatch, name: str) -> list:
    """A string column as UTF-8 bytes, null as None."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def byte_table(keep: bytes, to: dict[int, int] | None = None) -> bytes:
    """Translation table: A-Z lowered, bytes in ``keep`` and all of 0x80-0xFF kept, the rest a blank."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in keep:
        out[b] = b
    for b in _UPPER:
        out[b] = b + 32
    for b, x in (to or {}).items():
        out[b] = x
    return bytes(out)


#: Runs of digits, letters and non-ASCII characters, lower-cased, as `table.translate().split()` gives them.
WORDS = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def crc_remainder(doc_id, n: int) -> int:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def crc_column(column: str, n: int):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % n


def open_folder(folder: str):
    """(file system, path) for reads and writes within tasks: a URI, or a plain path of a local run."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def write_whole(folder: str, name: str, data: bytes) -> None:
    """Write a file under a name of the task's attempt, then rename it: a task run twice does no harm."""
    from pyspark import TaskContext
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/{name}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, f"{path}/{name}")
