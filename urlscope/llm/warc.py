"""Content-addressed web archive.

A store holds two tables below one folder:

``payloads``  one row for each distinct payload: (sha256, bytes), the bytes once however many
              records carry them;
``headers``   one row for each record: the exact record header block as it stands in a WARC
              file, its record number, and the digest of the payload it stands before.

Equal digests are not taken on trust: while it writes, the store also compares length and a
second, independent digest of every payload under one SHA-256, and while it reads it hashes the
stored bytes again. A record is header + blank line + payload + two blank lines; ``records``
puts that back together by a join on the digest, and ``export_files`` writes it as WARC files, which
``read_files`` reads again record by record. A revisit record has no block of its own; its payload is that of the response
with its digest that it refers to, which ``restored`` joins to it. The query reads the store, not the files.

Defined cases: a null payload counts as empty. Of rows with one id the store makes one record
each, and the one with the smallest header is the response where all else is equal. Null ids come last among equal
payloads. A null address is written as ``urn:none``; line breaks in it are percent-encoded. An
empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records get one date, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
LINE = "\r\n"


def sha1_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _marks(batches):
    """Digests of every payload; the payload itself is left behind."""
    for b in batches:
        got = [p or b"" for p in common.utf8_lists(b, "payload")]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("url"), pa.array([hashlib.sha256(p).digest() for p in got], pa.binary()),
             pa.array([sha1_text(p) for p in got]), pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in got], pa.binary()),
             pa.array([len(p) for p in got], pa.int64())], ["id", "url", "sha256", "sha1", "second", "size"])


def _header(kind: str) -> F.Column:
    """The exact header block of a record, ending with an empty line."""
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("urn:none")), "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", name("id")), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", name("first")), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Payload-Length", F.col("size").cast("string"))]
    fields += [("Content-Type", F.lit("text/html; charset=utf-8")),
               ("Content-Length", F.col("size").cast("string") if kind == "response" else F.lit("0"))]
    return F.concat(F.lit(VERSION + LINE), *[F.concat(F.lit(k + ": "), v, F.lit(LINE)) for k, v in fields], F.lit(LINE))


def write_store(spark: SparkSession, pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                payload_col: str = "html", least_size: int = 0) -> None:
    """Write ``payloads`` and ``headers`` below ``folder``.

    Of records with equal payloads of at least ``least_size`` bytes the one with the smallest id is a
    response, the others revisit it. Digests travel, payloads only to the one place they are
    kept at: a hot payload is dropped to one row a task before the shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(payload_col).cast("string").alias("payload"))
    marks = common.stored(spark, common.map_arrow(
        rows, _marks, "id bigint, url string, sha256 binary, sha1 string, second binary, size bigint"), "marks")
    groups = marks.groupBy("sha256").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("least"), F.min("second").alias("a"), F.max("second").alias("b"),
        F.min("size").alias("c"), F.max("size").alias("d"), F.count("*").alias("n"))
    groups = groups.withColumn("sha256", F.when((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")), F.col("sha256"))
                               .otherwise(F.raise_error(F.lit("two payloads with one SHA-256"))))
    shared = groups.where(F.col("n") > 1).select("sha256", "least")
    out = marks.join(shared, "sha256", "left").withColumn("first", F.col("least.id"))
    alone = F.col("least").isNull() | (F.col("size") < least_size)
    # one response of a group, also where an id stands on several rows
    first = (F.col("id").eqNullSafe(F.col("least.id"))) & F.col("url").eqNullSafe(F.col("least.url"))
    copies = marks.groupBy("sha256", "id", "url").count().where("count > 1").limit(1).count() > 0
    if copies:
        out = out.withColumn("row", F.monotonically_increasing_id())
        least_row = out.where(first).groupBy("sha256").agg(F.min("row").alias("least_row"))
        out = common.stored(spark, out, "rows").join(common.stored(spark, least_row, "least"), "sha256", "left")
        first = F.col("row") == F.col("least_row")
    out = out.withColumn("header", F.when(alone | first, _header("response")).otherwise(_header("revisit")).cast("binary"))
    out.select("id", "sha256", "header").write.parquet(f"{folder}/headers")
    _payloads(rows).write.parquet(f"{folder}/payloads")


def _payloads(rows: DataFrame) -> DataFrame:
    """(sha256, payload) with each payload once: once a task first, then once over all tasks."""

    def once(batches):
        seen = set()
        for b in batches:
            got = [(hashlib.sha256(p).digest(), p) for p in (p or b"" for p in common.utf8_lists(b, "payload"))]
            new = [(d, p) for d, p in dict(got).items() if d not in seen]
            seen.update(d for d, _ in new)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in new], pa.binary()), pa.array([p for _, p in new], pa.binary())],
                                             ["sha256", "payload"])

    def keep_first(batches):
        last = None
        for b in batches:
            digests = b.column("sha256").to_pylist()
            take = [i for i, d in enumerate(digests) if d != (digests[i - 1] if i else last)]
            last = digests[-1] if digests else last
            yield b.take(pa.array(take, pa.int64()))

    schema = "sha256 binary, payload binary"
    dealt = common.map_arrow(rows.select("payload"), once, schema).repartition("sha256").sortWithinPartitions("sha256")
    return common.map_arrow(dealt, keep_first, schema)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, sha256, header, payload, intact): every original record, put together by a join.

    A hot payload meets many headers; the adaptive skew join splits them.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    # the stored bytes are hashed again on the way out
    payloads = payloads.withColumn("intact", F.unhex(F.sha2("payload", 256)) == F.col("sha256"))
    return headers.join(payloads, "sha256", "left")


def parse(rows: DataFrame) -> DataFrame:
    """Records of ``records`` with their header fields read back from the header bytes.

    Raises where the store lacks a payload or its bytes don't have the digest they are kept under.
    """

    def run(batches):
        for b in batches:
            out = []
            for header, payload, intact in zip(*(b.column(c).to_pylist() for c in ("header", "payload", "intact"))):
                if not intact:
                    raise ValueError("a payload is lost or damaged")
                fields = dict(x.split(": ", 1) for x in header.decode().split(LINE)[1:] if x)
                digest = sha1_text(payload)
                if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError("a record's digest doesn't fit its payload")
                ids = [None if (v := fields.get(k)) is None or v == "<urn:page:null>" else int(v[len("<urn:page:"):-1])
                       for k in ("WARC-Record-ID", "WARC-Refers-To")]
                out.append((ids[0], len(payload), digest, fields["WARC-Type"], ids[1], fields["WARC-Target-URI"]))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return common.map_arrow(rows.select("header", "payload", "intact"), run,
                            "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def export_files(spark: SparkSession, folder: str, out: str) -> None:
    """Write the records as WARC text files, one for each partition: header, block, two line ends."""
    block = F.when(F.col("header").cast("string").contains("WARC-Type: response"), F.col("payload").cast("string")).otherwise("")
    records(spark, folder).select(F.concat(F.col("header").cast("string"), block).alias("value")).write.option("lineSep", LINE + LINE).text(out)


def _warc_records(stream):
    """(header, block) of each record of a WARC file, one at a time."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        header = [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            header.append(line)
        size = next((int(x.split(b":", 1)[1]) for x in header if x.lower().startswith(b"content-length:")), None)
        block = stream.read(size) if size is not None else b""
        if size is None or len(block) != size or line == b"" or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield b"".join(header) + b"\r\n", block


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, header, record_type, refers_to, digest, block) of every record of the WARC files below ``folder``, a task a file, a record at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                system, at = common.open_folder(path if "://" in path else path.replace("file:", "file://", 1))
                with system.open_input_stream(at) as f:
                    held, size = [], 0
                    for header, block in _warc_records(io.BufferedReader(f, 1 << 20)):
                        held.append((header, block))
                        size += len(header) + len(block)
                        if size > 4_000_000:
                            yield told(held)
                            held, size = [], 0
                    yield told(held)

    def told(held):
        out = []
        for header, block in held:
            fields = dict(x.split(": ", 1) for x in header.decode().split(LINE)[1:] if x)
            ids = [None if (v := fields.get(k)) is None or v == "<urn:page:null>" else int(v[len("<urn:page:"):-1]) for k in ("WARC-Record-ID", "WARC-Refers-To")]
            out.append((ids[0], header, fields["WARC-Type"], ids[1], fields["WARC-Payload-Digest"].removeprefix("sha1:"), block))
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["id", "header", "record_type", "refers_to", "digest", "block"])

    return common.map_arrow(files, run, "id bigint, header binary, record_type string, refers_to bigint, digest string, block binary")


def restored(rows: DataFrame) -> DataFrame:
    """(id, header, payload) of the records of ``read_files``: revisits get the payload of the response with their digest that they refer to."""
    responses = rows.where("record_type = 'response'").select(F.col("digest"), F.col("id").alias("first"), F.col("block").alias("whole"))
    revisits = rows.where("record_type = 'revisit'")
    # several responses of one id have different digests
    found = revisits.join(responses, (revisits["digest"] == responses["digest"]) & revisits["refers_to"].eqNullSafe(responses["first"]), "left")
    found = found.select("id", "header", F.when(F.col("whole").isNotNull(), F.col("whole")).otherwise(F.raise_error(F.lit("a revisit's response is not there"))).alias("payload"))
    return rows.where("record_type = 'response'").select("id", "header", F.col("block").alias("payload")).unionByName(found)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: archive all pages, read the archive back, give each record's facts."""
    from urlscope.session import scratch_path
    folder = scratch_path(spark, "warc")
    write_store(spark, common.table(spark, sf_dir, "pages"), folder)
    return parse(records(spark, folder)).withColumnRenamed("id", "page_id").drop("url")


#: The digest of the full payload in base32 by hex arithmetic is beyond plain SQL; see the tests.
ORACLE_SQL = None
