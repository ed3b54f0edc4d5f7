"""Sources and sinks (S1-S12) over any Hadoop file system.

Reading a raw ``url,type`` file looks at every line of every file: one aggregate counts, for each
separator, the lines that split into two fields; the first separator that has any is taken, and the reader
then parses all lines in parallel as column expressions. Lines of one field keep their text with a null type. Header rows go
by their value, wherever they stand, so a folder in which one file has a header loses no data row. Lines of more than two
fields are kept in a reject table with their number, never cut. Writers are Spark writers: append, overwrite, partitioned.

A quoted field may hold line breaks, also where a file is split. Whether a line begins within a quoted field is a prefix scan: a
line takes the reader from one state to another (within quotes or not), so it is one of four functions, which are composed within
each split, then over the splits of a file. Only lines of records that do span lines are shuffled; files without such
records are read line by line. A file that ends within quotes has no records under that separator, and a record of over
``RECORD_LIMIT`` characters is refused: its lines are rejected one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import SEPARATORS, WHITESPACE
from ..functions.urlparts import py_strip
from ..session import exists

RAW_SCHEMA = "url string, type string"
#: Most characters of a record that spans lines.
RECORD_LIMIT = 131_072
#: A run of what Python calls white space; Java's own class is ASCII only.
_SPACES = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]+"


def _fields(line: Column, sep: str) -> Column:
    """Quote-aware fields of a line, as an array: null for an absent field, '' for an empty one."""
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    row = F.from_csv(line, "a string, b string, c string", options)
    return F.filter(F.array(row["a"], row["b"], row["c"]), lambda x: x.isNotNull())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.length(py_strip("value")) > 0)


def _within(line: Column, sep: str, before: bool) -> Column:
    """Whether a quoted field is open behind ``line``, if one was (or was not) before it. A quote opens a field only
    where the field begins; doubled quotes leave the state as it is."""
    def step(open_: Column, chunk: Column) -> Column:
        odd = (F.length(chunk) - F.length(F.replace(chunk, F.lit('"'), F.lit("")))) % 2 == 1
        return F.when(open_, ~odd).otherwise(chunk.startswith('"') & odd)

    chunks = F.split(line, "[" + sep + "]")
    return F.when(line.contains('"'), F.aggregate(chunks, F.lit(before), step)).otherwise(F.lit(before))


def _numbered_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, at, value, before, after, record): each line with its place, whether a quoted field is open before and
    after it, and how many records of its file end before it."""
    line = F.col("value")
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        _within(line, sep, False).alias("c"), _within(line, sep, True).alias("o"))
    # a window holds the lines of one split of a file
    w = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("swaps", F.sum((F.col("c") & ~F.col("o")).cast("int")).over(w))
    lines = lines.withColumn("fixed", F.last(F.when(F.col("c") == F.col("o"), F.struct("c", "swaps")), ignorenulls=True).over(w))

    def state(start: Column) -> Column:
        return F.when(F.col("fixed").isNotNull(), F.col("fixed.c") != ((F.col("swaps") - F.col("fixed.swaps")) % 2 == 1)).otherwise(start != (F.col("swaps") % 2 == 1))

    # what a split does to either state, and the records that end in it
    blocks = (lines.groupBy("file", "block")
              .agg(F.max_by(state(F.lit(False)), "at").alias("c"), F.max_by(state(F.lit(True)), "at").alias("o"),
                   F.count_if(~state(F.lit(False))).alias("n_c"), F.count_if(~state(F.lit(True))).alias("n_o")))
    # the splits of a file, one row each
    v = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("swaps", F.sum((F.col("c") & ~F.col("o")).cast("int")).over(v))
    blocks = blocks.withColumn("fixed", F.last(F.when(F.col("c") == F.col("o"), F.struct("c", "swaps")), ignorenulls=True).over(v))
    blocks = blocks.withColumn("start", F.coalesce(F.lag(state(F.lit(False))).over(one), F.lit(False)))
    ended = F.sum(F.when(F.col("start"), F.col("n_o")).otherwise(F.col("n_c"))).over(v) - F.when(F.col("start"), F.col("n_o")).otherwise(F.col("n_c"))
    blocks = blocks.select("file", "block", "start", ended.alias("base"))
    lines = lines.join(blocks, ["file", "block"]).withColumn("after", state(F.col("start")))
    lines = lines.withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy("file", "block").orderBy("at")), F.col("start")))
    record = F.col("base") + F.coalesce(F.count_if(~F.col("after")).over(behind), F.lit(0))
    return lines.select("file", "block", "at", "value", "before", "after", record.alias("record"))


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(value, whole): the records of a folder in which some span lines, joined by line feeds; whole is false for lines of records that are too
    long. Blank lines go where they stand between records."""
    lines = _numbered_lines(spark, path, sep)
    alone = lines.filter(~F.col("before") & ~F.col("after") & (F.length(py_strip("value")) > 0)).select("value", F.lit(True).alias("whole"))
    parts = lines.filter("before or after")
    sizes = parts.groupBy("file", "record").agg(F.sum(F.length("value") + 1).alias("size"))
    parts = parts.join(sizes, ["file", "record"])
    joined = (parts.filter(F.col("size") <= RECORD_LIMIT).groupBy("file", "record")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("value")))
    long = parts.filter(F.col("size") > RECORD_LIMIT).select("value", F.lit(False).alias("whole"))
    return alone.unionByName(joined.select("value", F.lit(True).alias("whole"))).unionByName(long)


def _ends_open(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether any file ends within quotes."""
    last = _numbered_lines(spark, path, sep).groupBy("file").agg(F.max_by("after", F.struct("block", "at")).alias("after"))
    return last.filter("after").limit(1).count() > 0


def _format(spark: SparkSession, path: str, seps: list[str] = SEPARATORS) -> tuple[str | None, bool]:
    """(separator or None, whether some record spans lines)."""
    value = F.col("value")
    counts = _lines(spark, path).agg(*[c for i, s in enumerate(seps) for c in (
        F.count_if(F.size(_fields(value, s)) == 2).alias(f"two{i}"), F.count_if(_within(value, s, False)).alias(f"open{i}"))]).first()
    for i, s in enumerate(seps):
        if not counts[f"open{i}"]:
            if counts[f"two{i}"]:
                return s, False
        elif not _ends_open(spark, path, s) and _parsed(spark, path, s, True).filter(F.size("f") == 2).limit(1).count():
            return s, True
    return None, False


def detect_format(spark: SparkSession, path: str) -> str | None:
    """The separator, or None.

    The first of comma, tab, semicolon and pipe under which any record has exactly two fields, quotes respected. One
    aggregate over all lines, eight numbers to the driver; only where a quoted field is left open are records put together.
    """
    return _format(spark, path)[0]


def _no_header(df: DataFrame) -> DataFrame:
    """Rows whose two values are the column names go, case and blanks aside."""
    named = (F.lower(py_strip("url")) == "url") & (F.lower(py_strip("type")) == "type")
    return df.filter(~F.coalesce(named, F.lit(False)))


def split_fallback(spark: SparkSession, path: str) -> DataFrame:
    """S3: skip blank lines; split once on a tab if the line has one, else on the first
    run of white space (Unicode's, as Python has it); keep lines with two parts."""
    line = py_strip("value")
    parts = F.when(line.contains("\t"), F.split(line, "\t", 2)).otherwise(F.split(line, _SPACES, 2))
    return _no_header(spark.read.text(path).select(parts.alias("p"))
                      .filter(F.size("p") == 2)
                      .select(F.col("p")[0].alias("url"), F.col("p")[1].alias("type")))


def _parsed(spark: SparkSession, path: str, sep: str, spanning: bool) -> DataFrame:
    """(value, f): the records with their fields; no fields for what is too long."""
    if spanning:
        return _records(spark, path, sep).select("value", F.when(F.col("whole"), _fields(F.col("value"), sep)).alias("f"))
    return _lines(spark, path).select("value", _fields(F.col("value"), sep).alias("f"))


def _chosen(spark: SparkSession, path: str, sep: str | None) -> tuple[str | None, bool]:
    if sep is None:
        return _format(spark, path)
    opened = _lines(spark, path).filter(_within(F.col("value"), sep, False)).limit(1).count() > 0
    return sep, opened and not _ends_open(spark, path, sep)


def read_raw_urls(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """``url, type`` from delimited text of unknown (or given) separator.

    Records of one field have a null type; records of three or more fields are in ``rejected_lines``.
    """
    sep, spanning = _chosen(spark, path, sep)
    if sep is None:
        return split_fallback(spark, path)
    f = F.col("f")
    return _no_header(_parsed(spark, path, sep, spanning).filter(F.size("f") <= 2).filter("f is not null")
                      .select(F.get(f, F.lit(0)).alias("url"), F.get(f, F.lit(1)).alias("type")))


def rejected_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(line, n): the records that ``read_raw_urls`` leaves out, with how often they stand there."""
    sep, spanning = _chosen(spark, path, sep)
    if sep is None:
        line = py_strip("value")
        bad = _lines(spark, path).filter(F.size(F.when(line.contains("\t"), F.split(line, "\t", 2)).otherwise(F.split(line, _SPACES, 2))) != 2)
    else:
        bad = _parsed(spark, path, sep, spanning).filter("f is null or size(f) > 2")
    return bad.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def write_raw_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    """Writer counterpart, keeping surrounding blanks and empty strings as they are."""
    (df.select("url", "type").write.mode(mode).option("sep", sep)
     .option("header", str(header).lower()).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .csv(path))


def pick_source(spark: SparkSession, candidates: list[str]) -> str:
    """First existing path of the list."""
    for p in candidates:
        if exists(spark, p):
            return p
    raise FileNotFoundError("none of the candidate inputs exists: " + ", ".join(candidates))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row; non-ASCII text is written as is."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema, permissive: bool = False) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines dropped (or kept as
    ``_corrupt_record`` when ``permissive``)."""
    r = spark.read.schema(schema)
    if permissive:
        return r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return r.option("mode", "DROPMALFORMED").json(path)


def jsonl_line_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(lines, good, bad): how many non-blank lines the JSON reader keeps and drops."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    row = F.from_json("value", schema + ", _corrupt_record string", options)
    bad = _lines(spark, path).select(row["_corrupt_record"].isNotNull().alias("bad"))
    return bad.agg(F.count("*").alias("lines"), F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))


def append_urls(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Append rows (no de-duplication); returns the table as now stored and the number of
    rows this call added, counted while they were written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def overwrite_result(df: DataFrame, path: str) -> DataFrame:
    """Replace a result table (a metrics table is a one-row or long-form result)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_fallback_source(spark: SparkSession, primary: str, fallback_csv: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """The stored table when it exists and has a row, else the raw CSV.

    A folder without files and a table without rows both count as empty.
    """
    if exists(spark, primary):
        stored = spark.read.schema(schema).parquet(primary)
        if stored.limit(1).count() > 0:
            return stored
    return read_raw_urls(spark, fallback_csv)


#: The columns by which stored URLs are looked up.
LOOKUP_COLUMNS = ["domain", "type", "tld", "url_length", "country", "ts"]


def _position(c: Column) -> Column:
    """A number that grows with the value: a string's first six bytes, a number or time itself."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(c.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def _below(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts are below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x < value)) if cuts else F.lit(0)


def interleaved(df: DataFrame, columns: list[str], bits: int = 6) -> Column:
    """A sort key that keeps rows together that are near in all ``columns``: the bits of each column's quantile range, in turn.

    The ranges come from one pass of quantile sketches, a few numbers a column.
    """
    kinds = dict(df.dtypes)
    values = [_position(F.col(c)) if kinds[c] in ("string", "binary")
              else F.coalesce(F.col(c).cast("timestamp" if kinds[c].startswith(("timestamp", "date")) else "double").cast("double"), F.lit(-1e300)) for c in columns]
    cuts = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)]).approxQuantile(
        [f"v{i}" for i in range(len(columns))], [i / (1 << bits) for i in range(1, 1 << bits)], 1e-3)
    key = F.lit(0).cast("bigint")
    for i, (v, own) in enumerate(zip(values, cuts)):
        own = sorted(set(own))
        # spread over all bits, so that a column of few values counts as much as the others
        place = _below(v, own)
        place = F.floor(place * F.lit((1 << bits) / (len(own) + 1))).cast("int")
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(place, b).bitwiseAND(F.lit(1)).cast("bigint"), b * len(columns) + len(columns) - 1 - i))
    return key


def layout_for_lookups(df: DataFrame, path: str, columns: list[str] | None = None, files: int | None = None, row_group_bytes: int = 8 << 20) -> None:
    """S11 for all indexed columns: rows in interleaved order of the columns, so that every column's values lie in few row groups, and a bloom filter
    on each text column, so that an equality skips the row groups whose least and greatest value hold it by chance. Ranges of the key
    are parted by the URL's hash, so that one hot value is many tasks and files."""
    columns = [c for c in (columns or LOOKUP_COLUMNS) if c in df.columns]
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_key", interleaved(df, columns)).withColumn("_hash", F.xxhash64("url"))
    writer = (rows.repartitionByRange(n, "_key", "_hash").sortWithinPartitions("_key", "_hash").drop("_key", "_hash")
              .write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("parquet.page.size", max(1024, row_group_bytes // 16)))
    for c, kind in df.dtypes:
        if c in columns and kind == "string":
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "100000")
    # times as 64-bit numbers: those of 96 bits, the default, have no least and greatest value
    setting = "spark.sql.parquet.outputTimestampType"
    before = df.sparkSession.conf.get(setting)
    try:
        df.sparkSession.conf.set(setting, "TIMESTAMP_MICROS")
        writer.parquet(path)
    finally:
        df.sparkSession.conf.set(setting, before)


def layout_urls(df: DataFrame, path: str, partition: str = "type", sort: str = "domain", files: int | None = None) -> None:
    """Partitioned by label, sorted by domain within files, so filters on the label prune
    folders and filters on the domain skip row groups by their min/max statistics. Ranges over
    (label, domain, hash of the URL) give a large label, and a domain that holds much of it, many files instead of one task."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_hash", F.xxhash64("url"))
    (rows.repartitionByRange(n, partition, sort, "_hash").sortWithinPartitions(partition, sort).drop("_hash")
     .write.mode("overwrite").partitionBy(partition).parquet(path))
