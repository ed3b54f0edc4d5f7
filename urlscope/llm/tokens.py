"""Token ids in directly addressable files.

An id is cut into 8-bit chunks, least first. Level 0 holds the lowest chunk of every id; level
k + 1 holds the next chunk of those ids that go on, in the same order. A bitmap at each level
says which ids go on, and a rank directory holds the number of set bits before every 512th bit,
so any id is found by one step a level: no block is decoded, nothing before it is read.

File (little-endian): ``b"DAC1"``, u32 number of levels, u64 documents, then for each level
u64 number of chunks; then for each level the chunks, the bitmap (one bit a chunk, lowest bit
first, padded to 64 bytes) and its directory (u64 for each 512 bits); then the i64 document ids and
u64 ends (ids up to and with each document, in this file).

Documents are dealt by ranges of their id to files, one task a file, so many that a file holds some ``FILE_BYTES`` of the table at most; an
id that fills several files is dealt on by the crc of its documents' tokens. A file is written under a
name of the task's attempt and then renamed, so a task that is run again does no harm. Only the
range bounds and the files' lengths, one number a file each, pass the driver.

Defined cases: null text counts as empty and gives the end id alone. Rows of one id are kept in
the order of their tokens' crc. A null id sorts first and is read back as null. An empty table gives no
files and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

END_ID = 1
#: Bytes of the stored table for a file, by the size that Spark knows of it.
FILE_BYTES = 256_000_000
_NULL = -(1 << 63)
#: str.split() also cuts at these, the tokenizer doesn't.
_ODD = "\x1c\x1d\x1e\x1f"
#: Words that a worker keeps.
_CACHE_WORDS = 500_000


# ---- the file format -------------------------------------------------------------------

def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes from the ids of its documents, one after the other."""
    levels, rest = [], np.asarray(ids)
    while True:
        more = rest >> 8
        goes_on = more > 0
        levels.append(((rest & 255).astype(np.uint8), goes_on))
        if not goes_on.any():
            break
        rest = more[goes_on]
    out = [b"DAC1", struct.pack("<IQ", len(levels), len(doc_ids)), *(struct.pack("<Q", len(c)) for c, _ in levels)]
    for chunks, goes_on in levels:
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % 64, np.uint8))
        counts = np.bitwise_count(bits.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.uint64)
        out += [chunks.tobytes(), bits.tobytes(), (np.cumsum(counts, dtype=np.uint64) - counts).tobytes()]
    out += [np.asarray(doc_ids, np.int64).tobytes(), np.cumsum(lengths).astype(np.uint64).tobytes()]
    return b"".join(out)


class Reader:
    """A file opened for random access; ``read(offset, size)`` gives its bytes."""

    def __init__(self, read):
        self.read = read
        if read(0, 4) != b"DAC1":
            raise ValueError("not a token file")
        n, self.n_docs = struct.unpack("<IQ", read(4, 12))
        at, self.levels = 16 + 8 * n, []
        for (size,) in struct.iter_unpack("<Q", read(16, 8 * n)):
            bitmap = -(-((size + 7) // 8) // 64) * 64
            self.levels.append((size, at, at + size, at + size + bitmap))
            at += size + bitmap + bitmap // 8
        self.tail = at
        self.n_tokens = self.levels[0][0]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends)."""
        n = self.n_docs * 8
        return np.frombuffer(self.read(self.tail, n), np.int64), np.frombuffer(self.read(self.tail + n, n), np.uint64).astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level."""
        _, _, bits, directory = self.levels[level]
        block = i // 512
        if block * 64 >= directory - bits:  # just past the last block
            block -= 1
        before = struct.unpack("<Q", self.read(directory + 8 * block, 8))[0]
        raw = np.frombuffer(self.read(bits + 64 * block, 64), np.uint8)
        return before + int(np.unpackbits(raw, bitorder="little")[: i - 512 * block].sum())

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (not included) of the file: one range of each level is read."""
        lo, hi, shift = start, stop, 0
        out = np.zeros(stop - start, np.uint32)
        places = np.arange(stop - start)
        for k, (_, chunks, bits, _) in enumerate(self.levels):
            if lo >= hi:
                break
            out[places] |= np.frombuffer(self.read(chunks + lo, hi - lo), np.uint8).astype(np.uint32) << np.uint32(shift)
            first = lo // 8
            raw = np.frombuffer(self.read(bits + first, (hi + 7) // 8 - first), np.uint8)
            goes_on = np.unpackbits(raw, bitorder="little")[lo - 8 * first: hi - 8 * first].astype(bool)
            places, shift = places[goes_on], shift + 8
            if not len(places):
                break
            lo = self._rank(k, lo)
            hi = lo + len(places)
        return out

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])


# ---- encoding --------------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    out, n = {}, 256
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            out[b] = chr(n)
            n += 1
    return out


class WordIds(dict):
    """Ids of a word between white space, as bytes; words seen before are kept.

    Most words are letters and closing marks. The tokenizer's splitter parts the two, so the
    letters go straight to its merge model and the marks are looked up; any other word takes
    the whole way through the tokenizer. Letters up to U+012F only: there lower-casing and
    composition go character by character in either language.
    """

    MARKS = ".,;:!?|"
    LETTERS = _byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.marks, self.stems, self.older = {}, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _letters(self, stem: str) -> bytes:
        """Ids of lower-case letters; of two generations of them the older goes when the younger is full."""
        out = self.stems.get(stem)
        if out is None:
            out = self.older.get(stem)
            if out is None:
                spelled = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.LETTERS)
                out = np.array([t.id for t in self.model.tokenize(spelled)], self.kind).tobytes()
            if len(self.stems) >= _CACHE_WORDS:
                self.older, self.stems = self.stems, {}
            self.stems[stem] = out
        return out

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(self.MARKS)
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0130"):
            out = self._letters(stem.lower())
            if len(stem) < len(word):
                marks = word[len(stem):]
                if marks not in self.marks:
                    self.marks[marks] = self.whole(marks)
                out += self.marks[marks]
        else:
            out = self.whole(word)
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = out
        return out


def _encoder(path: str) -> WordIds:
    """Kept over the tasks of a worker."""
    kept = sys.__dict__.setdefault("_token_encoders", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def encode_text(text: str, words: WordIds) -> bytes:
    """Ids as ``encode(text, add_special_tokens=False)`` gives them: the tokenizer drops white
    space and cuts there, so they are the words' ids one after the other."""
    if any(c in text for c in _ODD):
        return words.whole(text)
    return b"".join(map(words.__getitem__, text.split()))


def _encoded(batches, tokenizer: str, end_id: int):
    words = _encoder(tokenizer)
    last = np.array([end_id], words.kind).tobytes()
    for b in batches:
        yield b.column("id"), [encode_text(t or "", words) + last for t in b.column("text").to_pylist()], words.kind


def _id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers, the end id last."""

    def run(batches):
        for ids, tokens, kind in _encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([ids, pa.array([np.frombuffer(x, kind).astype("<u4").tobytes() for x in tokens], pa.binary())], ["id", "ids"])

    return common.map_arrow(_id_text(docs, id_col, text_col), run, "id bigint, ids binary")


# ---- writing and reading ---------------------------------------------------------------

def write_files(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id",
                text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write the files and return (file_no, path, n_docs, n_tokens, start): one row a file, in id order.

    files: the number of ranges; by default one for every shuffle partition, or more by the table's size.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # what has no known size (a plan that isn't read from files) counts as one of Spark's partitions
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // FILE_BYTES), 100_000) if size < 1 << 62 else 1)
    key = F.coalesce(F.col("id"), F.lit(_NULL))
    # bounds from the id column alone; one number for each file
    row = docs.select(F.col(id_col).cast("long").alias("id")).agg(
        F.percentile_approx(key, F.lit([i / n for i in range(1, n)]), 10000).alias("q")).first() if n > 1 else None
    # an id that stands for several bounds fills as many files
    bounds = np.sort(np.array((row and row["q"]) or [], np.int64))

    def deal(batches):
        for ids, tokens, kind in _encoded(batches, tokenizer, end_id):
            ids = ids.fill_null(_NULL)
            no = np.searchsorted(bounds, ids.to_numpy(), side="left")
            crc = np.array([zlib.crc32(t) for t in tokens], np.int64)
            no += crc * np.maximum(1, np.searchsorted(bounds, ids.to_numpy(), side="right") - no) >> 32
            yield pa.RecordBatch.from_arrays([pa.array(no.astype(np.int32)), ids, pa.array(tokens, pa.binary()), pa.array([kind.itemsize] * len(no), pa.int32()), pa.array(crc)],
                                             ["file_no", "id", "ids", "width", "crc"])

    dealt = common.map_arrow(_id_text(docs, id_col, text_col), deal, "file_no int, id bigint, ids binary, width int, crc bigint")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("file_no")).sortWithinPartitions("file_no", "id", "crc").drop("crc")

    def write(batches):
        file_no, parts = None, []

        def flush():
            ids = np.concatenate([p[0] for p in parts])
            lengths = np.concatenate([p[1] for p in parts])
            data = pack(ids, lengths, np.concatenate([p[2] for p in parts]))
            common.write_whole(folder, f"tokens-{file_no:06d}.dac", data)
            return pa.RecordBatch.from_arrays([pa.array([file_no], pa.int32()), pa.array([f"{folder}/tokens-{file_no:06d}.dac"]),
                                               pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())],
                                              ["file_no", "path", "n_docs", "n_tokens"])

        for b in batches:
            nos = b.column("file_no").to_numpy()
            cuts = np.append(np.append(0, np.flatnonzero(nos[1:] != nos[:-1]) + 1), len(nos)) if len(nos) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if file_no is not None and nos[lo] != file_no:
                    yield flush()
                    parts = []
                file_no = int(nos[lo])
                kind = np.dtype(f"<u{b.column('width')[lo].as_py()}")
                blobs = b.column("ids").slice(lo, hi - lo).to_pylist()
                parts.append((b.column("id").to_numpy()[lo:hi], np.array([len(x) // kind.itemsize for x in blobs], np.int64),
                              np.frombuffer(b"".join(blobs), kind)))
        if parts:
            yield flush()

    listed = dealt.mapInArrow(write, "file_no int, path string, n_docs bigint, n_tokens bigint")
    # one row a file; running it a second time would write the same bytes again
    listed = common.stored(spark, listed, "token-files")
    before, starts = 0, []
    for r in sorted(listed.select("file_no", "n_tokens").collect()):
        starts.append((r["file_no"], before))
        before += r["n_tokens"]
    return listed.join(F.broadcast(spark.createDataFrame(starts, "file_no int, start bigint")), "file_no")


def read_files(listed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids) for each document of the files that ``write_files`` listed."""

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                system, at = common.open_folder(path)
                with system.open_input_file(at) as f:
                    reader = Reader(lambda offset, size: f.read_at(size, offset))
                    ids, ends = reader.documents()
                    starts = np.append(0, ends[:-1])
                    for lo in range(0, len(ids), common.BATCH_ROWS):
                        hi = min(lo + common.BATCH_ROWS, len(ids))
                        tokens = reader.tokens(int(starts[lo]), int(ends[hi - 1]))
                        base = starts[lo]
                        blobs = [tokens[s - base:e - base].tobytes() for s, e in zip(starts[lo:hi], ends[lo:hi])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[lo:hi], mask=ids[lo:hi] == _NULL), pa.array(starts[lo:hi] + start),
                             pa.array((ends - starts)[lo:hi]), pa.array(blobs, pa.binary())], ["id", "start", "n_tokens", "ids"])

    n = max(1, listed.count())
    rows = listed.select("file_no", "path", "start").repartitionById(n, F.col("file_no") % n)
    return rows.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids binary").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """op6: write all documents' ids, read them back, give start, length and crc of each."""
    from urlscope.session import scratch_path
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    listed = write_files(spark, common.table(spark, sf_dir, "documents"), tokenizer, scratch_path(spark, "tokens"))
    return read_files(listed).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
