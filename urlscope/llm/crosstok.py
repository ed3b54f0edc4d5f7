"""Alignment of two tokenizers over the bytes of a text.

A text with a blank before it is spelled by tokenizer A (byte-level BPE, a ``tokenizers`` file) and by B (a SentencePiece
model, which adds the blank itself). Both are read, never trained.

1. Token-byte incidence in CSR: a row for each token, a column for each byte. A row of the product
   A . B^T, built up row by row in Gustavson's way (for each byte of an A token, the row of B^T at that byte is added), holds the B tokens
   that overlap the A token, with the bytes they share: the overlap links.
2. Where an A and a B token both end, a group ends. The product of the two token-group
   incidences holds the pairs that share a group: the shared-group links.
3. Neither tokenizer joins what is before a blank (or a line's end) to what stands behind it when a character other than white space
   comes before, so texts fall into units that are aligned once each, many in one product, and
   kept; a document is the sum of its units.
4. A document's linked pairs of ids are written, each once with its number of links. A pair's count is the number of
   documents that hold it, added up by Spark. Pairs with at least a share ``LEAST`` of all counts (at most 1 / LEAST pairs) go to the tasks; what a document holds of all other pairs is joined with the
   table of counts.

Defined cases: null and empty texts, and texts that A or B doesn't spell back byte for byte (such as one with
U+2581), have no tokens: all numbers are 0, and ``groups`` is empty. Rows are treated one by one, so repeated rows get equal results
and count as documents of their own, and null ids are kept. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Share of all counts from which on a pair goes to the tasks.
LEAST = 1e-6
#: Units that a worker keeps, and bits of an id.
_KEPT, _BITS = 400_000, 20
#: Characters of a text that are looked at in one go.
_SLICE = 2_000_000
#: Before a blank or line end that comes behind a character other than white space.
_CUT = re.compile(r"(?<=\S)(?= .|\n)", re.S)
_LINE = re.compile(r"(?<=\S)(?=\n)")
#: White space before a blank: there the text is no plain row of words.
_ODD = re.compile(r"[^\S ] ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def vocabularies() -> tuple[str, str]:
    """The public files of A and B."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- sparse products -------------------------------------------------------------------

class Csr:
    """A sparse matrix by rows: the columns and values of row i stand at indptr[i] to indptr[i + 1]."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, n_columns: int):
        self.indptr, self.indices, self.values, self.n_columns = indptr, indices, values, n_columns

    @classmethod
    def spans(cls, ends: np.ndarray) -> Csr:
        """Row i has a one at each of the columns from the row before's end to its own."""
        n = int(ends[-1]) if len(ends) else 0
        return cls(np.append(0, ends), np.arange(n), np.ones(n, np.int64), n)

    @classmethod
    def of(cls, column: np.ndarray, n_columns: int) -> Csr:
        """Row i has a one at column[i]."""
        return cls(np.arange(len(column) + 1), column, np.ones(len(column), np.int64), n_columns)

    def rows(self) -> np.ndarray:
        """The row of each value."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.append(0, np.cumsum(np.bincount(self.indices, minlength=self.n_columns)))
        return Csr(indptr, self.rows()[order], self.values[order], len(self.indptr) - 1)

    def times(self, other: Csr) -> Csr:
        """The product by rows: row i adds up the rows of ``other`` at the columns of row i, each times its value."""
        sizes = np.diff(other.indptr)[self.indices]
        n = int(sizes.sum())
        at = np.repeat(other.indptr[self.indices] - np.cumsum(sizes) + sizes, sizes) + np.arange(n)
        row, column = np.repeat(self.rows(), sizes), other.indices[at]
        value = np.repeat(self.values, sizes) * other.values[at]
        # the accumulator of a row: equal columns become one
        key = row * max(1, other.n_columns) + column
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:n])
        value = np.add.reduceat(value[order], first) if n else value
        row, column = row[order][first], column[order][first]
        return Csr(np.append(0, np.cumsum(np.bincount(row, minlength=len(self.indptr) - 1))), column, value, other.n_columns)


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[Csr, Csr, np.ndarray, np.ndarray]:
    """(overlap links with the bytes shared, shared-group links, group of each A token, of each B token)."""
    overlap = Csr.spans(ends_a).times(Csr.spans(ends_b).transposed())
    last = np.zeros((2, int(ends_a[-1]) + 1 if len(ends_a) else 1), bool)
    last[0, ends_a], last[1, ends_b] = True, True
    both = last[0] & last[1]
    cuts, before = np.flatnonzero(both), np.cumsum(both) - both
    of_a, of_b = before[ends_a], before[ends_b]
    shared = Csr.of(of_a, len(cuts)).times(Csr.of(of_b, len(cuts)).transposed())
    return overlap, shared, of_a, of_b


# ---- units -----------------------------------------------------------------------------

def units(text: str) -> list:
    """The units of " " + text: a string is a unit without the blank it begins with; bytes are one that begins with a line's end."""
    if "  " in text or text[0] == " " or text[-1] == " " or _ODD.search(text):
        return [u[1:] if u[0] == " " else u.encode() for u in _CUT.split(" " + text)]
    out = text.split(" ")
    if "\n" in text:
        out = [x for u in out for x in (_lines(u) if "\n" in u else (u,))]
    return out


def _lines(unit: str) -> list:
    first, *rest = _LINE.split(unit)
    # the unit may begin with the line's end itself, behind its blank
    return [first, *(u.encode() for u in rest)]


def _slices(text: str):
    """The units of a text, some MB of it at a time."""
    while len(text) > _SLICE:
        cut = _CUT.search(text, _SLICE)
        # the blank that a slice begins with is put before it again
        if cut is None or text[cut.start()] != " ":
            break
        yield units(text[:cut.start()])
        text = text[cut.start() + 1:]
    yield units(text)


class Aligner:
    """Units aligned once each and kept, the more frequent ones longer."""

    #: Numbers of a unit: tokens of A and B, groups, overlap links, shared-group links, 1 if it isn't spelled back.
    FACTS = 6

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        letters = {c: b for b, c in _letters().items()}
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            # an added token's string needn't be in the byte alphabet; in texts it is never one token
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            one = _BYTE.fullmatch(piece) if self.b.is_byte(i) else None
            self.bytes_b.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << _BITS:
            raise ValueError(f"ids of at most {_BITS} bits are asked for")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.number, self.texts, self.facts, self.uses = {}, [], np.zeros((0, self.FACTS), np.int64), np.zeros(0, np.int64)
        self.indptr, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def spelled(self, keys: list) -> tuple[list[bytes], list, list]:
        """(bytes, ids of A, ids of B) of each unit; a unit that isn't spelled back has no ids."""
        whole = [" " + k if isinstance(k, str) else k.decode() for k in keys]
        ids_a = [e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        # what has no blank of its own goes behind a line's end, which joins nothing: its piece and the blank's go again
        ids_b = self.b.encode([k if isinstance(k, str) else "\n" + k.decode() for k in keys], num_threads=1)
        ids_b = [ids if isinstance(k, str) else ids[2:] for k, ids in zip(keys, ids_b)]
        raw = [x.encode() for x in whole]
        for table, sizes, ids in ((self.bytes_a, self.sizes_a, ids_a), (self.bytes_b, self.sizes_b, ids_b)):
            # all units at once; one by one only if that isn't the same
            flat = list(chain.from_iterable(ids))
            if b"".join(map(table.__getitem__, flat)) == b"".join(raw):
                ends = np.append(0, np.cumsum(sizes[flat], dtype=np.int64))[np.cumsum([len(x) for x in ids], dtype=np.int64)]
                if (ends == np.cumsum([len(x) for x in raw])).all():
                    continue
            for n, x in enumerate(raw):
                if b"".join(map(table.__getitem__, ids[n])) != x:
                    ids_a[n] = ids_b[n] = []
        return raw, ids_a, ids_b

    def add(self, keys: list) -> None:
        """Align units that aren't kept yet, all in one product."""
        _, ids_a, ids_b = self.spelled(keys)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(keys)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        overlap, shared, of_a, of_b = aligned(np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b]))
        unit_a = np.repeat(np.arange(len(keys)), n_a)
        # a unit ends with a group, so no group is in two
        n_groups = np.bincount(unit_a[np.append(True, of_a[1:] != of_a[:-1])[:len(of_a)]], minlength=len(keys))
        row = overlap.rows()
        n_links = np.bincount(unit_a[row], minlength=len(keys))
        n_shared = np.bincount(unit_a[shared.rows()], minlength=len(keys))
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n_groups, n_links, n_shared, n_a == 0], 1)])
        self.links = np.concatenate([self.links, (flat_a[row] << _BITS) | flat_b[overlap.indices]])
        self.indptr = np.concatenate([self.indptr, self.indptr[-1] + np.cumsum(n_links)])
        self.uses = np.append(self.uses, np.zeros(len(keys), np.int64))
        groups = list(map("|".join, zip(_group_texts(flat_a, of_a), _group_texts(flat_b, of_b))))
        at = np.append(0, np.cumsum(n_groups)).tolist()
        self.texts += [groups[lo] if hi - lo == 1 else ";".join(groups[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys))))

    def drop(self) -> None:
        """Keep the most frequent third of what may be kept."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:_KEPT // 3])
        names, sizes = list(self.number), np.diff(self.indptr)[keep]
        at = np.repeat(self.indptr[keep] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        self.links, self.indptr = self.links[at], np.append(0, np.cumsum(sizes))
        self.facts, self.uses = self.facts[keep], self.uses[keep] // 2
        self.texts = [self.texts[i] for i in keep.tolist()]
        self.number = {names[i]: n for n, i in enumerate(keep.tolist())}

    def take(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the units of all texts, number of units of each text); they hold until the next call."""
        found = [list(chain.from_iterable(_slices(t))) if t else [] for t in texts]
        need = set().union(*found)
        new = need.difference(self.number)
        if len(self.number) + len(new) > _KEPT and self.number:
            self.drop()
            new = need.difference(self.number)
        if new:
            self.add(list(new))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        return numbers, sizes

    def linked(self, unit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, pair of ids) of every link of the units."""
        sizes = np.diff(self.indptr)[unit]
        at = np.repeat(self.indptr[unit] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return np.repeat(owner, sizes), self.links[at]


def _group_texts(ids: np.ndarray, group: np.ndarray) -> list[str]:
    """The ids of each group, comma-joined."""
    words = list(map(str, ids.tolist()))
    at = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)]), len(words)).tolist()
    return [words[lo] if hi - lo == 1 else ",".join(words[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]


def _letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    out, n = {}, 256
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            out[b], n = chr(n), n + 1
        else:
            out[b] = chr(b)
    return out


def aligner(file_a: str, file_b: str) -> Aligner:
    """Kept over the tasks of a worker."""
    kept = sys.__dict__.setdefault("_token_aligners", {})
    if (file_a, file_b) not in kept:
        kept[file_a, file_b] = Aligner(file_a, file_b)
    return kept[file_a, file_b]


def _texts(batch) -> list:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def _parts(batch):
    """A batch in parts of some MB of text, of at least one row."""
    column = batch.column(batch.schema.get_field_index("text"))
    sizes = np.array([len(x or "") for x in column.to_pylist()], np.int64)
    part = (np.cumsum(sizes) - sizes) // _SLICE
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)]), len(part))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(lo, hi - lo)


# ---- DataFrame operators ---------------------------------------------------------------

def alignments(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, a, b, groups, links, shared) for every row: the ids of A and B; for each group the numbers of its first A and B
    token; and the overlap and shared-group links as pairs of token numbers, with the bytes that an overlap has."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tool = aligner(file_a, file_b)
        for b in batches:
            out = []
            for t in _texts(b):
                _, (x,), (y,) = tool.spelled([t]) if t else ([b""], [[]], [[]])
                overlap, shared, of_a, of_b = aligned(np.cumsum(tool.sizes_a[x], dtype=np.int64), np.cumsum(tool.sizes_b[y], dtype=np.int64))
                firsts = [np.flatnonzero(np.append(True, g[1:] != g[:-1])[:len(g)]).tolist() for g in (of_a, of_b)]
                out.append((x, y, [{"a": i, "b": j} for i, j in zip(*firsts)],
                            [{"a": i, "b": j, "bytes": n} for i, j, n in zip(overlap.rows().tolist(), overlap.indices.tolist(), overlap.values.tolist())],
                            [{"a": i, "b": j} for i, j in zip(shared.rows().tolist(), shared.indices.tolist())]))
            pair = [("a", pa.int32()), ("b", pa.int32())]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct(pair)), pa.list_(pa.struct([*pair, ("bytes", pa.int32())])), pa.list_(pa.struct(pair)))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))],
                                             [id_col, "a", "b", "groups", "links", "shared"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, f"`{id_col}` {kind}, a array<int>, b array<int>, groups array<struct<a:int,b:int>>, "
                                       "links array<struct<a:int,b:int,bytes:int>>, shared array<struct<a:int,b:int>>")


def linked_documents(spark: SparkSession, docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, times) for every row: the pairs of ids linked in it,
    each once as a << 20 | b, and how many links a pair has. Texts are spelled and aligned here, once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        tool, row = aligner(file_a, file_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in _parts(batch):
                number, sizes = tool.take(_texts(b))
                n, ends = len(sizes), np.cumsum(sizes)
                doc, total, full = np.repeat(np.arange(n), sizes), np.zeros((n, tool.FACTS), np.int64), np.flatnonzero(sizes)
                if len(full):
                    total[full] = np.add.reduceat(tool.facts[number], (ends - sizes)[full])
                good = (sizes > 0) & (total[:, 5] == 0)
                total[~good] = 0
                digests = [hashlib.sha256(";".join(map(tool.texts.__getitem__, number[hi - k:hi].tolist())).encode()).hexdigest() if ok else ""
                           for ok, k, hi in zip(good.tolist(), sizes.tolist(), ends.tolist())]
                owner, pair = tool.linked(number[good[doc]], doc[good[doc]])
                packed, times = np.unique(owner << 2 * _BITS | pair, return_counts=True)
                at = pa.array(np.searchsorted(packed >> 2 * _BITS, np.arange(n + 1)).astype(np.int32))
                pairs = pa.ListArray.from_arrays(at, pa.array(packed & (1 << 2 * _BITS) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), b.column("id"), *(pa.array(total[:, k]) for k in range(5)), pa.array(digests, pa.string()),
                                                  pairs, pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                                                 ["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times"])
                row += n

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.stored(spark, common.map_arrow(rows, run, f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, "
                                                            "groups_sha256 string, pairs array<bigint>, times array<int>"), "linked")


def pair_counts(spark: SparkSession, linked: DataFrame) -> DataFrame:
    """(pair, c): in how many documents each pair of ids is linked."""
    return common.stored(spark, linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("c")), "pairs")


def summaries(spark: SparkSession, docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256) for every row."""
    linked = linked_documents(spark, docs, file_a, file_b, id_col, text_col)
    counts = pair_counts(spark, linked)
    # at most a row for each id of A's vocabulary
    best = counts.groupBy(F.shiftright("pair", _BITS).alias("a")).agg(F.max("c").alias("top"))
    counts = common.stored(spark, counts.withColumn("a", F.shiftright("pair", _BITS)).join(F.broadcast(best), "a").select("pair", "c", (F.col("c") == F.col("top")).alias("best")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # at most 1 / least pairs
    hot = counts.where(F.col("c") >= least * total).toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    sent = spark.sparkContext.broadcast(tuple(hot[c].to_numpy()[order] for c in ("pair", "c", "best")))

    def run(batches):
        keys, c, best = sent.value
        for b in batches:
            n, lists = b.num_rows, b.column("pairs")
            pair, times = lists.flatten().to_numpy(), b.column("times").flatten().to_numpy().astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(n), sizes)
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            # 64-bit sums throughout
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], doc[hit], (times * best[at])[hit] if len(keys) else 0)
            np.add.at(sums[1], doc[hit], (times * c[at])[hit] if len(keys) else 0)
            ends = pa.array(np.searchsorted(doc[~hit], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(sums[0]), pa.array(sums[1]), *(pa.ListArray.from_arrays(ends, pa.array(x[~hit])) for x in (pair, times))],
                                             [*names, "n_best", "count_sum", "rare", "times"])

    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256"]
    schema = ", ".join(f"{k} {linked.schema[k].dataType.simpleString()}" for k in names)
    parts = common.stored(spark, common.map_arrow(linked, run, f"{schema}, n_best bigint, count_sum bigint, rare array<bigint>, times array<bigint>"), "parts")
    each = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    zero = F.lit(0).cast("long")
    more = (each.join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(zero)).alias("more_best"), F.sum(F.col("c") * F.col("times")).alias("more_count")))
    return parts.join(more, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_shared",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more_count", zero)).alias("count_sum"), "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: byte-level BPE against SentencePiece over all documents."""
    out = summaries(spark, common.table(spark, sf_dir, "documents"), *vocabularies())
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
