"""Repeated byte strings by the interval tree of a sparse enhanced suffix array.

A string of ``length`` bytes holds ``length - GRAM + 1`` grams of ``GRAM`` bytes; the leftmost one with the
least hash is its anchor. Equal strings have the same anchor at the same place, so the suffixes
that begin at anchors (one byte in sixty or so) are all the suffix array needs:

1. Every anchor gives its gram's hash (the bucket), the hash of its surroundings (all bytes that a
   string anchored here can reach) and its place. Buckets of one anchor go at once; equal
   surroundings are one entry from here on, however many copies there are.
2. The surroundings of the entries that are left are fetched. In a bucket, the suffixes are sorted and the
   common prefixes of neighbours computed; a stack scan gives the common-prefix intervals.
3. The members of an interval agree on ``lcp`` bytes from the anchor on. They are split by what stands
   before: those that agree on at least ``length - lcp`` bytes there form a maximal repeat, longer on the left by
   all they have in common, and ended where bytes differ on either side (left-extension
   diversity; on the right, the interval is what ends it). All members are its occurrences.
4. Occurrences become spans of documents; overlapping spans are merged.

Repeats longer than what an anchor reaches are found piece by piece, each at its own anchor, and merged
in step 4; so the spans are exact for any length, while a group of ``repeats`` ends at the reach.

A bucket of over ``HOT`` different surroundings isn't brought together in a task: its strings of
``length`` bytes are hashed and counted by Spark instead (128 bits), which finds the same spans. Its groups are
the repeated strings of ``length`` bytes, each with all its occurrences, not joined to longer ones.

Defined cases: null text counts as empty; texts shorter than ``length`` have no spans. Rows
of equal id and text are separate documents, each a repeat of the other. Equal ids with
different texts are kept apart. Null ids are allowed. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import common

LENGTH = 200
GRAM = 80
HOT = 20_000
#: Rows of sorted anchors that are looked at together.
PIECE = 100_000
_SEGMENT = 500_000
_PART = 500_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SCHEMA = "key bigint, ctx bigint, doc_id bigint, h bigint, place bigint, until bigint"


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done:2 * done] = out[:min(done, n - done)] * step
        done *= 2
    return out


class _Hashes:
    """Hashes of any substring of a buffer."""

    def __init__(self, raw: np.ndarray, base: int):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.back[lo])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by running minima of blocks from both sides."""
    n = len(x) - w + 1
    padded = np.append(x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    right = np.minimum.accumulate(padded, axis=1).ravel()
    left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1:w - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, position, key, hash of the surroundings, bytes of these on the right)."""
    window = length - gram + 1
    parts = []
    for i, t in enumerate(texts):
        n = len(t)
        for lo in range(0, max(0, n - length + 1), _SEGMENT):
            hi = min(lo + _SEGMENT, n - length + 1)  # string starts of this segment
            begin, end = max(0, lo - window), min(n, hi + 2 * length)
            parts.append((i, begin, lo - begin, hi - begin, t[begin:end], n))
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    sizes = np.array([len(p[4]) for p in parts], np.int64)
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join([p[4] for p in parts]), np.uint8)
    first = _Hashes(raw, _BASES[0])
    grams = first.all(gram)
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = (_sliding_least(ranked, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(least) + 1, np.int32)
    np.add.at(valid, at + [p[2] for p in parts], 1)
    np.add.at(valid, at + [p[3] for p in parts], -1)
    where = least[np.cumsum(valid)[:-1] > 0]
    where = np.unique(where)
    part = np.searchsorted(at, where, side="right") - 1
    text = np.array([p[0] for p in parts], np.int64)[part]
    pos = where - at[part] + np.array([p[1] for p in parts], np.int64)[part]
    left = np.minimum(pos, window - 1)
    right = np.minimum(np.array([p[5] for p in parts], np.int64)[part] - pos, length)
    ctx = _mix(_Hashes(raw, _BASES[1]).of(where - left, where + right) + (left * 1024 + right).astype(np.uint64) * np.uint64(_BASES[0]))
    # near a cut an anchor is found in both segments of a text
    keep = np.unique(text << 40 | pos, return_index=True)[1]
    return text[keep], pos[keep], grams[where[keep]], ctx[keep], right[keep]


def _collapsed(text, pos, key, ctx, right, window: int):
    """(rows to keep, (text, start, end) of merged spans): anchors with equal surroundings are repeats of each
    other whatever else there is; one of them goes on, their spans are known."""
    if not len(key):
        return np.zeros(0, np.int64), (text, pos, pos)
    order = np.lexsort((pos, text, ctx, key))
    k, c = key[order], ctx[order]
    same = np.append(False, (k[1:] == k[:-1]) & (c[1:] == c[:-1]))
    twice = order[same | np.append(same[1:], False)]
    twice = twice[np.lexsort((pos[twice], text[twice]))]
    start, end, t = pos[twice] - np.minimum(pos[twice], window - 1), pos[twice] + right[twice], text[twice]
    keep = np.sort(order[~same])
    if not len(t):
        return keep, (t, start, end)
    reach = np.maximum.accumulate(t << 40 | end)
    new = np.append(True, (t[1:] << 40 | start[1:]) > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(t)) - 1
    return keep, (t[new], start[new], reach[last] & ((1 << 40) - 1))


def _parts(texts: list):
    """(first, beyond) of runs of texts of some MB."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > _PART or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def _lcp(rows: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the rows a and b of a padded matrix."""
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 8192):
        x, y = a[lo:lo + 8192], b[lo:lo + 8192]
        differ = rows[x] != rows[y]
        first = differ.argmax(1)
        out[lo:lo + 8192] = np.where(differ.any(1), first, rows.shape[1])
    return np.minimum(out, np.minimum(sizes[a], sizes[b]))


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(len(strings), width), sizes


def intervals(lcp: list[int]):
    """(common prefix, first, last) of every common-prefix interval; lcp[i] is that of rows i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        begin = i - 1
        while stack[-1][0] > now:
            size, begin = stack.pop()
            yield size, begin, i - 1
        if stack[-1][0] < now:
            stack.append((now, begin))


def scan(keys: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH, gram: int = GRAM, groups: list | None = None):
    """(bytes before, bytes behind) that repeats cover around each row's anchor, zeros where there is none.

    Rows are sorted by (key, right); lefts are reversed. groups gets (rows, bytes before, bytes behind) of every maximal repeat.
    """
    n, window = len(keys), length - gram + 1
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return before, behind
    right, right_size = _matrix(rights, length)
    left, left_size = _matrix(lefts, window)
    rows = np.arange(n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(keys[1:] == keys[:-1], _lcp(right, right_size, rows[:-1], rows[1:]), 0)
    same_left = np.zeros(n, np.int64)
    same_left[1:] = _lcp(left, left_size, rows[:-1], rows[1:])
    found = [x for x in intervals(lcp.tolist()) if x[0] >= gram]
    size, lo, hi = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def cover(members, l, r):
        np.maximum.at(before, members, l)
        np.maximum.at(behind, members, r)

    pair = hi - lo == 1
    good = pair & (size + same_left[hi] >= length)
    for end in (lo[good], hi[good]):
        cover(end, same_left[hi[good]], size[good])
    if groups is not None:
        groups.extend((np.array([a, b]), int(same_left[b]), int(s)) for s, a, b in zip(size[good], lo[good], hi[good]))
    for s, a, b in zip(size[~pair].tolist(), lo[~pair].tolist(), hi[~pair].tolist()):
        members = np.array(sorted(range(a, b + 1), key=lefts.__getitem__))
        common_left = _lcp(left, left_size, members[:-1], members[1:])
        agree = common_left >= length - s
        if not agree.any():
            continue
        most = np.zeros(len(members), np.int64)
        most[:-1] = np.where(agree, common_left, -1)
        most[-1] = -1
        most[1:] = np.maximum(most[1:], np.where(agree, common_left, -1))
        cover(members[most >= 0], most[most >= 0], s)
        if groups is not None:
            cuts = np.flatnonzero(~agree) + 1
            for x in np.split(np.arange(len(members)), cuts):
                if len(x) > 1:
                    groups.append((members[x], int(common_left[x[:-1]].min()), s))
    return before, behind


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, text): h is the text's 64-bit hash, which keeps texts of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


class Repeats:
    """Repeats of at least ``length`` bytes in the texts of a table.

    entries: (key, ctx, doc_id, h, place, until, copies, lead) one row for each anchor that isn't alone in its bucket.
    place holds position << 8 | bytes on the right. Before the shuffle, equal surroundings within a batch
    become one row, and rows with ``until`` hold the spans known from that: neither many copies nor a text
    that repeats one word brings more than a row a batch to its bucket. occurrences: every anchor keeps a row,
    which ``groups`` needs.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                 occurrences: bool = False):
        if not 0 < gram < length < 256:
            raise ValueError("0 < gram < length < 256 is asked for")
        self.spark, self.length, self.gram, self.hot, self.window = spark, length, gram, hot, length - gram + 1
        self.occurrences = occurrences
        self.docs = _documents(docs, id_col, text_col)
        self.entries = common.stored(spark, self._entries(), "anchors")
        self.spans = self._spans()

    def _entries(self) -> DataFrame:
        length, gram, occurrences, window = self.length, self.gram, self.occurrences, self.window

        def rows(ids, h, text, pos, right, key, ctx, until):
            place = pos << 8 | right
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), ids.take(pa.array(text)), pa.array(h[text]), pa.array(place), until],
                                              ["key", "ctx", "doc_id", "h", "place", "until"])

        def find(batches):
            for b in batches:
                texts = common.utf8_lists(b, "text")
                ids, h = b.column("doc_id"), b.column("h").to_numpy()
                for lo, hi in _parts(texts):
                    text, pos, key, ctx, right = anchors(texts[lo:hi], length, gram)
                    text = text + lo
                    if not occurrences:
                        keep, (t, start, end) = _collapsed(text, pos, key, ctx, right, window)
                        # dealt out by place, as they meet nobody
                        yield rows(ids, h, t, start, np.zeros_like(t), _mix((t << 32 | start).astype(np.uint64)), np.zeros(len(t), np.uint64), pa.array(end))
                        text, pos, key, ctx, right = (x[keep] for x in (text, pos, key, ctx, right))
                    yield rows(ids, h, text, pos, right, key, ctx, pa.nulls(len(text), pa.int64()))

        def shared(batches):
            """Rows of keys that have more than one, in pieces of some ``PIECE`` rows; a piece knows the rows beside it."""
            held, before = None, None
            for b in batches:
                t = pa.Table.from_batches([b])
                known = t.filter(pc.is_valid(t["until"]))
                if len(known):
                    no = pa.array(np.zeros(len(known), bool))
                    yield from known.append_column("copies", no).append_column("lead", no).combine_chunks().to_batches()
                t = t.filter(pc.is_null(t["until"]))
                held = t if held is None else pa.concat_tables([held, t])
                if len(held) > PIECE:
                    last = len(held) - 1
                    behind = (held["key"][last].as_py(), held["ctx"][last].as_py())
                    yield from sift(held.slice(0, last), before, behind)
                    before = (held["key"][last - 1].as_py(), held["ctx"][last - 1].as_py())
                    held = held.slice(last)
            if held is not None and len(held):
                yield from sift(held, before, None)

        def sift(t, before, behind):
            """before, behind: (key, ctx) of the row before and behind the piece."""
            key, ctx = t["key"].to_numpy(), t["ctx"].to_numpy()
            goes_on = before is not None and before[0] == key[0]
            comes = behind is not None and behind[0] == key[-1]
            new_key = np.append(True, key[1:] != key[:-1])
            new = new_key | np.append(True, ctx[1:] != ctx[:-1])
            of_key, of_ctx = np.cumsum(new_key) - 1, np.cumsum(new) - 1
            rows, kinds, copies = np.bincount(of_key), np.bincount(of_key, new).astype(np.int64), np.bincount(of_ctx)
            if goes_on:
                rows[0] += 1
                same = before[1] == ctx[0]
                copies[0] += same
                kinds[0] += not same
                new[0] = not same
            if comes:
                rows[-1] += 1
                copies[-1] += behind[1] == ctx[-1]
                kinds[-1] += 1  # it may have others
            keep = rows[of_key] > 1
            out = t.filter(pa.array(keep))
            out = out.append_column("copies", pa.array((copies[of_ctx] > 1)[keep]))
            # the first row of each surroundings stands for it, where there are different ones
            out = out.append_column("lead", pa.array((new & (kinds[of_key] > 1))[keep]))
            yield from out.combine_chunks().to_batches()

        raw = common.map_arrow(self.docs, find, _SCHEMA)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        dealt = raw.repartition(n, "key").sortWithinPartitions("key", "ctx")
        return dealt.mapInArrow(shared, _SCHEMA + ", copies boolean, lead boolean")

    def _leads(self) -> DataFrame:
        """(key, ctx, left, right): the surroundings of the entries that have to be compared; left is reversed."""
        window, length = self.window, self.length
        # the least place of a pair stands for it: leads of a very long run may come in pieces
        leads = (self.entries.where("lead").groupBy("key", "ctx").agg(F.min(F.struct("doc_id", "h", "place")).alias("x"))
                 .select("key", "ctx", F.col("x.doc_id").alias("id"), F.col("x.h").alias("g"), F.col("x.place").alias("place")))
        wanted = (leads.groupBy("id", "g")
                  .agg(F.collect_list(F.struct("key", "ctx", "place")).alias("wanted")))
        rows = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))).select("doc_id", "h", "text", "wanted")

        def cut(batches):
            for b in batches:
                out = []
                for t, wanted in zip(common.utf8_lists(b, "text"), b.column("wanted").to_pylist()):
                    for w in wanted:
                        pos, right = w["place"] >> 8, w["place"] & 255
                        out.append((w["key"], w["ctx"], t[max(0, pos - window + 1):pos][::-1], t[pos:pos + right]))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                                 ["key", "ctx", "left", "right"])

        return common.map_arrow(rows, cut, "key bigint, ctx bigint, left binary, right binary")

    def _hot_keys(self) -> DataFrame:
        return self.entries.where("lead").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > self.hot).select("key")

    def _scanned(self, groups: bool = False) -> DataFrame:
        """(key, ctx, before, behind) of the compared entries that repeats cover; groups: one row for each
        member of each maximal repeat, with the repeat's number."""
        length, gram = self.length, self.gram

        def run(batches):
            held = None
            for b in batches:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
                key = held["key"].to_numpy()
                if not len(key) or key[0] == key[-1]:
                    continue
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
                yield from work(held.slice(0, cut))
                held = held.slice(cut)
            if held is not None and len(held):
                yield from work(held)

        def work(t):
            key, ctx = t["key"].to_numpy(), t["ctx"].to_numpy()
            found = [] if groups else None
            before, behind = scan(key, t["left"].to_pylist(), t["right"].to_pylist(), length, gram, found)
            if groups:
                rows = np.concatenate([m for m, _, _ in found]) if found else np.zeros(0, np.int64)
                sizes = [len(m) for m, _, _ in found]
                before = np.repeat(np.array([l for _, l, _ in found], np.int64), sizes)
                behind = np.repeat(np.array([r for _, _, r in found], np.int64), sizes)
                # a repeat's number: its first member's key and ctx with its extent, the same in every run of the task
                number = _mix(np.repeat(np.array([ctx[m].min() for m, _, _ in found], np.int64), sizes).view(np.uint64) ^ key[rows].view(np.uint64)
                              ^ (before * 1024 + behind).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[rows], ctx[rows], before, behind, number)], ["key", "ctx", "before", "behind", "number"])
                return
            rows = np.flatnonzero(behind > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (key, ctx, before, behind)], ["key", "ctx", "before", "behind"])

        rows = self._surroundings()
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.join(self._hot_table, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key", "right", "left")
        return dealt.mapInArrow(run, "key bigint, ctx bigint, before bigint, behind bigint" + ", number bigint" * groups)

    def _surroundings(self) -> DataFrame:
        if not hasattr(self, "_stored_surroundings"):
            self._hot_table = common.stored(self.spark, self._hot_keys(), "hot")
            self._stored_surroundings = common.stored(self.spark, self._leads(), "surroundings")
        return self._stored_surroundings

    def _strings(self) -> DataFrame:
        """(a, b, key, ctx, before): the repeated strings of the buckets that are too large to be brought together, by their hashes."""
        if hasattr(self, "_stored_strings"):
            return self._stored_strings
        length = self.length

        def strings(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 200):
                    part = b.slice(lo, 200)
                    out = []
                    lefts, rights = part.column("left").to_pylist(), part.column("right").to_pylist()
                    texts = [x[::-1] + y for x, y in zip(lefts, rights)]
                    sizes = np.array([len(t) for t in texts], np.int64)
                    at = np.cumsum(sizes) - sizes
                    raw = np.frombuffer(b"".join(texts), np.uint8)
                    row = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - length + 1))
                    step = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1), np.maximum(0, sizes - length + 1))
                    begin = at[row] + step
                    before = np.array([len(x) for x in lefts], np.int64)[row] - step
                    ok = before >= 0
                    row, begin, before = row[ok], begin[ok], before[ok]
                    out = [_Hashes(raw, base).of(begin, begin + length).view(np.int64) for base in _BASES]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), part.column("key").take(pa.array(row)),
                                                      part.column("ctx").take(pa.array(row)), pa.array(before)], ["a", "b", "key", "ctx", "before"])

        rows = self._surroundings().join(self._hot_table, "key", "left_semi")
        each = common.stored(self.spark, common.map_arrow(rows, strings, "a bigint, b bigint, key bigint, ctx bigint, before bigint"), "strings")
        # by anchor too: one place is not counted once for each anchor within reach
        same = ["a", "b", "key", "before"]
        again = each.groupBy(*same).count().where("count > 1").select(*same)
        self._stored_strings = common.stored(self.spark, each.join(again, same, "left_semi"), "repeated")
        return self._stored_strings

    def _counted(self) -> DataFrame:
        """(key, ctx, before, behind) for those buckets."""
        return self._strings().groupBy("key", "ctx").agg(F.max("before").alias("before"), (F.lit(self.length) - F.min("before")).alias("behind"))

    def _spans(self) -> DataFrame:
        """(doc_id, h, start, end) of all repeats, not merged."""
        place = F.col("place")
        pos, right = F.shiftright(place, 8), place.bitwiseAND(F.lit(255))
        rows = self.entries.select("key", "ctx", "doc_id", "h", pos.alias("pos"), right.alias("right"), "until", "copies")
        known = rows.where("until is not null").select("doc_id", "h", F.col("pos").alias("start"), F.col("until").alias("end"))
        rows = rows.where("until is null").drop("until")
        left = F.least("pos", F.lit(self.window - 1))
        # copies of whole surroundings need no comparison
        whole = rows.where(F.col("copies") & (left + F.col("right") >= self.length)).select("doc_id", "h", (F.col("pos") - left).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
        found = self._scanned()
        if self._hot_table.limit(1).count():
            found = found.unionByName(self._counted())
        part = (rows.join(found, ["key", "ctx"]).select("doc_id", "h", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("behind")).alias("end")))
        return whole.unionByName(part).unionByName(known)

    def groups(self) -> DataFrame:
        """(number, doc_id, h, start, length): every maximal repeat within an anchor's reach with all its occurrences; copies of
        whole surroundings are a repeat of their own, and in buckets of over ``hot`` surroundings every repeated string of
        ``length`` bytes is."""
        if not self.occurrences:
            raise ValueError("occurrences=True is asked for")
        rows = self.entries.select("key", "ctx", "doc_id", "h", F.shiftright("place", 8).alias("pos"), F.col("place").bitwiseAND(F.lit(255)).alias("right"), "copies")
        left = F.least("pos", F.lit(self.window - 1))
        whole = rows.where(F.col("copies") & (left + F.col("right") >= self.length)).select(
            F.xxhash64("key", "ctx").alias("number"), "doc_id", "h", (F.col("pos") - left).alias("start"), (left + F.col("right")).alias("length"))
        found = self._scanned(groups=True).select("key", "ctx", "before", "behind", "number")
        if self._hot_table.limit(1).count():
            found = found.unionByName(self._strings().select("key", "ctx", "before", (F.lit(self.length) - F.col("before")).alias("behind"), F.xxhash64("a", "b").alias("number")))
        part = rows.join(found, ["key", "ctx"]).select(
            "number", "doc_id", "h", (F.col("pos") - F.col("before")).alias("start"), (F.col("before") + F.col("behind")).alias("length"))
        return whole.unionByName(part)

    def removed(self, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
        """``rows`` (those of the constructor, with any columns) and n_bytes, n_removed, n_spans, kept (binary).

        characters: a character goes only if all its bytes do, so that ``kept`` stays text.
        """
        names = ["n_bytes", "n_removed", "n_spans", "kept"]
        own = [c for c in rows.columns if c not in names or c in (id_col, text_col)]
        spans = self.spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        spans = spans.select(F.col("doc_id").alias("span_id"), F.col("h").alias("span_h"), "spans")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        packed = rows.select(F.struct(*own).alias("row"), F.col(id_col).cast("long").alias("one"), F.xxhash64(text).alias("two"), text.alias("text"))
        joined = packed.join(spans, F.col("one").eqNullSafe(F.col("span_id")) & (F.col("two") == F.col("span_h")), "left").select("row", "text", "spans")

        def run(batches):
            for b in batches:
                out = [_cut(t, s, characters) for t, s in zip(common.utf8_lists(b, "text"), b.column("spans").to_pylist())]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], ["row", *names])

        schema = StructType([joined.schema["row"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
        return common.map_arrow(joined, run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in own], *names)


def _cut(text: bytes, spans: list | None, characters: bool) -> tuple[int, int, int, bytes]:
    if not spans:
        return len(text), 0, 0, text
    merged = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    if characters:
        for m in merged:
            while m[0] < m[1] and text[m[0]] & 0xC0 == 0x80:
                m[0] += 1
            while m[1] > m[0] and m[1] < len(text) and text[m[1]] & 0xC0 == 0x80:
                m[1] -= 1
        merged = [m for m in merged if m[0] < m[1]]
    kept, last = [], 0
    for s, e in merged:
        kept.append(text[last:s])
        last = e
    kept = b"".join([*kept, text[last:]])
    return len(text), len(text) - len(kept), len(merged), kept


def query(spark, sf_dir: str) -> DataFrame:
    """op4: repeats of 200 bytes over all documents; the digest is that of the bytes that are left."""
    docs = common.table(spark, sf_dir, "documents")
    out = Repeats(spark, docs).removed(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
