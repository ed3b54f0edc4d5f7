"""N-gram Jaccard join: which documents share enough of their word shingles.

1. Every text becomes a set of hashed shingles; equal sets are one from here on. Texts are written in pieces of some MB.
2. Shingle frequencies over all documents: the pieces' sorted codes go to the tasks of their ranges of hashes, which add up and
   send the frequencies back, in the order in which they were asked.
3. Rare-first prefixes: a set's shingles are ordered by (frequency, hash). Two sets that are alike enough share one of their first
   n - ceil(t n) + 1 shingles, so prefix shingles are what sets are joined on. A shingle of one document joins nothing, and a set whose
   prefix has no others is alone.
4. A pair that meets at a prefix shingle goes on if its lengths, its positions there and its suffixes allow enough shared
   shingles: the suffixes are cut at fixed pivots of the hash, and the differences of the parts' sizes bound their distance. The first
   shared shingle of a pair lies in both prefixes, so each alike pair passes there.
   Before a pair is written, the whole sets are held against each other too: each set's parities over 1024 parts, in a bit each,
   bound the distance from below.
5. Every set is verified against one set that leads its buckets, which joins the bulk of any large group of near copies. Then, in rounds, it is
   against the one of another component that its parities are nearest to, until no link comes of it. At last all pairs of a bucket
   that lie in different components and weren't verified yet are, each once. Members of one component need no links between
   themselves, so no group brings all its pairs. Large buckets are cut into chunks, large verifying groups are salted.
6. Components over the links give every document the smallest id that it reaches.

Shingles are 64-bit hashes: a wrong answer needs two shingles of one pair to collide. Sets are told apart by 128 bits.

Defined cases: null and word-less texts have an empty set, linked with nothing. A text of fewer words than a shingle
is one shingle. Rows are documents of their own, whatever their id; a component of null ids only is null, as is that of a null id
without links. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .components import components
from .packed import pack, read_whole, runs, spread, squeeze, unpack

SHINGLE, PERCENT = 5, 80
#: Bytes of text that are asked for as one piece, and codes of a range of hashes that are counted together, up to ``LARGE`` bytes of text. From there on
#: both grow with the root of the input, so that what passes between them, a row for each piece and range, grows no faster than the input.
PIECE, RANGE, LARGE = 4_000_000, 4_000_000, 10_000_000_000
#: Sets of a bucket, and members of a verifying group, that go to one task.
CHUNK, GROUP = 8192, 1000
#: Most rounds in which every set goes to its nearest one; what is left then goes all at once.
ROUNDS = 2
#: Parts of a suffix, of a whole set, and bits of a shingle's code that is counted.
_PARTS, _FINE, _CODE = 16, 1024, 48
_WORDS = 300_000
_FACTOR = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 6)]


class _Hashes(dict):
    """64-bit hashes of words, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int = SHINGLE, words: dict | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    own = (text or b"").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    words = _Hashes() if words is None else words
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _FACTOR[0] + h[k:len(h) - n + 1 + k]
    out = np.sort(_mixed(out))
    return out[np.append(True, out[1:] != out[:-1])]


def prefix(n: int, percent: int) -> int:
    """First shingles of a set of n among which every alike set has one."""
    return n - -(-percent * n // 100) + 1


def needed(n, m, percent: int):
    """Shared shingles of alike sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


# ---- sets and frequencies --------------------------------------------------------------

def _pieces(batches, size_of: int):
    """(piece, row, id, text): texts in runs of some ``size_of`` bytes."""
    from pyspark import TaskContext
    row = piece = TaskContext.get().partitionId() << 40
    size = 0
    for b in batches:
        sizes = np.array([len(t or b"") for t in common.utf8_lists(b, "text")], np.int64)
        part = piece + (size + np.cumsum(sizes) - sizes) // size_of
        size += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(row, row + b.num_rows)), *b.columns], ["piece", "row", "id", "text"])
        row += b.num_rows


def _whole_pieces(batches, columns: list[str]):
    """(piece, its rows' columns) as the rows of a piece come, one behind the other."""
    now, held = None, []
    for b in batches:
        piece = b.column("piece").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])[:len(piece)]), len(piece))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and piece[lo] != now:
                yield now, [pa.concat_arrays([h.column(c) for h in held]) for c in columns]
                held = []
            now = int(piece[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, [pa.concat_arrays([h.column(c) for h in held]) for c in columns]


def _coded(texts, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(sets, the different codes of a piece, each shingle's code, documents of each code)."""
    import sys
    words = sys.__dict__.setdefault("_shingle_words", _Hashes())
    sets = [shingles(t, size, words) for t in texts.cast(pa.binary()).to_pylist()]
    codes = np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - _CODE)
    order = np.argsort(codes, kind="stable")
    new = np.append(True, codes[order][1:] != codes[order][:-1])[:len(codes)]
    at = np.empty(len(codes), np.int64)
    at[order] = np.cumsum(new) - 1
    return sets, codes[order][new], at, np.bincount(at, minlength=int(new.sum()))


class Sets:
    """The shingle sets of a table.

    marks: (row, id, n, a, b, first, prefix, shared, parity) for every row; a and b name the set, ``first`` is the number of its shingles
    that no other document has, ``prefix`` that of its other shingles within the prefix, and ``shared`` holds all its other
    shingles in order and ``parity`` their parities, where the prefix has one.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT):
        from urlscope.session import scratch_path  # here, as task functions take this module along by value
        self.spark, self.percent = spark, percent
        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        grown = max(1.0, (total / LARGE) ** 0.5)
        piece_size = int(PIECE * grown)
        # a word and the blank behind it have some six bytes
        ranges = max(1, -(-total // int(6 * RANGE * grown)))
        pieces = common.stored(spark, common.map_arrow(rows, lambda batches: _pieces(batches, piece_size), f"piece bigint, row bigint, id {kind}, text string"), "pieces")
        told = scratch_path(spark, "frequencies")

        def ask(batches):
            for piece, (texts,) in _whole_pieces(batches, ["text"]):
                _, codes, _, count = _coded(texts, size)
                cut = np.searchsorted(codes * np.uint64(ranges) >> np.uint64(_CODE) if ranges < 1 << 16 else codes // np.uint64((1 << _CODE) // ranges + 1), np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(cut)).tolist()
                parts = [slice(cut[r], cut[r + 1]) for r in full]
                yield pa.RecordBatch.from_arrays([pa.array([piece] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([p.stop - p.start for p in parts], pa.int32()),
                                                  pa.array([pack(codes[p]) for p in parts], pa.binary()), pa.array([squeeze(count[p].astype(np.uint32)) for p in parts], pa.binary())],
                                                 ["piece", "range", "n", "codes", "counts"])

        def answer(batches):
            for r, held in runs(batches, "range"):
                codes = np.concatenate([unpack(x["codes"], x["n"]) for x in held])
                counts = np.concatenate([spread(x["counts"], np.uint32, x["n"]) for x in held]).astype(np.int64)
                order = np.argsort(codes, kind="stable")
                first = np.flatnonzero(np.append(True, codes[order][1:] != codes[order][:-1]))
                sums, sizes = np.add.reduceat(counts[order], first), np.diff(np.append(first, len(codes)))
                counts[order] = np.repeat(sums, sizes)
                at = 0
                for x in held:
                    yield pa.RecordBatch.from_arrays([pa.array([x["piece"]], pa.int64()), pa.array([r], pa.int32()), pa.array([x["n"]], pa.int32()),
                                                      pa.array([squeeze(counts[at:at + x["n"]])], pa.binary())], ["piece", "range", "n", "counts"])
                    at += x["n"]

        def keep(batches):
            for piece, held in runs(batches, "piece"):
                counts = np.concatenate([spread(x["counts"], np.int64, x["n"]) for x in held])
                common.write_whole(told, f"{piece}", len(counts).to_bytes(8, "little") + squeeze(counts))
                yield pa.RecordBatch.from_arrays([pa.array([len(counts)], pa.int64())], ["n"])

        def mark(batches):
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            for piece, (row, ids, texts) in _whole_pieces(batches, ["row", "id", "text"]):
                sets, _, at, _ = _coded(texts, size)
                known = read_whole(told, f"{piece}") if len(at) else None
                count = spread(known[8:], np.int64, int.from_bytes(known[:8], "little"))[at] if len(at) else at
                out, lo = [], 0
                for x in sets:
                    n, own = len(x), count[lo:lo + len(x)]
                    lo += n
                    if not n:
                        out.append((0, 0, 0, 0, 0, None, None))
                        continue
                    name = np.frombuffer(xxhash.xxh128_digest(x.tobytes()), np.int64)
                    first = int((own == 1).sum())
                    more = prefix(n, percent) - first
                    shared = parity = None
                    if more > 0 and first < n:
                        # hashes are sorted, so a stable order by frequency is one by (frequency, hash)
                        many = own > 1
                        shared = x[many][np.argsort(own[many], kind="stable")].tobytes()
                        parity = np.packbits(np.bincount((x[many] & np.uint64(_FINE - 1)).view(np.int64), minlength=_FINE).astype(np.uint8) & 1).tobytes()
                    out.append((n, int(name[0]), int(name[1]), first, min(max(0, more), n - first), shared, parity))
                yield pa.RecordBatch.from_arrays([row, ids, *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))],
                                                 ["row", "id", "n", "a", "b", "first", "prefix", "shared", "parity"])

        shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # ranges hold alike many codes, so they are dealt in turn
        tasks = min(ranges, shuffles)
        asked = common.map_arrow(pieces.select("piece", "text"), ask, "piece bigint, range int, n int, codes binary, counts binary")
        answers = common.map_arrow(asked.repartitionById(tasks, F.col("range") % tasks).sortWithinPartitions("range"), answer, "piece bigint, range int, n int, counts binary")
        common.map_arrow(answers.repartition(shuffles, "piece").sortWithinPartitions("piece", "range"), keep, "n bigint").agg(F.sum("n")).first()
        self.marks = common.stored(spark, common.map_arrow(pieces, mark, f"row bigint, id {kind}, n int, a bigint, b bigint, first int, prefix int, shared binary, parity binary"), "marks")
        alive = self.marks.where("shared is not null").select("a", "b", "n", "first", "prefix", "shared", "parity")
        self.sets = common.stored(spark, alive.dropDuplicates(["a", "b"]).withColumn("s", F.monotonically_increasing_id()), "sets")

    # ---- candidates --------------------------------------------------------------------

    def prefixes(self) -> DataFrame:
        """(h, s, n, pos, suffix): a row for each prefix shingle that several documents have. ``suffix`` has the number of shingles
        behind it in each part of the hashes, 255 at most."""

        def run(batches):
            for b in batches:
                s, n, first, most = (b.column(k).to_numpy() for k in range(4))
                out = []
                for i, raw in enumerate(b.column("shared").to_pylist()):
                    h = np.frombuffer(raw, np.uint64)
                    part, q = (h >> np.uint64(60)).astype(np.int64), int(most[i])
                    ones = np.zeros((q, _PARTS), np.int64)
                    ones[np.arange(q), part[:q]] = 1
                    behind = np.bincount(part, minlength=_PARTS)[None, :] - np.cumsum(ones, 0)
                    out.append((h[:q], np.full(q, s[i]), np.full(q, n[i]), first[i] + np.arange(q), np.minimum(behind, 255).astype(np.uint8).view(np.int64)))
                if not out:
                    continue
                h, s, n, pos, suffix = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(suffix[:, 0]), pa.array(suffix[:, 1])],
                                                 ["h", "s", "n", "pos", "x0", "x1"])

        rows = common.map_arrow(self.sets.select("s", "n", "first", "prefix", "shared"), run, "h bigint, s bigint, n int, pos int, x0 bigint, x1 bigint")
        return common.stored(self.spark, rows, "prefixes")

    def _star(self, rows: DataFrame) -> DataFrame:
        """(u, v): for every set the one that leads most of its buckets."""
        percent = self.percent
        # the same sets lead wherever they are
        leaders = rows.groupBy("h").agg(F.min_by(F.struct("s", "n", "pos", "x0", "x1"), F.xxhash64("s")).alias("l"), F.count("*").alias("size")).where("size > 1")
        leaders = leaders.select("h", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("s", "n", "pos", "x0", "x1")])
        met = rows.join(leaders, "h").where("s != l_s").drop("h")

        def run(batches):
            for b in batches:
                x, y = ([b.column(p + c).to_numpy() for c in ("n", "pos", "x0", "x1")] for p in ("", "l_"))
                ok = pa.array(_passes(x, y, percent))
                yield pa.RecordBatch.from_arrays([b.column("s").filter(ok), b.column("l_s").filter(ok)], ["v", "u"])

        found = common.map_arrow(met, run, "v bigint, u bigint").groupBy("u", "v").count()
        return found.groupBy("v").agg(F.max_by("u", F.struct("count", "u")).alias("u")).select("u", "v")

    def _met(self, rows: DataFrame, part: DataFrame, nearest: bool) -> DataFrame:
        """(u, v): all pairs of a bucket that lie in different components and pass the filters; nearest: of these, for each v only
        the u with the least distance between parities."""
        percent = self.percent
        rows = rows.join(part, "s", "left").withColumn("component", F.coalesce("component", "s"))
        mixed = rows.groupBy("h").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
        mixed = mixed.select("h", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
        mine = rows.join(mixed, "h").withColumn("own", F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int"))
        # chunk a of a large bucket meets every chunk b: one task for each pair (a, b), a <= b
        mine = mine.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        mine = mine.join(self.sets.select("s", "first", "parity"), "s")
        mine = mine.select("h", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "s", "n", "pos", "x0", "x1", "component", "first", "parity")

        def run(batches):
            key, held = None, []
            for b in batches:
                if not b.num_rows:
                    continue
                cols = [b.column(k).to_numpy() for k in range(11)]
                cols.append(np.frombuffer(b"".join(b.column("parity").to_pylist()), np.uint64).reshape(b.num_rows, -1))
                cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
                found = []
                for lo, hi in zip(np.append(0, cut), np.append(cut, b.num_rows)):
                    now = tuple(int(c[lo]) for c in cols[:3])
                    if now != key:
                        found += flush(key, held)
                        key, held = now, []
                    held.append([c[lo:hi] for c in cols[3:]])
                if found:
                    yield told(found)
            if found := flush(key, held):
                yield told(found)

        def told(found):
            u, v, apart = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(apart)], ["u", "v", "apart"])

        def flush(key, held):
            if sum(len(x[0]) for x in held) < 2:
                return []
            own, s, n, pos, x0, x1, component, first, parity = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(n, kind="stable")
            own, s, n, pos, x0, x1, component, first, parity = (c[order] for c in (own, s, n, pos, x0, x1, component, first, parity))
            # by length: what is too long for the first of a block is so for what comes before it, too
            ends = np.searchsorted(n, n * 100 // percent, "right")
            out, best = [], np.full(len(s), 1 << 62, np.int64)
            for lo in range(0, len(s), 128):
                hi = min(lo + 128, len(s))
                stop = int(ends[hi - 1])
                i, j = np.nonzero(component[lo:hi, None] != component[None, lo:stop])
                keep = j > i
                i, j = i[keep] + lo, j[keep] + lo
                if key[1] != key[2]:
                    keep = own[i] != own[j]
                    i, j = i[keep], j[keep]
                if len(i):
                    ok = _passes([c[i] for c in (n, pos, x0, x1)], [c[j] for c in (n, pos, x0, x1)], percent)
                    i, j = i[ok], j[ok]
                    # shingles that no other document has are all differences
                    apart = first[i] + first[j] + np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64)
                    ok = apart <= n[i] + n[j] - 2 * needed(n[i].astype(np.int64), n[j].astype(np.int64), percent)
                    i, j, apart = i[ok], j[ok], apart[ok]
                    if nearest:
                        np.minimum.at(best, i, apart << 32 | j)
                        np.minimum.at(best, j, apart << 32 | i)
                    elif len(i):
                        u, v = s[i], s[j]
                        out.append((np.minimum(u, v), np.maximum(u, v), apart))
            if nearest:
                own = np.flatnonzero(best < 1 << 62)
                if len(own):
                    out.append((s[best[own] & 0xFFFFFFFF], s[own], best[own] >> 32))
            return out

        dealt = mine.repartition("h", "a", "b").sortWithinPartitions("h", "a", "b")
        found = common.map_arrow(dealt, run, "u bigint, v bigint, apart bigint")
        if nearest:
            found = found.groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u"))
            # two that are nearest to each other are one pair
            return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        return found.select("u", "v").distinct()

    # ---- verification ------------------------------------------------------------------

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of those pairs of sets that are alike. A set's shingles go to each of its pairs' u once; a large group of one u is salted."""
        percent = self.percent
        sizes = pairs.groupBy("u").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
        sets = self.sets.select("s", "n", "shared")
        members = (pairs.join(sizes, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("groups")).cast("int"))
                   .join(sets.withColumnRenamed("s", "v"), "v").select("u", "salt", "v", "n", "shared"))
        own = (sizes.withColumn("salt", F.explode(F.expr("sequence(0, groups - 1)"))).join(sets.withColumnRenamed("s", "u"), "u")
               .select("u", "salt", F.lit(None).cast("long").alias("v"), "n", "shared"))

        def run(batches):
            mine = None
            for b in batches:
                us, vs = [], []
                for u, v, n, raw in zip(*(b.column(c).to_pylist() for c in ("u", "v", "n", "shared"))):
                    h = np.frombuffer(raw, np.uint64)
                    if v is None:
                        mine = (u, n, h)
                    elif mine[0] != u:
                        raise ValueError("a group lacks its own shingles")
                    elif len(np.intersect1d(h, mine[2], assume_unique=True)) >= needed(n, mine[1], percent):
                        us.append(u)
                        vs.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        dealt = members.unionByName(own).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
        return common.map_arrow(dealt, run, "u bigint, v bigint")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """((u, v) links between sets whose closure joins all alike pairs, (s, component))."""
        rows = self.prefixes()
        tested = common.stored(self.spark, self._star(rows), "pairs")
        links = common.stored(self.spark, self.verified(tested), "alike")
        part = components(self.spark, links).withColumnRenamed("node", "s")
        nearest = ROUNDS > 0
        for k in range(ROUNDS + 1):
            both = tested.unionByName(tested.select(F.col("v").alias("u"), F.col("u").alias("v")))
            pairs = common.stored(self.spark, self._met(rows, part, nearest).join(both, ["u", "v"], "left_anti"), "pairs")
            found = common.stored(self.spark, self.verified(pairs), "alike")
            tested = tested.unionByName(pairs)
            if found.limit(1).count():
                links = links.unionByName(found)
                part = components(self.spark, links).withColumnRenamed("node", "s")
            if not nearest:
                break
            # the last time with all pairs that are left
            nearest = k + 1 < ROUNDS and found.limit(1).count() > 0
        return links, part


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id): the smallest id that a document reaches over links of at least ``percent``."""
    made = Sets(spark, docs, id_col, text_col, size, percent)
    _, part = made.links()
    classes = made.marks.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    named = made.sets.select("a", "b", "s").join(part, "s").select("a", "b", "component")
    classes = common.stored(spark, classes.join(named, ["a", "b"], "left").where("rows > 1 or component is not null"), "classes")
    whole = classes.where("component is not null").groupBy("component").agg(F.min("least").alias("all_least"))
    classes = classes.join(whole, "component", "left").select("a", "b", F.coalesce("all_least", "least").alias("component_id"), F.lit(True).alias("known"))
    # sets of one row without links need no join; a hot set is split by the skew join
    out = made.marks.select("id", "n", "a", "b").join(classes, ["a", "b"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _passes(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Length, positional and suffix filter for pairs that meet at their first shared shingle; x, y: (n, pos, x0, x1)."""
    n, m = x[0].astype(np.int64), y[0].astype(np.int64)
    ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    need = needed(n, m, percent)
    behind_x, behind_y = n - x[1] - 1, m - y[1] - 1
    ok &= 1 + np.minimum(behind_x, behind_y) >= need
    at = np.flatnonzero(ok)
    if len(at):
        parts = [np.ascontiguousarray(np.stack([z[2][at], z[3][at]], 1)).view(np.uint8).reshape(len(at), _PARTS).astype(np.int16) for z in (x, y)]
        ok[at] = np.abs(parts[0] - parts[1]).sum(1) <= (behind_x + behind_y - 2 * (need - 1))[at]
    return ok


def query(spark, sf_dir: str) -> DataFrame:
    """op12: five-word shingles, four fifths."""
    out = near_duplicates(spark, common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_shingles", "component_id")
