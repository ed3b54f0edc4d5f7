"""Sampled segmentations over a piece lattice, and lossless decoding.

The vocabulary is that of a SentencePiece model (a parameter, read and never trained). A text is
spelled with U+2581 for blanks; every piece that matches somewhere is an edge of the lattice, and a character
that is no piece has an edge over its bytes (``<0xC3>``...), so any text has a path. A path's weight is
the product of its edges' weights, ``(rank + OFFSET) ** -alpha`` for a piece of the given rank in the
vocabulary's own order of scores and ``BYTE_COST`` times the least of these for a character by bytes.

Forward filtering sums the weights of all paths up to every position; backward sampling then
draws a path from its end, each edge with its exact share of the remaining sum. No piece holds
a blank behind another character, so the lattice falls apart before every run of blanks: words are filtered
once each and drawn from again and again. A draw takes its random number from a hash of (seed,
row key, number of the word in the text, step), so a segmentation depends on nothing but the row
itself: not on partitions, order or repeats.

Decoding joins the pieces' bytes and turns U+2581 back to blanks. A U+2581 that is in the text itself is
only ever spelled by its three bytes, so decode(encode(text)) is the text, always. No blank is put
before the text.

Defined cases: null text counts as empty and has no ids. Long runs without a blank are cut where no
piece can span (between characters that stand side by side in no piece), which leaves the weights as
they are. Rows of equal key and text get equal ids. A null key counts as the empty text. Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .lookup import Lookup

BLANK = "▁"
ALPHA = 1.0
OFFSET = 8.0
BYTE_COST = 1e-3
SEED = 20240229
#: A word and the blanks before it.
_WORD = re.compile(r" *[^ ]+| +")
#: Factor for each character, which cancels out: about the usual weight of a piece to the power -1 / its length.
PER_CHAR = 12.0
#: States that a worker keeps filtered.
_KEPT = 1_000_000
_BLANK = np.uint64(ord(BLANK))
#: Factors of the characters in a string's hash, the last character's first.
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], np.uint64)
_LONG = 48


class Lattice:
    """Edges of words, filtered once: for each word position the edges that end there, with the
    cumulative shares that backward sampling draws from. States of all kept words stand in one set of arrays."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        order = sorted((i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))),
                       key=lambda i: (sp.get_score(i) < -1e6, -sp.get_score(i), i))
        self.pieces = {sp.id_to_piece(i): i for i in order}
        self.longest = max(map(len, self.pieces), default=1)
        # every character's constant factor is the same on all paths of a word; it keeps sums near 1
        self.weight = np.zeros(n)
        for rank, i in enumerate(order):
            self.weight[i] = (PER_CHAR ** len(sp.id_to_piece(i)) / (rank + OFFSET)) ** alpha
        self.byte_weight = (BYTE_COST / (len(order) + OFFSET) * PER_CHAR) ** alpha
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary lacks byte pieces, so not every text has a path")
        # ends of pieces, by hash: behind a string that is none of them no longer piece can end
        tails = sorted({p[i:] for p in self.pieces for i in range(len(p))})
        self.tail_size = np.array([len(x) for x in tails])
        self.tail_end = np.array([ord(x[-1]) for x in tails], np.uint64)
        self.tail_id = np.array([self.pieces.get(x, -1) for x in tails])
        codes = np.zeros((len(tails), self.longest), np.uint64)
        for k, x in enumerate(tails):
            codes[k, :len(x)] = [ord(c) + 1 for c in reversed(x)]
        self.table = Lookup(_mix((codes * _POWERS[None, :self.longest]).sum(1, dtype=np.uint64)), np.arange(len(tails)), np.int32, room=4)
        self.beside = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        # text of an id, as bytes; U+2581 stands for a blank
        self.spelled = [b""] * n
        for p, i in self.pieces.items():
            self.spelled[i] = p.replace(BLANK, " ").encode()
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        self.clear()

    def clear(self):
        self.words, self.n_states, self.n_edges = {}, 0, 0
        # of a state: where its edges begin; of an edge: cumulative share, id, state before it (-1: the word's start)
        self.first, self.share = np.zeros(1 << 16, np.int32), np.zeros(1 << 17, np.float32)
        self.id, self.before = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32)

    def cut(self, text: str) -> list[str]:
        """The text in runs that no piece spans."""
        words = _WORD.findall(text)
        if not words or max(map(len, words)) <= _LONG:
            return words
        out = []
        for w in words:
            if len(w) <= _LONG:
                out.append(w)
                continue
            spelled, at = w.replace(" ", BLANK), 0
            for i in range(1, len(w)):
                if spelled[i - 1:i + 1] not in self.beside:
                    out.append(w[at:i])
                    at = i
            out.append(w[at:])
        return out

    def _edges(self, chars: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position where it ends, length, id) of every piece that matches; place: position within its word."""
        ends, lengths, ids = [], [], []
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for n in range(1, self.longest + 1):
            h = (h + (chars[at - n + 1] + np.uint64(1)) * _POWERS[n - 1])
            hit, value = self.table.find(_mix(h))
            at, h, value = at[hit], h[hit], value[hit]
            # a hash that names a string of another length or end is none of ours
            fits = self.tail_size[value] == n
            fits &= self.tail_end[value] == chars[at]
            at, h, value = at[fits], h[fits], value[fits]
            piece = self.tail_id[value]
            whole = piece >= 0
            ends.append(at[whole])
            lengths.append(np.full(int(whole.sum()), n))
            ids.append(piece[whole])
            more = place[at] >= n
            at, h = at[more], h[more]
            if not len(at):
                break
        return np.concatenate(ends), np.concatenate(lengths), np.concatenate(ids)

    def _filter(self, words: list[str]) -> None:
        """Forward-filter new words, all at once, position by position."""
        text = "".join(words)
        own = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        # blanks are U+2581 in pieces; the character itself matches no piece
        chars = np.where(own == _BLANK, np.uint64(0x110000), np.where(own == 32, _BLANK, own))
        sizes = np.array([len(w) for w in words])
        begins = np.cumsum(sizes) - sizes
        place = np.arange(len(chars)) - np.repeat(begins, sizes)
        ends, lengths, ids = self._edges(chars, place)
        weights = self.weight[ids]
        lone = np.ones(len(chars), bool)
        lone[ends[lengths == 1]] = False
        lone = np.flatnonzero(lone)  # no piece of its own: an edge over its bytes, its code point as a negative number
        ends, lengths = np.concatenate([ends, lone]), np.concatenate([lengths, np.ones(len(lone), np.int64)])
        ids, weights = np.concatenate([ids, -1 - own[lone].astype(np.int64)]), np.concatenate([weights, np.full(len(lone), self.byte_weight)])
        order = np.argsort(ends * (self.longest + 1) + lengths)  # by state
        ends, lengths, ids, weights = ends[order], lengths[order], ids[order], weights[order]
        begins_word = place[ends] < lengths
        starts = np.where(begins_word, len(chars), ends - lengths)
        sums, share = np.zeros(len(chars) + 1), np.zeros(len(ends))
        sums[-1] = 1.0
        # position by position; the states of one position stay in order
        where = place[ends]
        steps = np.argsort(where.astype(np.uint16) if where.max() < 1 << 16 else where, kind="stable")
        cuts = np.searchsorted(where[steps], np.arange(int(sizes.max()) + 1))
        for t, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            edges = steps[lo:hi]
            e = ends[edges]
            part = weights[edges] * sums[starts[edges]]
            new = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            total = np.add.reduceat(part, new)
            sums[e[new]] = total
            share[edges] = part / np.repeat(total, np.diff(np.append(new, len(e))))
            if t % self.longest == self.longest - 1:  # long runs: the sums that are still used start near 1 again
                sums[e[new][:, None] - np.arange(self.longest)[None, :]] /= total[:, None]
        # cumulative shares of each state, the last one above any draw
        first = np.searchsorted(ends, np.arange(len(chars)))
        # added up within each state, edge by edge: they depend on the word alone, not on what it is filtered with
        counts, rank = np.diff(np.append(first, len(ends))), 1
        left = np.flatnonzero(counts > 1)
        while len(left):
            share[first[left] + rank] += share[first[left] + rank - 1]
            rank += 1
            left = left[counts[left] > rank]
        share[np.append(first[1:], len(ends)) - 1] = 2.0
        self._room(len(chars), len(ends))
        base, at = self.n_states, self.n_edges
        self.first[base:base + len(chars)] = at + first
        self.share[at:at + len(ends)], self.id[at:at + len(ends)] = share, ids
        self.before[at:at + len(ends)] = np.where(begins_word, -1, base + ends - lengths)
        self.n_states, self.n_edges = base + len(chars), at + len(ends)
        self.words.update(zip(words, (base + begins + sizes - 1).tolist()))

    def _room(self, states: int, edges: int):
        while self.n_states + states > len(self.first):
            self.first = np.append(self.first, np.zeros_like(self.first))
        while self.n_edges + edges > len(self.share):
            self.share, self.id, self.before = (np.append(x, np.zeros_like(x)) for x in (self.share, self.id, self.before))

    def states(self, words: list[str]) -> np.ndarray:
        """Last states of the words of one call; all of them are valid together."""
        if self.n_states > _KEPT:
            self.clear()
        new = list(set(words).difference(self.words))
        if new:
            new.sort(key=len)  # words of one length go together
            lo = size = 0
            for i, w in enumerate(new):
                size += len(w)
                if size > 100_000 or i == len(new) - 1:
                    self._filter(new[lo:i + 1])
                    lo, size = i + 1, 0
        return np.array(list(map(self.words.__getitem__, words)), np.int64)

    def sample(self, texts: list[str], keys: list[int], seed: int = SEED) -> list[np.ndarray]:
        """Ids of a sampled path of each text; keys: a number for each row."""
        runs = [self.cut(t) for t in texts]
        sizes = np.array([len(r) for r in runs], np.int64)
        state = self.states([w for r in runs for w in r])
        n = len(state)
        row = np.repeat(np.array(keys, np.uint64), sizes)
        number = np.arange(n, dtype=np.uint64) - np.repeat((np.cumsum(sizes) - sizes).astype(np.uint64), sizes)
        key = _mix(_mix(row ^ np.uint64(seed)) + number)
        places, ids, steps, step = [], [], [], 0
        left = np.arange(n)
        while len(left):
            draw = (_mix(key[left] + np.uint64(0x9E3779B97F4A7C15 * (step + 1) & (1 << 64) - 1)) >> np.uint64(11)).astype(float) * 2.0 ** -53
            edge = self.first[state[left]]
            more = np.flatnonzero(draw >= self.share[edge])
            while len(more):  # a state has few edges: step to the one that the draw falls on
                edge[more] += 1
                more = more[draw[more] >= self.share[edge[more]]]
            places.append(left)
            ids.append(self.id[edge])
            steps.append(np.full(len(left), step, np.int32))
            state[left] = self.before[edge]
            left = left[state[left] >= 0]
            step += 1
        if not n:
            return [np.zeros(0, np.int32) for _ in texts]
        places, ids, steps = np.concatenate(places), np.concatenate(ids), np.concatenate(steps)
        # paths are drawn from their ends: the last step comes first
        order = np.lexsort((-steps, places))
        places, ids = places[order], ids[order]
        out_sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[places], minlength=len(texts))
        ends = np.cumsum(out_sizes)
        return [self._bytes(ids[e - s:e]).astype(np.int32) for s, e in zip(out_sizes, ends)]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Ids with characters that go by bytes spelled out."""
        at = np.flatnonzero(ids < 0)
        if not len(at):
            return ids
        out, last = [], 0
        for i in at.tolist():
            out.append(ids[last:i])
            out.append(np.array([self.bytes[b] for b in chr(-1 - int(ids[i])).encode()], np.int64))
            last = i + 1
        out.append(ids[last:])
        return np.concatenate(out)

    def decode(self, ids) -> str:
        return b"".join(map(self.spelled.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal numbers to equal, else as good as random ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lattice(model: str, alpha: float) -> Lattice:
    """Kept over the tasks of a worker."""
    kept = sys.__dict__.setdefault("_piece_lattices", {})
    if (model, alpha) not in kept:
        kept[model, alpha] = Lattice(model, alpha)
    return kept[model, alpha]


def row_key(value) -> int:
    raw = b"" if value is None else str(value).encode()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1])


def _pieces(values: list, texts: list):
    """Some hundred kB of texts at a time."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > 400_000 or i == len(texts) - 1:
            yield values[lo:i + 1], texts[lo:i + 1]
            lo, size = i + 1, 0


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """(id_col, ids): a sampled segmentation of every row's whole text."""

    def run(batches):
        lattice = _lattice(model, alpha)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            out = []
            for values, part in _pieces(b.column("id").to_pylist(), texts):
                out += lattice.sample(part, [row_key(v) for v in values], seed)
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the texts of the ids; null ids count as none."""

    def run(batches):
        lattice = _lattice(model, ALPHA)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([lattice.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return common.map_arrow(rows, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, alpha: float = ALPHA,
               with_ids: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_tokens, ids_crc32, lossless, with_ids: also ids): encodes and decodes in one pass over the rows.

    ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    """

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches):
        lattice = _lattice(model, alpha)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            out = []
            for values, part in _pieces(b.column("id").to_pylist(), texts):
                for t, ids in zip(part, lattice.sample(part, [row_key(v) for v in values], seed)):
                    out.append((len(t.encode()), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), lattice.decode(ids) == t, ids))
            columns = [b.column("id"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))]
            if with_ids:
                ends = np.cumsum([0, *(len(x[4]) for x in out)]).astype(np.int32)
                flat = np.concatenate([x[4] for x in out]) if out else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "ids_crc32", "lossless"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, f"id {kind}, n_bytes bigint, n_tokens bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def piece_model() -> str:
    """The default vocabulary's path; it is a parameter everywhere else."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """op1: every document encoded and decoded; a text that came back otherwise would show as lossless = false."""
    return round_trip(common.table(spark, sf_dir, "documents"), model or piece_model())
