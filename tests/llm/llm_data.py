"""Data, fixtures and brute-force helpers of these tests (no conftest.py: that name is taken one folder up)."""

import random

import pytest
import xxhash
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                     # names that the operators use for themselves
                     *(StructField(n, StringType()) for n in ("id", "h", "key", "pos", "row", "spans", "toxicity", "ids", "n_chars"))])


def prose(seed: int, n: int) -> str:
    """Made-up prose with a few accents and sentence ends."""
    r = random.Random(seed)
    parts = ["ta", "lo", "mir", "sé", "gan", "ou", "fel", "ba", "ñu", "ke"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def rows() -> list[tuple]:
    shared = prose(1000, 90)
    texts = [prose(i, 60 + 7 * i) for i in range(12)]
    texts[3] = texts[2]
    texts[4] = texts[2].replace("ta", "lo", 1)
    texts[5] += " " + shared
    texts[6] = shared + " " + texts[6]
    texts[7] = texts[7][:50] + shared[:300] + texts[7][50:]
    texts[8] = "de " * 400
    texts[9] = prose(77, 9000)
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(20, None), (21, ""), (22, " \t\n"), (23, "x"), (24, "▁ é😀\x00 ¡A-Z! <|endoftext|>"), (None, texts[0]), (None, None)]
    out += [(30, prose(30, 80))] * 2  # a repeated row
    out += [(31, prose(31, 50)), (31, texts[10])]  # one id, two texts
    return [(i, t, *["x"] * 9) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs() -> list[tuple]:
    return [(r[0], r[1]) for r in rows()]


def brute_bits(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, max_bits):
    """The least id that each row reaches; rows of one id are one node."""
    group = list(range(len(marks)))
    changed = True
    while changed:
        changed = False
        for a, (i, x) in enumerate(marks):
            for b, (j, y) in enumerate(marks):
                if group[a] != group[b] and ((x ^ y).bit_count() <= max_bits or i is not None and i == j):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {}
    for g, (i, _) in zip(group, marks):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in group]
