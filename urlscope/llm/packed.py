"""Sorted numbers in few bytes, runs of rows, and whole files of the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common


def squeeze(numbers: np.ndarray) -> bytes:
    """Compressed, all first bytes before all second ones."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def spread(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def pack(codes: np.ndarray) -> bytes:
    """Sorted codes as compressed steps."""
    return squeeze(np.diff(codes, prepend=np.uint64(0)))


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(spread(data, np.uint64, n), dtype=np.uint64)


def runs(batches, name: str):
    """(value, rows) of runs of equal values of a column, the rows as dicts."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if held and row[name] != now:
                yield now, held
                held = []
            now = row[name]
            held.append(row)
    if held:
        yield now, held


def read_whole(folder: str, name: str) -> bytes:
    """A file that ``common.write_whole`` has written; an error if there is none."""
    system, path = common.open_folder(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read()
