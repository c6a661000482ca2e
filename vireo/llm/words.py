"""Vectorised word kernel: split and hash whole Arrow string columns with NumPy.

A batch is cut into runs of whole documents of about ``CHUNK`` bytes. Inside a
run every word gets a 64-bit hash from one prefix sum of a polynomial in the
byte values (mod 2^64, where an odd base has an inverse), so no Python object
is made per word. Hashes depend on the bytes of the word only: they agree
between workers, runs and documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = b" \t\n\x0b\x0c\r"


@lru_cache(maxsize=None)
def _byte_values(lower: bool) -> np.ndarray:
    state = np.arange(1, 257, dtype=np.uint64)
    values = mix(state * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@lru_cache(maxsize=None)
def _is_word(mode: str) -> np.ndarray:
    """``white``: all but the six ASCII blanks. ``alnum``: ASCII letters, digits, and all of non-ASCII."""
    flags = np.ones(256, dtype=bool)
    if mode == "white":
        flags[list(_WHITE)] = False
    elif mode == "alnum":
        flags[:128] = [chr(i).isalnum() for i in range(128)]
    else:
        raise ValueError(mode)
    return flags


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK
    while size < n:
        size *= 2
    if size not in _powers:
        out = []
        for base in (_BASE, _INV):
            table = np.ones(size, dtype=np.uint64)
            have, step = 1, int(base)
            while have < size:
                take = min(have, size - have)
                table[have : have + take] = table[:take] * np.uint64(step)
                have += take
                step = step * step & 0xFFFFFFFFFFFFFFFF
            out.append(table)
        if size > CHUNK:
            return tuple(out)  # for one giant document; not kept
        _powers[size] = tuple(out)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n, start = len(column), column.offset
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=kind)[start : start + n + 1].astype(np.int64) if raw[1] is not None and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


class Words:
    """Words of the documents ``first .. first+n-1`` of a batch."""

    __slots__ = ("bounds", "data", "ends", "first", "hashes", "n", "starts")

    def __init__(self, first, n, bounds, hashes, data, starts, ends):
        self.first, self.n, self.bounds, self.hashes = first, n, bounds, hashes
        self.data, self.starts, self.ends = data, starts, ends

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def spans(data: np.ndarray, offsets: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and each document's first word."""
    offsets = offsets - offsets[0]
    inside = _is_word(mode)[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[-1] = True
    brim = np.unique(offsets)
    edge[brim] = True
    at = np.flatnonzero(edge)
    left, right = at[:-1], at[1:]
    keep = inside[left] if len(left) else np.zeros(0, bool)
    starts, ends = left[keep], right[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def words(column: pa.Array, mode: str = "white", lower: bool = True, hashes: bool = True, chunk: int = CHUNK) -> Iterator[Words]:
    """Runs of whole documents with their words' hashes (uint64), in order."""
    data, offsets = string_buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk, side="right")) - 1
        last = min(n, max(last, first + 1))
        part = data[offsets[first] : offsets[last]]
        own = offsets[first : last + 1] - offsets[first]
        starts, ends, bounds = spans(part, own, mode)
        got = None
        if hashes:
            got = _hash_spans(part, starts, ends, lower)
        yield Words(first, last - first, bounds, got, part, starts, ends)
        first = last


def _hash_spans(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    power, inverse = _power_tables(len(part) + 1)
    total = np.zeros(len(part) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_byte_values(lower)[part] * power[: len(part)], out=total[1:])
        raw = (total[ends] - total[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def hash_words(items: list[str], mode: str = "white", lower: bool = True) -> list[np.ndarray]:
    """Hash lists of a few strings (tests, small reference texts)."""
    out: list[np.ndarray] = []
    for run in words(pa.array(items, pa.string()), mode, lower):
        out += [run.of(i).copy() for i in range(run.n)]
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hashes of the ``k``-word windows of one document.

    A document of 1 to k-1 words has one shingle, all its words; none has none.
    """
    if len(h) == 0:
        return h[:0]
    w = min(k, len(h))
    n = len(h) - w + 1
    with np.errstate(over="ignore"):
        acc = np.zeros(n, dtype=np.uint64)
        for i in range(w):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
        return mix(acc + np.uint64(w))


def run_shingles(run: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of all documents of a run at once: (hashes, bounds by document)."""
    h, b = run.hashes, run.bounds
    lens = np.diff(b)
    count = np.where(lens >= k, lens - k + 1, np.minimum(lens, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(bounds[-1]), dtype=np.uint64)
    full = lens >= k
    if len(h) >= k and full.any():
        with np.errstate(over="ignore"):
            m = len(h) - k + 1
            acc = np.zeros(m, dtype=np.uint64)
            for i in range(k):
                acc = acc * np.uint64(0x9FB21C651E98DF25) + h[i : i + m]
            acc = mix(acc + np.uint64(k))
        take = np.repeat(full, count)
        src = np.repeat(b[:-1], count) + (np.arange(len(out)) - np.repeat(bounds[:-1], count))
        out[take] = acc[src[take]]
    for i in np.flatnonzero(~full & (lens > 0)):
        out[bounds[i] : bounds[i + 1]] = shingles(run.of(i), k)
    return out, bounds


def lowered(column: pa.Array) -> pa.Array:
    """Unicode lower case."""
    return pc.utf8_lower(column if not isinstance(column, pa.ChunkedArray) else column.combine_chunks())
