"""Byte-level BPE: encoding through a hierarchical-bitmap rank queue, and decoding.

A text is split by the tokenizer's pattern; in each match the adjacent pair of
least rank is merged, the leftmost first, until no pair has a rank. Pairs wait in
buckets, one a rank; a bitmap of two levels of wide words says which buckets
are filled, so the least rank is two find-first-set steps away however many
pairs wait. Parts are a linked list over start positions; an entry whose pair has
been merged or changed since is stale and is skipped when it comes up. A match of
n bytes costs O(n log n) at worst, so a match as long as the text is no danger.

Defined results: a null text has no tokens, as an empty one. A repeated row is
encoded each time; matches seen before come from a table of bounded size in the
Python worker. Texts are never cut. Other columns stay; an added column whose name is
taken gets a numbered one.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from contextlib import suppress
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vireo.llm.common import free_name, map_arrow

#: Matches that a generation of a task's memory holds, and the characters up to which one is remembered.
REMEMBERED, SHORT = 3 << 17, 48
#: Tokens (or bytes, in decoding) after which a record batch goes out.
OUT = 1 << 20
#: Beyond so many bytes positions are kept in packed arrays.
PACKED = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number; read on the driver, tasks get them with their closure."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Bits of a word of the lower level; the upper level is one word with a bit for each of these.
WIDE = 8
BIT = tuple(1 << k for k in range(1 << WIDE))
REST = (1 << WIDE) - 1


class RankQueue:
    """Least rank first, then least position: buckets by rank under a bitmap of two levels.

    ``Encoder.merge`` does the same steps in place, as calls would cost more than they do.
    """

    def __init__(self, ranks: int):
        self.low, self.top = [0] * ((ranks >> WIDE) + 1), 0
        self.up = tuple(1 << w for w in range(len(self.low)))
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            w = rank >> WIDE
            self.low[w] |= BIT[rank & REST]
            self.top |= self.up[w]
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        w = (top & -top).bit_length() - 1
        word = self.low[w]
        rank = (w << WIDE) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[w] = word = word & (word - 1)  # the first set bit goes
            if not word:
                self.top = top & (top - 1)
        return rank, at


class _Memo(dict):
    """Ids of matches: those of the vocabulary's own words always, others in two generations of bounded size.

    A match that is in neither is merged; one that is asked for again before a generation has passed stays.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}
        self.words = {}
        for word, rank in encoder.ranks.items():
            with suppress(UnicodeDecodeError):
                self.words[word.decode()] = (rank,)
        super().__init__(self.words)

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = self.old.get(match)
        if ids is None:
            ids = tuple(self.encoder.merge(match.encode()))
        if len(match) <= SHORT:
            if len(self) - len(self.words) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
                self.update(self.words)
            self[match] = ids
        return ids


class Encoder:
    """Ids of a text under one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.matches = ranks, regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=0)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        get, longest, queue = self.ranks.get, self.longest, self.queue
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        follow = range(1, n + 1)  # start of the next part; n is the end
        before = range(-1, n)  # start of the part before
        follow, before, waits = (array("i", follow), array("i", before), array("i", [-1]) * n) if n > PACKED else (list(follow), list(before), [-1] * n)
        # waits: the rank under which the pair that starts here waits. A bucket of one position is that position.
        low, up, top, buckets = queue.low, queue.up, 0, queue.buckets
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                waits[i] = r
                held = buckets.get(r)
                if held is None:
                    buckets[r] = i
                    w = r >> WIDE
                    low[w] |= BIT[r & REST]
                    top |= up[w]
                elif held.__class__ is int:
                    buckets[r] = [held, i]  # ascending, so a heap
                else:
                    held.append(i)
        while top:
            w = (top & -top).bit_length() - 1
            word = low[w]
            rank = (w << WIDE) + (word & -word).bit_length() - 1
            i = buckets[rank]
            if i.__class__ is list:
                held, i = i, heappop(i)
            else:
                held = None
            if not held:
                del buckets[rank]
                low[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if waits[i] != rank:  # merged or changed since
                continue
            gone = follow[i]
            follow[i] = end = follow[gone]
            waits[gone] = waits[i] = -1
            if end < n:
                before[end] = i
                stop = follow[end]
                if stop - i <= longest and (r := get(piece[i:stop])) is not None:
                    waits[i] = r
                    held = buckets.get(r)
                    if held is None:
                        buckets[r] = i
                        w = r >> WIDE
                        low[w] |= BIT[r & REST]
                        top |= up[w]
                    elif held.__class__ is int:
                        buckets[r] = [held, i] if held < i else [i, held]
                    else:
                        heappush(held, i)
            left = before[i]
            if left >= 0:
                r = get(piece[left:end]) if end - left <= longest else None
                if r is None:
                    waits[left] = -1
                elif r != waits[left]:
                    waits[left] = r
                    held = buckets.get(r)
                    if held is None:
                        buckets[r] = left
                        w = r >> WIDE
                        low[w] |= BIT[r & REST]
                        top |= up[w]
                    elif held.__class__ is int:
                        buckets[r] = [held, left] if held < left else [left, held]
                    else:
                        heappush(held, left)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : (end := follow[i])]))
            i = end
        return out

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.memo.__getitem__, self.matches(text))))


_held: dict = {}


def _in_worker(mark: str, make):
    """What ``make`` gives, kept in the Python worker over its tasks until another mark comes."""
    if mark not in _held:
        _held.clear()
        _held[mark] = make()
    return _held[mark]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Rows with the ids of their whole text as ``array<int>``; ``keep`` names the columns that go along (default: all).

    The pattern must not need look-around over more than a match; ids are ranks, no special token is made.
    """
    wanted = [f for f in df.schema.fields if keep is None or f.name in keep]
    out = free_name(df, out)
    schema = T.StructType([*wanted, T.StructField(out, T.ArrayType(T.IntegerType()), False)])
    table = df.sparkSession.sparkContext.broadcast((ranks, pattern))  # its size is that of the vocabulary
    mark = uuid.uuid4().hex

    def run(batch):
        encoder = _in_worker(mark, lambda: Encoder(*table.value))
        ids, ends, began = array("i"), [0], 0
        for k, text in enumerate(batch.column(text_col)):
            ids.extend(encoder.encode(text.as_py() or ""))
            ends.append(len(ids))
            if len(ids) >= OUT or k == batch.num_rows - 1:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32) if len(ids) else [], pa.int32()))
                yield {f.name: batch.column(f.name)[began : k + 1] for f in wanted} | {out: lists}
                ids, ends, began = array("i"), [0], k + 1

    return map_arrow(df, run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Rows with the bytes of their ids (null or none: empty); an id without a rank is an error.

    The words of a lot of ids are taken as one array, whose data is the lot's bytes end to end.
    """
    wanted = [f for f in df.schema.fields if keep is None or f.name in keep]
    out = free_name(df, out)
    schema = T.StructType([*wanted, T.StructField(out, T.BinaryType(), False)])
    table = df.sparkSession.sparkContext.broadcast(ranks)
    words: list[pa.Array] = []

    def run(batch):
        if not words:
            by_id = {i: w for w, i in table.value.items()}
            words.append(pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.binary()))
        lists, began = batch.column(ids_col), 0
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        while began < batch.num_rows:
            stop = max(began + 1, int(np.searchsorted(ends, ends[began] + OUT, "right")) - 1)
            ids = lists[began:stop].flatten()
            known = len(ids) == 0 or (pc.min(ids).as_py() >= 0 and pc.max(ids).as_py() < len(words[0]))
            if not known or (got := words[0].take(ids)).null_count:
                raise ValueError("an id has no word")
            at = np.frombuffer(got.buffers()[1], np.int32)[: len(got) + 1] if len(got) else np.zeros(1, np.int32)
            places = np.ascontiguousarray(at[ends[began : stop + 1] - ends[began]])
            decoded = pa.Array.from_buffers(pa.binary(), stop - began, [None, pa.py_buffer(places), got.buffers()[2]])
            yield {f.name: batch.column(f.name)[began:stop] for f in wanted} | {out: decoded}
            began = stop

    return map_arrow(df, run, schema)
