"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (lower case, letters and
digits). Seeds, all ``MIN_TILE``-word windows of the items, are looked up in
every whole document. For each (document, item) with seeds enough, the longest
common run of words that are not yet marked is found by running Karp-Rabin
(window hashes of a falling search length), marked in both, and so on until no
run of ``MIN_TILE`` words is left. Tiles may lie in any order, so passages with
their sentences moved are caught. The pair counts where tiles cover
``MIN_COVERAGE`` of the item's words.

Scale: one pass over the texts and no shuffle. The items go to the tasks in
blocks of at most ``BLOCK_WORDS`` words (16 bytes each, and a bitmap of 16 MB at most), so what is broadcast
has a bound; a larger benchmark takes one more pass per block. Seeds prune
exactly: a tile is made of shared seeds, so an item whose shared seeds cover
too few words can't reach the threshold.

Defined results: null or empty texts match nothing; items under ``MIN_TILE``
words match nothing; rows that repeat each get their rows; a very long text is
tiled only where it has seeds, and one word over and over makes a match for each
diagonal; columns other than id and text aren't looked at by ``overlaps`` and kept by
``drop_contaminated``, whatever their names; an empty table on either side gives no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.llm.common import cut, map_arrow
from vireo.llm.words import hash_words, lowered, run_shingles, shingles, words

MIN_TILE = 5
MIN_COVERAGE = 0.6
BLOCK_WORDS = 1 << 20
_BASE = np.uint64(0x9FB21C651E98DF25)
_INV = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


class Rolling:
    """Karp-Rabin hashes of all windows of any length of one word sequence."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))))
            self.inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _INV))))
            self.total = np.concatenate(([np.uint64(0)], np.cumsum(h * power[:n])))
        self.h = h

    def windows(self, at: np.ndarray, s: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[at + s] - self.total[at]) * self.inverse[at]


def _free_windows(free: np.ndarray, s: int) -> np.ndarray:
    """Starts of the windows of ``s`` words that are all free."""
    if len(free) < s:
        return np.zeros(0, np.int64)
    run = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(run[s:] - run[:-s] == s)


def tile(item: np.ndarray, text: np.ndarray, min_tile: int = MIN_TILE, free_text: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, text start, length) of all tiles.

    Longer tiles first; of equal ones the earliest in the item, then in the
    text. ``free_text`` marks the words that can be part of any tile.
    """
    p, t = Rolling(item), Rolling(text)
    free_p = np.ones(len(item), dtype=bool)
    free_t = np.ones(len(text), dtype=bool) if free_text is None else free_text.copy()
    tiles: list[tuple[int, int, int]] = []
    s = max(min_tile, min(len(item), len(text)))
    while len(_free_windows(free_p, min_tile)):
        found = [(-n, i, j) for n, i, j in _matches(p, t, free_p, free_t, s)]
        heapify(found)
        # All matches of s words or more are known. Mark them, longest first; one that
        # has lost words to a longer one is cut to what is left and waits for its turn.
        while found:
            length, i, j = heappop(found)
            own = free_p[i : i - length] & free_t[j : j - length]
            if own.all():
                free_p[i : i - length] = False
                free_t[j : j - length] = False
                tiles.append((i, j, -length))
                if not len(_free_windows(free_p, s)):
                    break
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= s:
                    heappush(found, (a - b, i + a, j + a))
        if s == min_tile:
            break
        s = s // 2 if s > 2 * min_tile else min_tile
    return tiles


def _matches(p: Rolling, t: Rolling, free_p: np.ndarray, free_t: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal free matches (length, item start, text start) of ``s`` words or more.

    Only pairs of windows that begin a match are made: those whose words before
    differ, or aren't free. So a run of one word over and over makes as many as
    it has diagonals, not one for each pair of windows.
    """
    at_p, at_t = _free_windows(free_p, s), _free_windows(free_t, s)
    if not len(at_p) or not len(at_t):
        return []
    classes, kind_p = np.unique(p.windows(at_p, s), return_inverse=True)
    hash_t = t.windows(at_t, s)
    kind_t = np.searchsorted(classes, hash_t)
    kind_t[kind_t == len(classes)] = 0
    at_t, kind_t = at_t[classes[kind_t] == hash_t], kind_t[classes[kind_t] == hash_t]
    # The word before: 0 and 1 where there is none to go on with, which never are the same.
    before = np.unique(np.concatenate((p.h, t.h)))
    prev_p = np.where((at_p > 0) & free_p[at_p - 1], np.searchsorted(before, p.h[at_p - 1]) + 2, 0)
    prev_t = np.where((at_t > 0) & free_t[at_t - 1], np.searchsorted(before, t.h[at_t - 1]) + 2, 1)
    code_p, code_t, span = kind_p * (len(before) + 2) + prev_p, kind_t * (len(before) + 2), len(before) + 2
    order = np.argsort(code_p, kind="stable")
    ranked = code_p[order]
    low, high = np.searchsorted(ranked, code_t), np.searchsorted(ranked, code_t + span)
    same_low, same_high = np.searchsorted(ranked, code_t + prev_t), np.searchsorted(ranked, code_t + prev_t, "right")
    starts, counts = np.concatenate((low, same_high)), np.concatenate((same_low - low, high - same_high))
    rep = np.repeat(np.arange(len(starts)), counts)
    step = np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts)
    i, j = at_p[order[starts[rep] + step]], at_t[rep % max(1, len(at_t))]
    same = np.ones(len(i), dtype=bool)
    for k in range(s):
        same &= p.h[i + k] == t.h[j + k]
    i, j = i[same], j[same]
    length, live = np.full(len(i), s), np.arange(len(i))
    while len(live):
        a, b = i[live] + length[live], j[live] + length[live]
        live, a, b = (x[(a < len(p.h)) & (b < len(t.h))] for x in (live, a, b))
        live = live[free_p[a] & free_t[b] & (p.h[a] == t.h[b])]
        length[live] += 1
    return list(zip(length.tolist(), i.tolist(), j.tolist(), strict=True))


class Seeds:
    """Inverted index of the seeds of one block of items."""

    def __init__(self, ids: list, items: list[np.ndarray], min_tile: int = MIN_TILE):
        self.min_tile = min_tile
        self.ids, self.items = ids, items
        seed, owner, at = [], [], []
        for k, h in enumerate(items):
            if len(h) >= min_tile:
                own = shingles(h, min_tile)
                seed.append(own)
                owner.append(np.full(len(own), k))
                at.append(np.arange(len(own)))
        empty = [np.zeros(0, np.uint64)]
        seeds = np.concatenate(seed or empty)
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.owner = np.concatenate(owner or [np.zeros(0, np.int64)])[order]
        self.at = np.concatenate(at or [np.zeros(0, np.int64)])[order]
        self.bits = 20
        while (1 << self.bits) < 64 * len(self.seeds) and self.bits < 27:
            self.bits += 1
        self.lengths = np.array([len(h) for h in items] or [0])
        marks = np.zeros(1 << self.bits, dtype=bool)
        marks[self.seeds >> np.uint64(64 - self.bits)] = True
        self.maybe = np.packbits(marks, bitorder="little")  # 16 MB at most

    def candidates(self, found: np.ndarray) -> np.ndarray:
        """Positions of a document's windows that may be seeds."""
        bit = found >> np.uint64(64 - self.bits)
        return np.flatnonzero((self.maybe[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)

    def pairs(self, h: np.ndarray, found: np.ndarray, maybe: np.ndarray, min_coverage: float) -> Iterator[tuple[int, float, int]]:
        """(item number, coverage, tiles) of the items that ``h`` covers enough of."""
        seen, back = np.unique(found[maybe], return_inverse=True)
        low, high = np.searchsorted(self.seeds, seen, "left"), np.searchsorted(self.seeds, seen, "right")
        n = high - low
        if not n.any():
            return
        which = np.repeat(np.arange(len(seen)), n)
        entry = np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        owner, at = self.owner[entry], self.at[entry]
        order = np.lexsort((at, owner))
        owner, at, which = owner[order], at[order], which[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        ends = np.r_[first[1:], len(owner)]
        # Words of each item that its seeds cover: up to the next seed, or a whole window.
        reach = np.r_[at[1:] - at[:-1], self.min_tile]
        reach[ends - 1] = self.min_tile
        covered = np.add.reduceat(np.minimum(reach, self.min_tile), first)
        for g in np.flatnonzero(covered >= min_coverage * self.lengths[owner[first]]).tolist():
            mine, k = slice(first[g], ends[g]), int(owner[first[g]])
            item = self.items[k]
            hit = np.zeros(len(seen), dtype=bool)
            hit[which[mine]] = True
            free = _spread(maybe[hit[back]], self.min_tile, len(h))
            near = np.flatnonzero(free)
            part = slice(int(near[0]), int(near[-1]) + 1)
            tiles = tile(item, h[part], self.min_tile, free[part])
            share = sum(x[2] for x in tiles) / len(item)
            if share >= min_coverage:
                yield k, share, len(tiles)


def _spread(at: np.ndarray, width: int, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, np.minimum(at + width, n), -1)
    return np.cumsum(marks[:n]) > 0


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, min_tile: int) -> Iterator[Seeds]:
    """The items in blocks of at most ``BLOCK_WORDS`` words (or one longer item)."""
    ids, items, held = [], [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        h = hash_words([row[1].lower()], "alnum")[0]
        if held and held + len(h) > BLOCK_WORDS:
            yield Seeds(ids, items, min_tile)
            ids, items, held = [], [], 0
        ids.append(row[0])
        items.append(h)
        held += len(h)
    if items:
        yield Seeds(ids, items, min_tile)


def _scan(batch: pa.RecordBatch, text_col: str, seeds: Seeds, min_coverage: float) -> Iterator[tuple[int, int, float, int]]:
    """(row, item number, coverage, tiles) of all overlaps in a batch."""
    for run in words(lowered(batch.column(text_col)), "alnum"):
        found, bounds = run_shingles(run, seeds.min_tile)
        maybe = seeds.candidates(found)
        own = np.searchsorted(maybe, bounds)
        for i in np.flatnonzero(np.diff(own)).tolist():
            mine = maybe[own[i] : own[i + 1]] - bounds[i]
            for k, share, tiles in seeds.pairs(run.of(i), found[bounds[i] : bounds[i + 1]], mine, min_coverage):
                yield run.first + i, k, share, tiles


def overlaps(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tile: int = MIN_TILE,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """(id, item, coverage, tiles) for every document that covers enough of an item."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType())])
    out, waiting, held = df.sparkSession.createDataFrame([], schema), None, None
    for seeds in _blocks(benchmark, item_col, item_text_col, min_tile):
        if waiting is not None:  # a benchmark of several blocks: one broadcast at a time
            out = out.unionByName(cut(waiting))
            held.unpersist()
        held = df.sparkSession.sparkContext.broadcast(seeds)

        def run(batch: pa.RecordBatch, held=held) -> dict:
            seeds = held.value
            rows = list(_scan(batch, text_col, seeds, min_coverage))
            return {
                id_col: batch.column(id_col).take(pa.array([r[0] for r in rows], pa.int64())),
                item_col: pa.array([seeds.ids[r[1]] for r in rows]),
                "coverage": pa.array([r[2] for r in rows], pa.float64()),
                "tiles": pa.array([r[3] for r in rows], pa.int32()),
            }

        waiting = map_arrow(df.select(id_col, text_col), run, schema)
    return out if waiting is None else out.unionByName(waiting)


def drop_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    min_tile: int = MIN_TILE,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """Rows of ``df`` that don't cover ``min_coverage`` of any benchmark item."""
    numbered = benchmark.select(F.lit(0).alias("item_id"), F.col(item_text_col).alias("text"))
    held = None
    for seeds in _blocks(numbered, "item_id", "text", min_tile):
        if held is not None:
            df = cut(df)
            held.unpersist()
        held = df.sparkSession.sparkContext.broadcast(seeds)

        def run(batch: pa.RecordBatch, held=held) -> dict:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[r[0] for r in _scan(batch, text_col, held.value, min_coverage)]] = False
            kept = batch.filter(pa.array(keep))
            return {c: kept.column(c) for c in kept.schema.names}

        df = map_arrow(df, run, df.schema)
    return df
