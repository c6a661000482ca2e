"""Language identification by rank-order n-gram profiles.

A text's letters are folded to lower case, everything else to single blanks.
Its most frequent byte n-grams (1 to 3 bytes of UTF-8) in order of frequency
are its profile. A language's profile is that of all its training texts
together. A text gets the language at the least out-of-place distance: the sum
over its profile of the difference in rank, or the profile length where the
language lacks the n-gram.

Scale: training counts n-grams per task and language with NumPy and sums them
by key; only the profiles (PROFILE n-grams for each language) come to the
driver. Prediction is one pass over the texts without a shuffle.

Defined results: null text, or text without a letter, is ``und`` with score 0;
ties go to the first language in code point order; without any training text
every language is ``und``; rows that repeat get equal predictions; a very long
text is judged whole; all other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.llm.common import free_name, map_arrow
from vireo.llm.words import string_buffers

UNKNOWN = "und"
PROFILE = 400
N_MAX = 3
_CHUNK = 1 << 20
_TABLE = np.full(256, 32, dtype=np.uint8)
_TABLE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE[128:] = np.arange(128, 256)
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text))))


def gram_codes(data: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of 1 to N_MAX bytes of folded text; the blank alone is none."""
    b = _TABLE[data]
    b = np.concatenate(([np.uint8(32)], b, [np.uint8(32)]))
    blank = b == 32
    b = b[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    parts = [b[b != 32]]
    for n in range(2, N_MAX + 1):
        if len(b) >= n:
            code = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                code |= b[i : len(b) - n + 1 + i] << np.uint32(8 * i)
            parts.append(code)
    return np.concatenate(parts)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[edge], np.diff(np.concatenate((edge, [len(codes)])))


def top(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The ``k`` most frequent codes, most frequent first, ties by code."""
    key = (counts.astype(np.int64) << 32) - codes.astype(np.int64)
    if len(key) > k:
        pick = np.argpartition(key, len(key) - k)[len(key) - k :]
        codes, key = codes[pick], key[pick]
    return codes[np.argsort(-key)]


def train(df: DataFrame, text_col: str, lang_col: str, k: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language from all rows of ``df`` with a language."""

    def count(batch: pa.RecordBatch):
        langs = batch.column(lang_col)
        texts = pc.utf8_lower(batch.column(text_col))
        for lang in pc.unique(langs).to_pylist():
            own = texts.filter(pc.equal(langs, lang))
            data, offsets = string_buffers(own)
            first, n = 0, len(offsets) - 1
            while first < n:
                last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, side="right")) - 1))
                # A blank between texts, so that no n-gram spans two of them.
                run = np.insert(data[offsets[first] : offsets[last]], offsets[first + 1 : last] - offsets[first], 32)
                codes, counts = counted(gram_codes(run))
                yield {"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes.astype(np.int32)), "n": pa.array(counts.astype(np.int64))}
                first = last

    known = df.select(lang_col, text_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    grams = map_arrow(known, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = grams.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("lang", "place", "gram").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"].encode(), r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, dtype=np.uint32) for lang, g in out.items()}


class Ranker:
    """Out-of-place distances of texts to a few language profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], k: int = PROFILE):
        self.langs: Sequence[str] = list(profiles)
        self.k = k
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint32)])).astype(np.uint32)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, own in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, own), j] = np.arange(len(own))

    def of(self, data: np.ndarray) -> tuple[str, float]:
        profile = top(*counted(gram_codes(data)), self.k)
        if not len(profile) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, profile)
        at[at >= len(self.grams)] = len(self.grams)
        hit = np.append(self.grams, np.uint32(0xFFFFFFFF))[at] == profile
        ranks = self.ranks[np.where(hit, at, len(self.grams))]
        off = np.abs(ranks - np.arange(len(profile))[:, None])
        far = np.where(ranks < 0, self.k, off).sum(axis=0)
        j = int(np.argmin(far))
        return self.langs[j], float(1.0 - far[j] / (self.k * len(profile)))


def predict(df: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", k: int = PROFILE) -> DataFrame:
    """``df`` with the predicted language and a score from 0 (far from all) to 1, under other names where it has such columns."""
    names = df.columns
    lang_out, score_out = free_name(df, lang_out), free_name(df, score_out)
    made: list[Ranker] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Ranker(profiles, k))
        column = batch.column(text_col)
        data, offsets = string_buffers(pc.utf8_lower(column))
        langs, scores = [], []
        for i, text in enumerate(column.to_pylist()):
            lang, score = made[0].of(data[offsets[i] : offsets[i + 1]]) if has_letter(text) else (UNKNOWN, 0.0)
            langs.append(lang)
            scores.append(score)
        return {c: batch.column(c) for c in names} | {lang_out: pa.array(langs, pa.string()), score_out: pa.array(scores, pa.float64())}

    return map_arrow(df, run, T.StructType([*df.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def held_out(id_col, folds: int = 3, fold: int = 1):
    """crc32 of the id as text, mod ``folds``, is ``fold``; a null id reads as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
