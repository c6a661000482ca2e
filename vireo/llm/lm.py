"""Language-model scoring of whole documents.

Word counts come from all training texts. The recurrent model (``gru``) begins
with WARM_DOCS whole texts on the driver; then each task goes on from there
with all of its training texts, whole, and the models of all tasks are
averaged by the tokens they saw. So it learns from every training text.
Both score every whole text: an add-one unigram base, and the recurrent model, whose words without
vectors share their class's probability by their counts.

Scale: counts are summed per task with NumPy, then by key. The words above a
count threshold, at most TABLE_WORDS of them (20 MB), travel to the tasks; the
threshold comes from a histogram of at most 512 cells. Rarer words meet their
counts in a shuffled join. They are rare in the training texts by choice, so
none of them is a hot key there. What the texts pass through the model for is
kept in the checkpoint folder, so the model runs once. A task's model is half a
megabyte of differences from the first one; they are summed FAN_IN at a time on the executors
until FAN_IN are left for the driver. A task trains in lots of TRAIN_TOKENS and one text at most, so its memory has a bound beside its longest text.
Which texts one task sees depends on how the table is partitioned, and so, slightly, do the scores.

Defined results: null text reads as empty and scores its end alone; a null id
reads as empty text in the split; without training texts N and V are 0, every
token is unknown; rows that repeat get equal scores; a very long text is scored
whole, its state carried on; columns other than id and text are not looked at;
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.llm import gru
from vireo.llm.common import cut, map_arrow, map_partitions_arrow
from vireo.llm.words import Words, words

#: Texts that the model begins with, of up to WARM_CHARS characters each; what comes after are all texts.
WARM_DOCS, WARM_CHARS = 1500, 1 << 16
#: All training texts are then learned from in lots of so many tokens, in so many streams, at this rate.
TRAIN_TOKENS = 1 << 18
TUNE_STREAMS, TUNE_RATE = 64, 0.002
#: A longer text is learned from in pieces, whose state begins anew, so that no stream is much longer than the others.
PIECE = TRAIN_TOKENS // TUNE_STREAMS
FAN_IN = 32
TABLE_WORDS = 1 << 20
LOT_TOKENS = 1 << 20


def endings(run: Words) -> np.ndarray:
    """Ending class of each word: its last three bytes, A-Z as a-z, hashed."""
    acc = np.zeros(len(run.ends), dtype=np.int64)
    for k, factor in ((1, 31), (2, 7919), (3, 104729)):
        inside = run.ends - run.starts >= k
        b = np.where(inside, run.data[np.maximum(run.ends - k, 0)], 0).astype(np.int64)
        acc += np.where((b >= 65) & (b <= 90), b + 32, b) * factor
    return acc % 1000003 % gru.ENDINGS


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, ending, n): words of all texts, A-Z lower-cased, as 64-bit hashes."""

    def count(batch: pa.RecordBatch) -> dict:
        runs = [(run.hashes, endings(run).astype(np.int16)) for run in words(batch.column(text_col), "white")]
        hashes, ends = (np.concatenate(x) for x in zip(*runs, strict=True))
        h, at, n = np.unique(hashes, return_index=True, return_counts=True)
        return {"word": pa.array(h.view(np.int64)), "ending": pa.array(ends[at].astype(np.int32)), "n": pa.array(n.astype(np.int64))}

    return map_arrow(df.select(text_col), count, "word long, ending int, n long").groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def _cell():
    return F.floor(F.log2("n") * 8)


def table_threshold(counts: DataFrame, most: int = TABLE_WORDS) -> int:
    """The least cell of log counts above and with which at most ``most`` words stand."""
    cells = counts.groupBy(_cell().alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, 1 << 20
    for r in sorted(cells, key=lambda r: -r["cell"]):
        held += r["n"]
        if held > most:
            break
        least = r["cell"]
    return least


class Table:
    """Sorted word hashes with their counts, looked up through a directory of leading bits."""

    def __init__(self, words_: np.ndarray, counts: np.ndarray):
        order = np.argsort(words_)
        self.words, self.counts = words_[order], counts[order]
        self.bits = max(1, int(len(self.words)).bit_length())
        self.directory = np.searchsorted(self.words >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in ``words``, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.directory[slot], self.directory[slot + 1]
        out = np.full(len(h), -1, dtype=np.int64)
        todo = np.flatnonzero(at < stop)
        at, stop = at[todo], stop[todo]
        while len(todo):
            hit = self.words[at] == h[todo]
            out[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < stop)
            todo, at, stop = todo[more], at[more], stop[more]
        return out


@dataclass
class Scorer:
    model: gru.Model
    table: Table
    ids: np.ndarray  # model id of each table word, -1 for those of an ending class
    shares: np.ndarray  # what the words of an ending class sum to, plus one each and one unknown
    total: int  # N
    distinct: int  # V
    ends: int  # training count of the end
    trained: int = 0  # tokens that all tasks learned from

    @property
    def base(self) -> float:
        return float(self.total + self.distinct + 1)

    def encode(self, run: Words) -> tuple[np.ndarray, np.ndarray]:
        """(model ids, places in the table) of the words of a run."""
        place = self.table.find(run.hashes)
        ids = np.where(place >= 0, self.ids[place] if len(self.ids) else -1, -1)
        return np.where(ids < 0, self.model.shape.words + endings(run), ids), place

    def local(self, ids: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: base and model log10 without the counts of words not in the table, and known tokens.

        ``bounds`` are of the words; each text has one end more.
        """
        shape, n_docs = self.model.shape, len(bounds) - 1
        with_end = bounds + np.arange(n_docs + 1)
        all_ids = np.full(len(ids) + n_docs, shape.end, dtype=np.int64)
        seat = np.arange(len(ids)) + np.repeat(np.arange(n_docs), np.diff(bounds))
        all_ids[seat] = ids
        counts = np.full(len(all_ids), float(self.ends))
        counts[seat] = np.where(place >= 0, self.table.counts[place] if len(self.table.counts) else 0, 0)
        chance = np.exp(self.model.score(all_ids, with_end))
        rest = (all_ids >= shape.words) & (all_ids < shape.end)
        weight = np.where(rest, counts + 1.0, 1.0)
        share = np.where(rest, self.shares[np.where(rest, all_ids - shape.words, 0)], 1.0)
        plain = np.where(rest, 1.0, counts + 1.0) / self.base
        mixed = np.log10(weight) + np.log10(gru.MIX * chance / share + (1 - gru.MIX) * plain)
        known = np.zeros(len(all_ids))
        known[seat] = place >= 0
        known[with_end[1:] - 1] = self.ends > 0
        add = lambda x: np.add.reduceat(x, with_end[:-1]) if n_docs else np.zeros(0)
        return add(np.log10(counts + 1.0)) - np.diff(with_end) * np.log10(self.base), add(mixed), add(known)


def fit(train: DataFrame, counts: DataFrame, n_docs: int, text_col: str = "text", warm_docs: int = WARM_DOCS) -> tuple[Scorer, int]:
    """(scorer, cell threshold of its table) from all training texts and their counts."""
    least = table_threshold(counts)
    held = counts.where(_cell() >= least).select("word", "n", "ending").toArrow()
    word = held["word"].to_numpy().view(np.uint64)
    n, ending = held["n"].to_numpy(), held["ending"].to_numpy()
    table = Table(word, n)
    order = np.argsort(word)
    ending = ending[order]
    top = np.lexsort((table.words, -table.counts))[: gru.WORDS]
    ids = np.full(len(table.words), -1, dtype=np.int64)
    ids[top] = np.arange(len(top))
    shape = gru.Shape(len(top))
    sums = {r["ending"]: (r["n"], r["words"]) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
    mass, kinds = np.zeros(gru.ENDINGS), np.zeros(gru.ENDINGS)
    for k, (a, b) in sums.items():
        mass[k], kinds[k] = a, b
    np.subtract.at(mass, ending[top], table.counts[top])
    np.subtract.at(kinds, ending[top], 1)
    total = int(sum(a for a, _ in sums.values())) + n_docs
    distinct = int(sum(b for _, b in sums.values())) + (n_docs > 0)
    model = gru.Model(shape, np.concatenate((table.counts[top], mass, [n_docs])).astype(np.float64))
    scorer = Scorer(model, table, ids, mass + kinds + 1.0, total, distinct, n_docs)
    if n_docs:
        at = train.select(F.pmod(F.xxhash64(text_col, *[c for c in train.columns if c != text_col], F.lit(5)), F.lit(1 << 30)).alias("draw"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        first = at.where(F.length("text") <= WARM_CHARS)
        picked = first.where(F.col("draw") < int((1 << 30) * min(1.0, 2 * warm_docs / n_docs))).orderBy("draw", F.xxhash64("text")).limit(warm_docs).select("text").toArrow()
        texts = _coded(picked["text"].combine_chunks(), scorer)
        texts.sort(key=lambda t: (len(t), t.tobytes()))  # whatever order the rows came in
        if texts:
            model.train(texts)
        scorer.trained = _tune(at.select("text"), scorer)
    return scorer, least


def _coded(column: pa.Array, scorer: Scorer) -> list[np.ndarray]:
    """Model ids of each text, with its end."""
    out = []
    for run in words(column, "white"):
        own, _ = scorer.encode(run)
        out += [np.append(own[run.bounds[i] : run.bounds[i + 1]], scorer.model.shape.end) for i in range(run.n)]
    return out


def _tune(texts: DataFrame, scorer: Scorer) -> int:
    """Train on in all tasks and put the mean of their models in the scorer's place; returns the tokens seen."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(scorer)

    def learn(batches):
        model, start = None, shared.value.model.flat()
        seen, lot, held = 0, [], 0
        for batch in batches:
            for own in _coded(batch.column("text"), shared.value):
                lot += [own[k : k + PIECE] for k in range(0, len(own), PIECE)]
                held += len(own)
                if held >= TRAIN_TOKENS:
                    model = model or shared.value.model.copy()
                    model.train(lot, streams=TUNE_STREAMS, rate=TUNE_RATE)
                    seen, lot, held = seen + held, [], 0
        if lot:
            model = model or shared.value.model.copy()
            model.train(lot, streams=TUNE_STREAMS, rate=TUNE_RATE)
            seen += held
        if model is not None:
            yield {"tokens": [seen], "change": [(model.flat() - start).astype(np.float16).tobytes()]}

    def merge(batches):
        seen, total = 0, None
        for batch in batches:
            for n, change in zip(batch.column("tokens").to_pylist(), batch.column("change"), strict=True):
                own = np.frombuffer(change.as_buffer(), np.float16).astype(np.float32) * n
                seen, total = seen + n, own if total is None else total + own
        if seen:
            yield {"tokens": [seen], "change": [(total / seen).astype(np.float16).tobytes()]}

    made = cut(map_partitions_arrow(texts, learn, "tokens long, change binary"))
    while (n := made.count()) > FAN_IN:
        made = cut(map_partitions_arrow(made.repartition(-(-n // FAN_IN)), merge, "tokens long, change binary"))
    last = list(merge(made.toArrow().to_batches()))
    if last:
        scorer.model.add(np.frombuffer(last[0]["change"][0], np.float16).astype(np.float32))
    shared.unpersist()
    return last[0]["tokens"][0] if last else 0


def score(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", held_out=None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a boolean column: rows that neither counts nor model learn from.
    """
    held = F.lit(False) if held_out is None else held_out
    named = df.select(F.col(id_col).alias("id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = named.where(~F.col("held_out"))
    counts = cut(word_counts(train))
    scorer, least = fit(train, counts, train.count())
    shared = df.sparkSession.sparkContext.broadcast(scorer)
    schema = T.StructType([named.schema["id"], *T._parse_datatype_string("held_out boolean, n_tokens long, known long, base double, own double, rare array<long>").fields])

    def run(batch: pa.RecordBatch):
        lot: list[Words] = []
        held, first = 0, 0
        for part in words(batch.column("text"), "white"):
            lot.append(part)
            held += len(part.hashes)
            if held >= LOT_TOKENS:
                yield _scored(batch, lot, first, shared.value)
                first, held, lot = part.first + part.n, 0, []
        if lot:
            yield _scored(batch, lot, first, shared.value)

    rows = cut(map_arrow(named, run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = counts.where(_cell() < least).select("word", "n")
    met = rows.select("row", F.explode("rare").alias("word")).join(rare, "word")
    more = met.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return rows.join(more, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(scorer.total).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), (F.col("own") + gain).alias("score"),
    )


def _scored(batch: pa.RecordBatch, lot: list[Words], first: int, scorer: Scorer) -> dict:
    """Result columns of the documents of some runs, which follow each other from row ``first``."""
    coded = [scorer.encode(run) for run in lot]
    ids, place = (np.concatenate(x) for x in zip(*coded, strict=True))
    lengths = np.concatenate([np.diff(run.bounds) for run in lot])
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    base, own, known = scorer.local(ids, place, bounds)
    hashes = np.concatenate([run.hashes for run in lot])
    far = np.flatnonzero(place < 0)
    n = len(lengths)
    return {
        "id": batch.column("id").slice(first, n),
        "held_out": batch.column("held_out").slice(first, n),
        "n_tokens": pa.array(lengths + 1, pa.int64()),
        "known": pa.array(np.round(known).astype(np.int64)),
        "base": pa.array(base),
        "own": pa.array(own),
        "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(far, bounds), pa.int32()), pa.array(hashes[far].view(np.int64))),
    }
