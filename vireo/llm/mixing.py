"""Mixing sources to target weights by weighted fair queueing.

Every source serves its documents in shuffled order (a seeded hash of the id),
up to ``passes`` times over. A document's virtual finish time is its source's
cumulative tokens, this document included, divided by the source's target. All
documents are put in the order of virtual finish time and taken until the
total budget is used up, so every source is served in proportion to its target.

Scale: cumulative sums run over 4,096 hash ranges per source (partial sums per
range, a prefix over the ranges, a running sum inside one range), so a source
with a third of all rows is spread over 4,096 windows. The global order needs
no sort of all rows: virtual time is itself the range key. Tokens per coarse
and then fine range of virtual time are summed, the range where the budget ends
is found, only that range is sorted exactly, and the last taken entry's sort
key decides for every row locally.

Defined results: null text has size 0 and takes 0; null sources are one source,
ordered last; rows with equal ids and sizes share their place; an empty table,
or one without any word, takes nothing; reruns agree as the order depends on
the seed and the rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.llm.common import cut, free_name, map_arrow
from vireo.llm.lines import document_key
from vireo.llm.words import spans, string_buffers

WEIGHTS = (5, 2, 1)
PASSES = 3
SEED = 17
RANGE_HEX = 3
COARSE, FINE = 1 << 10, 1 << 20


def count_words(column: pa.Array, chunk: int = 1 << 20) -> np.ndarray:
    """Runs of ``[^\\x20\\x09-\\x0D]+`` in each text; null counts as empty."""
    data, offsets = string_buffers(column)
    out, first, n = np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, side="right")) - 1))
        own = offsets[first : last + 1]
        out[first:last] = np.diff(spans(data[own[0] : own[-1]], own, "white")[2])
        first = last
    return out


def with_sizes(df: DataFrame, text_col: str, size_col: str) -> DataFrame:
    """``df`` without its text, with the word count."""
    rest = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(size_col, T.LongType())])

    def size(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in rest} | {size_col: count_words(batch.column(text_col))}

    return map_arrow(df, size, schema)


def source_targets(sizes: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per source: (src, source_size, target).

    Weights repeat over the sources in code point order, null last. The budget
    is the sum of all sizes. A target stops at ``passes`` times its source's
    size; what it can't use goes to the others by weight, until none is above:
    sources stop in the order of size per weight, so one pass over the running
    sums finds the level at which the rest stay below.
    """
    order = W.orderBy(F.col("src").asc_nulls_last())
    nth = F.row_number().over(order)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((nth - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size")).select("src", "source_size", nth.alias("nth"), pick.alias("weight"))
    most = (F.col("source_size") * passes).cast("double")
    by_rate = W.orderBy(most / F.col("weight"), "nth")
    before = by_rate.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    per = per.select(
        "*",
        most.alias("most"),
        (F.sum("source_size").over(everyone).cast("double") - F.coalesce(F.sum(most).over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    level = F.min(F.when(F.col("left") / F.col("weight_left") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "nth", (F.col("left") / F.col("weight_left")).alias("level")))).over(everyone)
    return per.select("src", "nth", "source_size", F.coalesce(F.least(F.col("most"), level["level"] * F.col("weight")), F.lit(0.0)).alias("target"))


def mix(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights=WEIGHTS,
    passes: int = PASSES,
    seed: int = SEED,
) -> DataFrame:
    """(id, size, source_size, target, taken) for every row of ``df``.

    ``taken`` is the number of words the mix takes from the document: its size
    times the passes that take it.
    """
    named = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.col(text_col).alias("text"))
    return _served(named, weights, passes, seed).withColumnRenamed("id", id_col)


def _served(named: DataFrame, weights, passes: int, seed: int) -> DataFrame:
    """``named`` (id, src, text and others) without src and text, served by fair queueing."""
    rest = [c for c in named.columns if c not in ("src", "text")]
    sizes = cut(with_sizes(named, "text", "size"))
    shuffled = sizes.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    shuffled = shuffled.withColumn("slot", F.substring("draw", 1, RANGE_HEX)).withColumn("named", F.col("src").isNotNull()).withColumn("src0", F.coalesce("src", F.lit("")))
    targets = source_targets(sizes, weights, passes).withColumn("named", F.col("src").isNotNull()).withColumn("src0", F.coalesce("src", F.lit("")))
    ranges = shuffled.groupBy("named", "src0", "slot").agg(F.sum("size").alias("part"))
    prefix = W.partitionBy("named", "src0").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("named", "src0", "slot", F.coalesce(F.sum("part").over(prefix), F.lit(0)).alias("ahead"))
    starts = starts.join(targets.drop("src"), ["named", "src0"])
    inside = W.partitionBy("named", "src0", "slot").orderBy("draw", F.col("id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    queued = shuffled.drop("src").withColumn("run", F.sum("size").over(inside)).join(starts, ["named", "src0", "slot"]).withColumn("through", F.col("ahead") + F.col("run"))
    queued = cut(queued.select(*rest, "draw", "size", "nth", "source_size", "target", "through"))

    budget = sizes.agg(F.sum("size")).first()[0] or 0
    finish = [(F.col("source_size") * p + F.col("through")) / F.col("target") for p in range(passes)]
    entry = [F.struct(finish[p].alias("finish"), F.col("nth"), F.lit(p).alias("round"), F.col("draw"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id0"), F.col("size").alias("words")) for p in range(passes)]
    entries = queued.where("size > 0 and target > 0").select(F.explode(F.array(*entry)).alias("e"))
    last = _last_taken(entries, budget)
    if last is None:
        taken = F.lit(0).cast("long")
    else:
        stop = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["nth"]).alias("nth"), F.lit(last["round"]).alias("round"), F.lit(last["draw"]).alias("draw"), F.lit(last["id0"]).alias("id0"), F.lit(last["words"]).cast("long").alias("words"))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((F.when(e <= stop, F.col("size")).otherwise(0) for e in entry), F.lit(0))).otherwise(0).cast("long")
    return queued.select(*rest, "size", "source_size", "target", taken.alias("taken"))


def _last_taken(entries: DataFrame, budget: int):
    """The entry in (finish, nth, round, draw, id, words) order at which the budget ends."""
    spent, where = 0, F.lit(True)
    for grain in (COARSE, FINE):
        cell = F.floor(F.col("e.finish") * grain)
        cells = entries.where(where).groupBy(cell.alias("cell")).agg(F.sum("e.words").alias("words"))
        run = F.sum("words").over(W.orderBy("cell"))
        first = cells.select("cell", (F.lit(spent) + run).alias("through"), "words").where(F.col("through") >= budget).orderBy("cell").first()
        if first is None:
            top = entries.agg(F.max("e")).first()[0]
            return top
        spent = first["through"] - first["words"]
        where = where & (cell == first["cell"])
    rank = entries.where(where).select("e", (F.lit(spent) + F.sum("e.words").over(W.orderBy("e"))).alias("through"))
    got = rank.where(F.col("through") <= budget).agg(F.max("e")).first()[0]
    if got is None:  # the budget ends inside the first entry of this cell: the one before the cell is the last
        got = entries.where(cell < first["cell"]).agg(F.max("e")).first()[0]
    return got


def keep_mixed(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights=WEIGHTS,
    passes: int = PASSES,
    seed: int = SEED,
) -> DataFrame:
    """Rows of ``df`` that the mix takes, with (size, source_size, target, taken, copies).

    ``copies`` is how many times over the document is served. Rows equal in id
    and text are told apart by a running number, which is the same set of
    decisions whichever row gets which.
    """
    key, copy = free_name(df, "mix_key"), free_name(df, "mix_copy")
    made = [free_name(df, c) for c in ("size", "source_size", "target", "taken", "copies")]
    keyed = df.withColumn(key, document_key(F.col(id_col), F.col(text_col)))
    named = keyed.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.col(text_col).alias("text"), F.col(key).alias("key"))
    served = _served(named, weights, passes, seed).where("taken > 0")
    # Of equal rows, those that are taken more often come first on both sides.
    served = served.select(
        F.col("key").alias(key),
        F.row_number().over(W.partitionBy("key").orderBy(F.desc("taken"), "source_size", "target")).alias(copy),
        *[F.col(c).alias(n) for c, n in zip(("size", "source_size", "target", "taken"), made, strict=False)],
        (F.col("taken") / F.col("size")).cast("long").alias(made[4]),
    )
    order = W.partitionBy(key).orderBy(F.col(source_col).asc_nulls_last())
    numbered = keyed.withColumn(copy, F.row_number().over(order))
    return numbered.join(served, [key, copy]).select(*df.columns, *made)
