"""Cutting temporal edges into snapshots, and the deltas between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vireo.operators.graph import dense_index
from vireo.runtime import cut

#: Snapshots that one number holds as bits.
BITS = 62


def quantiles(df: DataFrame, value: str, probabilities: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation.

    Values are counted, dealt to ranges, and the order statistics are read off
    running sums inside the ranges: no task holds all distinct values.
    """
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")).repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total = sum(sums.values())
    if not total:
        return []
    ahead, offsets = 0, []
    for part in sorted(sums):
        offsets.append((part, ahead))
        ahead += sums[part]
    before = df.sparkSession.createDataFrame(offsets, "part int, before long")
    running = counted.join(F.broadcast(before), "part").select("x", (F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("x"))).alias("through"))
    spots = [p * (total - 1) for p in probabilities]
    ranks = sorted({int(s) for s in spots} | {min(total - 1, int(s) + 1) for s in spots})
    row = running.agg(*[F.min(F.when(F.col("through") > r, F.col("x"))) for r in ranks]).first()
    at = dict(zip(ranks, row, strict=True))
    out = []
    for s in spots:
        low, high = at[int(s)], at[min(total - 1, int(s) + 1)]
        out.append(low + (high - low) * (s - int(s)))
    return out


def window_bin(t: Column, cuts: list[float]) -> Column:
    """Bin i holds [cut i, cut i+1); the last bin is closed."""
    passed = sum((F.when(t >= c, 1).otherwise(0) for c in cuts[1:-1]), F.lit(0))
    return F.least(F.lit(max(0, len(cuts) - 2)), passed).cast("int")


def time_cuts(edges: DataFrame, snapshots: int, time: str = "t") -> list[float]:
    return quantiles(edges, time, [i / snapshots for i in range(snapshots + 1)])


def window_snapshots(edges: DataFrame, snapshots: int, time: str = "t", cuts: list[float] | None = None) -> DataFrame:
    """(snap, u, v) distinct: each edge in the bins of its times."""
    cuts = time_cuts(edges, snapshots, time) if cuts is None else cuts
    return edges.select(window_bin(F.col(time), cuts).alias("snap"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def cumulative_snapshots(binned: DataFrame, snapshots: int) -> DataFrame:
    """Snapshot i holds the edges of all bins up to i."""
    first = binned.groupBy("u", "v").agg(F.min("snap").alias("first"))
    return first.select(F.explode(F.sequence(F.col("first"), F.lit(snapshots - 1))).alias("snap"), "u", "v")


def equal_count_snapshots(edges: DataFrame, snapshots: int, order: list[str]) -> DataFrame:
    """(snap, u, v): edges in order, in bins of equal counts (at least two bins)."""
    k = max(2, snapshots)
    key = F.struct(*order)
    ranked = dense_index(edges.select("src", "dst", key.alias("_key")), "_key", "_rank")
    n = edges.count()
    cuts = [int(i * (n / k)) for i in range(1, k)]
    snap = sum((F.when(F.col("_rank") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    return ranked.select(snap.alias("snap"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def deltas(snaps: DataFrame) -> DataFrame:
    """(snap, op, u, v) for snapshots from 1 on: what each adds to and removes from the one before.

    One aggregate by edge: the snapshots that hold it are bits of a few numbers, and the changes are read off neighbouring bits.
    """
    last = snaps.agg(F.max("snap")).first()[0]
    if not last or last < 1:
        return snaps.limit(0).select("snap", F.lit("add").alias("op"), "u", "v")
    words = range(last // BITS + 1)
    bit = lambda w: F.when(F.floor(F.col("snap") / BITS) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("snap", F.lit(BITS)).cast("int"))).otherwise(0)
    held = snaps.where("snap >= 0").groupBy("u", "v").agg(*[F.bit_or(bit(w)).alias(f"_w{w}") for w in words])
    has = lambda s: F.getbit(F.get(F.array(*[f"_w{w}" for w in words]), F.floor(s / BITS).cast("int")), F.pmod(s, F.lit(BITS)).cast("int")) == 1
    changed = F.filter(F.sequence(F.lit(1), F.lit(last)), lambda s: has(s) != has(s - 1))
    out = held.select("u", "v", F.explode(changed).alias("snap"), *[f"_w{w}" for w in words])
    return out.select(F.col("snap").cast(snaps.schema["snap"].dataType), F.when(has(F.col("snap")), "add").otherwise("remove").alias("op"), "u", "v")


def apply_delta(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Additions first, then removals; self-loops are ignored. One aggregate by edge."""
    delta = delta.where("u <> v and op in ('add', 'remove')").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("op") == "remove").alias("_gone"))
    both = edges.select("u", "v", F.lit(False).alias("_gone")).union(delta)
    return both.groupBy("u", "v").agg(F.max("_gone").alias("_gone")).where("not _gone").select("u", "v")


def attribute_bin(t: Column, cuts: list[float]) -> Column:
    """First bin i with cut i <= t <= cut i+1, both ends closed; any other time is in the last bin."""
    last = len(cuts) - 2
    out = F.lit(last)
    for i in range(last, -1, -1):
        out = F.when((t >= cuts[i]) & (t <= cuts[i + 1]), i).otherwise(out)
    return out.cast("int")


def attribute_updates(updates: DataFrame, cuts: list[float], key: str, time: str, seq: str, value: str, initial: bool = False) -> DataFrame:
    """(snap, key, value): in each bin the row with the highest ``seq`` wins; bin 0 is left out unless ``initial``."""
    binned = updates.select(attribute_bin(F.col(time), cuts).alias("snap"), key, seq, value)
    won = binned.groupBy("snap", key).agg(F.max_by(value, seq).alias(value))
    return won if initial else won.where("snap > 0")
