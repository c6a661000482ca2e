"""Planted-partition graphs with attributes, labels and rounds of changes, from hash-derived numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import rng
from vireo.operators.graph import canonical, dense_index
from vireo.runtime import cut


@dataclass
class Synthetic:
    edges: DataFrame  # u, v
    attributes: DataFrame  # node_id, vec
    labels: DataFrame  # node_id, label


def planted_partition(spark: SparkSession, nodes: int, classes: int, p_in: float, p_out: float, seed: int, features: int = 0, noise: float = 0.28) -> Synthetic:
    """Nodes 0..n-1 with class id mod ``classes``; pairs are linked with p_in or p_out.

    All pairs are drawn, so it is for small graphs, as those that it stands for.
    """
    ids = spark.range(nodes)
    a, b = ids.toDF("u"), ids.toDF("v")
    same = F.col("u") % classes == F.col("v") % classes
    drawn = a.join(b, F.col("u") < F.col("v")).where(rng.uniform(seed, F.col("u"), F.col("v")) < F.when(same, p_in).otherwise(p_out))
    label = (F.col("id") % classes).cast("long")
    center = [rng.normal(seed, F.lit("center"), label, j) for j in range(features)]
    spread = [rng.normal(seed, F.lit("noise"), F.col("id"), j) for j in range(features)]
    vec = F.array(*[c + noise * s for c, s in zip(center, spread, strict=True)]) if features else F.array().cast("array<double>")
    return Synthetic(drawn, ids.select(F.col("id").alias("node_id"), vec.alias("vec")), ids.select(F.col("id").alias("node_id"), label.alias("label")))


def planted_links(nodes: DataFrame, inside: int, anywhere: int, seed: int) -> DataFrame:
    """(u, v), u < v distinct: each of ``nodes`` (node_id, label) draws ``inside`` partners of its label and ``anywhere`` partners of all.

    Partners are drawn by their rank in order of (label, node_id), so links are found by joins on ranks, and no pairs are made but those drawn.
    """
    ranked = cut(dense_index(nodes.select("node_id", "label").withColumn("_key", F.struct("label", "node_id")), "_key", "rank").drop("_key"))
    groups = ranked.groupBy("label").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n"))
    total = ranked.count()
    placed = ranked.join(groups, "label")
    drawn = lambda kind, k, n: F.floor(rng.uniform(seed, kind, F.col("node_id"), k) * n).cast("long")
    ranks = [F.col("start") + drawn("in", k, F.col("n")) for k in range(inside)] + [drawn("out", k, F.lit(total)) for k in range(anywhere)]
    pairs = placed.select("node_id", F.explode(F.array(*ranks)).alias("rank")).join(ranked.select("rank", F.col("node_id").alias("partner")), "rank")
    return canonical(pairs, "node_id", "partner")


def change_rounds(graph: Synthetic, nodes: int, rounds: int, seed: int, features: int, toggles: int = 3, draws: int = 2) -> tuple[DataFrame, DataFrame]:
    """((snap, op, u, v), (snap, node_id, vec)): each round flips pairs and redraws attributes.

    An edge that a round finds present is removed, else added.
    """
    spark = graph.edges.sparkSession
    r = spark.range(1, rounds + 1).toDF("snap")
    pick = lambda *k: F.floor(rng.uniform(seed, *k) * nodes).cast("long")
    trials = r.join(spark.range(toggles).toDF("k"), F.lit(True)).select("snap", "k", pick(F.lit("u"), F.col("snap"), F.col("k")).alias("x"), pick(F.lit("v"), F.col("snap"), F.col("k")).alias("y")).where("x <> y")
    flips = trials.select("snap", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    from pyspark.sql import Window as W

    known = flips.join(graph.edges.withColumn("_have", F.lit(1)), ["u", "v"], "left")
    turn = F.row_number().over(W.partitionBy("u", "v").orderBy("snap")) + F.when(F.col("_have").isNull(), 0).otherwise(1)
    edges = known.select("snap", F.when(turn % 2 == 1, "add").otherwise("remove").alias("op"), "u", "v")
    attrs = r.join(spark.range(draws).toDF("k"), F.lit(True)).select("snap", pick(F.lit("node"), F.col("snap"), F.col("k")).alias("node_id"), "k")
    vec = F.array(*[rng.normal(seed, F.lit("redraw"), F.col("snap"), F.col("k"), j) for j in range(features)])
    redrawn = attrs.select("snap", "node_id", "k", vec.alias("vec"))
    return edges, redrawn.groupBy("snap", "node_id").agg(F.max_by("vec", "k").alias("vec"))
