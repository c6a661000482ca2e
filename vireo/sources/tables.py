"""Edge, feature, label and update tables from CSV, and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.functions import rng
from vireo.functions.text import epoch, identifier, number
from vireo.operators.graph import clean, dense_index, downsample_nodes, restrict, universe
from vireo.operators.snapshots import attribute_updates, cumulative_snapshots, deltas, equal_count_snapshots, time_cuts, window_snapshots
from vireo.runtime import cut
from vireo.sources.sinks import exists

FILES = ("edges.csv", "features.csv", "labels.csv")
UPDATES = "attr_updates.csv"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header required, every value text; a byte order mark is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def require(df: DataFrame, needed: tuple[str, ...], what: str, more: int = 0) -> list[str]:
    """The other columns; error if one is missing or there are fewer than ``more`` others."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    rest = [c for c in df.columns if c not in needed]
    if len(rest) < more:
        raise ValueError(f"{what} needs at least {more} value column(s)")
    return rest


def resolve(spark: SparkSession, root: str) -> tuple[str, str, str, str]:
    """Paths of the three required files and of the optional updates ("" if absent), on any store."""
    paths = [f"{root}/{f}" for f in FILES]
    for p in (root, *paths):
        if not exists(spark, p):
            raise FileNotFoundError(p)
    updates = f"{root}/{UPDATES}"
    return *paths, updates if exists(spark, updates) else ""


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.monotonically_increasing_id())


def edges(df: DataFrame) -> DataFrame:
    """(src, dst, t, seq) cleaned; without a time column t is null."""
    rest = require(df, ("src", "dst"), "edges")
    t = epoch(F.col("time")) if "time" in rest else F.lit(None).cast("double")
    return clean(_ordered(df).select("src", "dst", t.alias("t"), "seq"))


def vectors(df: DataFrame, what: str = "features", key: tuple[str, ...] = ("node_id",), width: int | None = None) -> DataFrame:
    """(key, vec, seq); an error names the first row with a value that is no finite number."""
    names = require(df, key, what, 1)
    if width is not None and len(names) != width:
        raise ValueError(f"{what} has {len(names)} values, not {width}")
    rows = cut(_ordered(df).select(*key, F.array(*[number(F.col(c)) for c in names]).alias("vec"), "seq").withColumn("node_id", identifier(F.col("node_id"))).where("node_id is not null"))
    bad = rows.where(F.exists("vec", lambda x: x.isNull())).select("node_id", "vec").limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {names[list(bad[0][1]).index(None)]} of node {bad[0][0]!r} is not a finite number")
    return rows


def last_wins(rows: DataFrame, value: str, key: str = "node_id") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, "seq").alias(value))


def with_defaults(nodes: DataFrame, known: DataFrame, width: int, seed: int) -> DataFrame:
    """(node_id, vec) of all ``nodes``: the vectors of ``known``, else 0.01 normals drawn by node."""
    filler = F.array(*[0.01 * rng.normal(seed, F.col("node_id"), j) for j in range(width)])
    return nodes.select("node_id").join(known, "node_id", "left").select("node_id", F.coalesce("vec", filler).alias("vec"))


def labels(df: DataFrame) -> DataFrame:
    """(node_id, label): numbers cut toward zero; negative is unlabelled; later rows win.

    A label that is no finite number of 64 bits (blank ones included) is an error that names its node, even where a later row would win.
    """
    require(df, ("node_id", "label"), "labels")
    rows = cut(_ordered(df).select(identifier(F.col("node_id")).alias("node_id"), F.col("label").try_cast("double").alias("x"), "seq").where("node_id is not null"))
    bad = rows.where(F.col("x").isNull() | F.isnan("x") | (F.abs("x") >= 2.0**63)).select("node_id").limit(1).collect()
    if bad:
        raise ValueError(f"labels: the label of node {bad[0][0]!r} is not a finite number")
    return last_wins(rows.select("node_id", F.col("x").cast("long").alias("label"), "seq"), "label")


@dataclass
class TemporalGraph:
    index: DataFrame  # node_id, idx
    attributes: DataFrame  # node_id, vec
    labels: DataFrame  # node_id, label
    initial: DataFrame  # u, v of snapshot 0
    snapshots: DataFrame  # snap, u, v
    deltas: DataFrame  # snap, op, u, v
    updates: DataFrame | None  # snap, node_id, vec
    count: int


def build(spark: SparkSession, raw_edges: DataFrame, features: DataFrame | None, raw_labels: DataFrame | None, updates: DataFrame | None = None, snapshots: int = 8, mode: str = "window", max_nodes: int = 0, seed: int = 42) -> TemporalGraph:
    """From CSV frames to snapshots and deltas. Nodes without features get 0.01 normals."""
    e = cut(edges(raw_edges))
    if e.isEmpty():
        raise ValueError("no edges")
    feats = vectors(features) if features is not None else None
    labs = labels(raw_labels) if raw_labels is not None else None
    timed = "time" in raw_edges.columns
    whole = cut(universe(e.select("src"), e.select("dst"), *[x.select("node_id") for x in (feats, labs) if x is not None]))
    if 0 < max_nodes < whole.count():
        # All nodes that are chosen stay, those without an edge among them too.
        whole = cut(downsample_nodes(whole, e, max_nodes).select("node_id"))
        e = cut(restrict(e, whole, "src", "dst"))
        if e.isEmpty():
            raise ValueError("no edges are left after down-sampling")
    index = cut(dense_index(whole, "node_id"))
    width = len(feats.first()["vec"]) if feats is not None and not feats.isEmpty() else 16
    known = last_wins(feats, "vec") if feats is not None else spark.createDataFrame([], T.StructType([T.StructField("node_id", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]))
    attrs = with_defaults(index, known, width, seed)
    labelled = index.select("node_id").join(labs, "node_id", "left").select("node_id", F.coalesce("label", F.lit(-1)).alias("label")) if labs is not None else index.select("node_id", F.lit(-1).cast("long").alias("label"))
    if timed and snapshots >= 2:
        cuts = time_cuts(e, snapshots)
        snaps = window_snapshots(e, snapshots, cuts=cuts)
    else:
        snapshots = max(2, snapshots)
        cuts = [i / snapshots for i in range(snapshots + 1)]
        snaps = equal_count_snapshots(e, snapshots, ["t", "seq"])
    snaps = cut(cumulative_snapshots(snaps, snapshots) if mode == "cumulative" else snaps)
    changes = None
    if updates is not None:
        require(updates, ("time", "node_id"), "attribute updates", 1)
        # Unknown nodes go before their vectors are looked at.
        own = updates.join(index.select("node_id"), identifier(updates["node_id"]) == index["node_id"], "left_semi")
        rows = vectors(own, "attribute updates", ("time", "node_id"), width).withColumn("t", epoch(F.col("time")))
        changes = attribute_updates(rows, cuts, "node_id", "t", "seq", "vec")
    return TemporalGraph(index, cut(attrs), labelled, snaps.where("snap = 0").select("u", "v"), snaps, cut(deltas(snaps)), changes, snapshots)


def from_directory(spark: SparkSession, root: str, **options) -> TemporalGraph:
    e, f, l, u = resolve(spark, root)
    return build(spark, read_csv(spark, e), read_csv(spark, f), read_csv(spark, l), read_csv(spark, u) if u else None, **options)
