"""Edges, nodes and the sparse matrices made of them.

Edges are kept canonical (u < v, distinct); a symmetric view is the union of
both directions. Vectors that are summed in loops are scalar columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vireo.functions.text import strip
from vireo.runtime import cut

#: Rows of a key range, about, where there are more than that for each shuffle partition.
RANGE = 1 << 20


def clean(raw: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Strip endpoints; blank endpoints and self-loops go."""
    out = raw.withColumns({src: strip(F.col(src).cast("string")), dst: strip(F.col(dst).cast("string"))})
    return out.where((F.col(src) != "") & (F.col(dst) != "") & (F.col(src) != F.col(dst)))


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(u, v) distinct with u < v."""
    return edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def universe(*keys: DataFrame) -> DataFrame:
    """Distinct ids of one-column frames."""
    out = keys[0].toDF("node_id")
    for k in keys[1:]:
        out = out.union(k.toDF("node_id"))
    return out.distinct()


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """Zero-based rank of each row by ``key``, without sorting all rows in one task.

    Rows are dealt to key ranges of about ``RANGE`` rows once, sorted and numbered inside; those
    numbers add to the sum of the ranges before (one row a range).
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-df.count() // RANGE))
    dealt = df.repartitionByRange(ranges, F.col(key)).sortWithinPartitions(key)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(before), "_range").withColumn(out, (F.col("_before") + nth).cast("long")).drop("_range", "_before", "_at")


def degree_with_repeats(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every raw edge adds one to both of its ends."""
    ends = edges.select(F.col(src).alias("node_id")).union(edges.select(F.col(dst)))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def degree(edges: DataFrame) -> DataFrame:
    """Number of neighbours in a canonical edge set."""
    return both_ways(edges).groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def top_nodes(degrees: DataFrame, n: int) -> DataFrame:
    """The ``n`` nodes of highest degree, ties by id."""
    return degrees.orderBy(F.desc("degree"), F.asc("node_id")).limit(n)


def restrict(edges: DataFrame, nodes: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Edges with both ends among ``nodes``."""
    for end in (a, b):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return edges


def downsample(edges: DataFrame, max_nodes: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges among the ``max_nodes`` nodes of highest degree; 0 keeps all."""
    if max_nodes <= 0:
        return edges
    return restrict(edges, top_nodes(degree_with_repeats(edges, src, dst), max_nodes), src, dst).select(*edges.columns)


def downsample_nodes(nodes: DataFrame, edges: DataFrame, max_nodes: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node_id, degree) of the ``max_nodes`` of ``nodes`` with the highest degree, ties by id; nodes without edges have degree 0 and stay if there is room."""
    met = nodes.select("node_id").join(degree_with_repeats(edges, src, dst), "node_id", "left")
    return top_nodes(met.select("node_id", F.coalesce("degree", F.lit(0)).alias("degree")), max_nodes)


def neighbors_of(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Ids next to a touched node."""
    return both_ways(edges).join(touched.select(F.col("node_id").alias("u")).distinct(), "u", "left_semi").select(F.col("v").alias("node_id")).distinct()


def affected(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """Touched nodes and their neighbours before and after a change."""
    return touched.select("node_id").union(neighbors_of(before, touched)).union(neighbors_of(after, touched)).distinct()


def normalized(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Entries (u, v, w) of D^-1/2 (A + I) D^-1/2; degrees count the self-loop."""
    ids = both_ways(edges).select(F.col("u").alias("node_id")).distinct() if nodes is None else nodes.select("node_id")
    deg = ids.join(degree(edges), "node_id", "left").select("node_id", F.greatest(F.coalesce("degree", F.lit(0)) + 1, F.lit(1)).cast("double").alias("d"))
    entries = both_ways(edges).union(ids.select("node_id", "node_id"))
    du, dv = deg.toDF("u", "du"), deg.toDF("v", "dv")
    return entries.join(du, "u").join(dv, "v").select("u", "v", (1.0 / F.sqrt(F.col("du") * F.col("dv"))).alias("w"))


def laplacian(edges: DataFrame) -> DataFrame:
    """Entries of D - A."""
    diagonal = degree(edges).select(F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.col("degree").cast("double").alias("w"))
    return both_ways(edges).withColumn("w", F.lit(-1.0)).union(diagonal)


def multiply(entries: DataFrame, vectors: DataFrame, columns: list[str]) -> DataFrame:
    """Sparse (u, v, w) times dense rows (node_id, columns): sums by u."""
    met = entries.join(vectors.select(F.col("node_id").alias("v"), *columns), "v")
    return met.groupBy(F.col("u").alias("node_id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def neighbor_mean(edges: DataFrame, vectors: DataFrame, columns: list[str]) -> DataFrame:
    met = both_ways(edges).join(vectors.select(F.col("node_id").alias("v"), *columns), "v")
    return met.groupBy(F.col("u").alias("node_id")).agg(*[F.avg(c).alias(c) for c in columns])


def shared_targets(pairs: DataFrame, item: str, target: str, most: int = 500) -> DataFrame:
    """Item pairs (u < v) with a common target; targets with more than ``most`` items are left out."""
    pairs = pairs.select(F.col(item).alias("item"), F.col(target).alias("target")).distinct()
    small = pairs.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("target")
    kept = pairs.join(small, "target")
    left, right = kept.toDF("target", "u"), kept.toDF("target", "v")
    return left.join(right, "target").where("u < v").select("u", "v").distinct()
