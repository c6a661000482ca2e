"""Connected components of a link table.

Up to FEW links are joined in one task, in arrays: about 40 bytes a link of
16-byte names, whatever the graph, so its memory has a bound. More go through
alternating large and small stars until so few are left or the links are stars:
every round points each node's larger neighbours, then its smaller ones, at the
smallest node it knows, O(log^2) rounds at most. There links stay distributed;
each round is cut to the shared checkpoint folder. A hub with a third of all
links is a partial minimum per task and a skewed inner join with one row on the
other side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.llm.common import cut, map_partitions_arrow, release

#: Links that one task joins. A round of stars takes seven exchanges, which a driver keeps for as long as it runs.
FEW = 1 << 20


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; the root is the least node of its component.

    ``links`` is counted first, so it should be on a plan that is cheap to run again.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    links = links.where(F.col(a) != F.col(b)).select(big.alias("a"), small.alias("b"))
    if links.count() <= FEW:
        return _at_once(links)
    links = cut(links.distinct())
    while not _stars(links):
        links = cut(_small_star(_large_star(links)))
        release(links.sparkSession)
        if links.count() <= FEW:
            return _at_once(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())


def _at_once(links: DataFrame) -> DataFrame:
    """``components`` of few links, in one task."""
    kind = links.schema["a"].dataType

    def run(batches):
        held = [x for x in batches if x.num_rows]
        if held:
            ends = pa.chunked_array([x.column(k) for k in (0, 1) for x in held]).combine_chunks()
            names = ends.unique()
            names = names.take(pc.sort_indices(names))
            at = pc.index_in(ends, names).to_numpy().astype(np.int64)
            yield {"node": names, "root": names.take(pa.array(_least(at[: len(at) // 2], at[len(at) // 2 :], len(names))))}

    return cut(map_partitions_arrow(links.coalesce(1), run, T.StructType([T.StructField("node", kind), T.StructField("root", kind)])))


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of ``n`` nodes."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _stars(links: DataFrame) -> bool:
    """Whether every node points at one root, and no root at anything."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("b", F.lit(0), F.lit(1)))
    bad = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)")
    return bad.isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", "least")).distinct()
