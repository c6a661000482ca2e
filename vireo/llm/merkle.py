"""Merkle manifest of a table: an external-memory store of hash trees, eight children a node.

A leaf is the SHA-256 of a row; leaves of a group ascend by a key, and runs of eight consecutive
nodes become one node until one is left, the group's root. Group roots, ordered by group, form a tree of their own.

The store is a folder of Parquet tables. Leaves go out as sorted runs of key
ranges; each row's coordinate (tree, position) is its run's offset plus its place
in the run. ``level=k`` holds the nodes of level k with their children's digests
packed, made from level k-1 alone. Proofs come from joins on coordinates, from the top down:
a node's path is its parent's children and its parent's path, so a leaf meets one row, of which eight leaves at most share the key.
Nothing but the number of levels and the root reaches the driver.

A tree is named by the rank, over all rows, of its first leaf, so trees sort as their groups do. The tree of group roots is number -1.

Defined results: values enter as ``-`` for null, else as their count of UTF-8
bytes, ``:`` and the value, whole texts always. Null groups and null keys come
first; groups sort by bytes. Rows of equal key are ordered by their leaf, those of equal leaf (repeated rows)
hold neighbouring places in any order, which changes no digest. An empty table has
no root (None) and no proofs. Column names may be any: the store has names of its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vireo.llm.common import cut, ensure_checkpoint_dir

FAN_OUT = 8
#: The tree whose leaves are the groups' roots.
ROOTS = -1
#: The letters that tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return digest(*[framed(v) for v in values])


def store_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/merkle-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hex(packed: str | Column) -> Column:
    return F.lower(F.hex(packed))


def _sorted_leaves(rows: DataFrame, folder: str) -> DataFrame:
    """(tree, pos, size, grp, key, leaf, ...): rows of (grp, key, leaf, ...) with their coordinates.

    Rows are written once as they come, so that ranges are drawn from short rows that don't change, and once as sorted runs.
    """
    came = _written(rows.withColumn("came", F.monotonically_increasing_id()), f"{folder}/unsorted")
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("came")]  # the last one splits even a run of equal rows
    runs = came.repartitionByRange(*order).sortWithinPartitions(*order).drop("came").withColumn("at", F.monotonically_increasing_id())
    runs = _written(runs, f"{folder}/runs")
    run, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    runs = runs.withColumns({"run": run, "place": place}).drop("at")
    # A row for each run and group in it: as many as there are runs and groups together.
    parts = runs.groupBy("run", "grp").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("run").agg(F.sum("n").alias("n"))
    before = sizes.select("run", (F.sum("n").over(W.orderBy("run")) - F.col("n")).alias("before"))  # a row for each run
    parts = cut(parts.join(before, "run").select("run", "grp", "n", F.col("before") + F.col("first"), "before").toDF("run", "grp", "n", "start", "before"))
    trees = parts.groupBy("grp").agg(F.min("start").alias("tree"), F.sum("n").alias("size"))
    parts = parts.alias("p").join(trees.alias("t"), F.col("p.grp").eqNullSafe(F.col("t.grp"))).select("p.run", "p.grp", "before", "tree", "size")
    met = runs.alias("r").join(parts.alias("p"), (F.col("r.run") == F.col("p.run")) & F.col("r.grp").eqNullSafe(F.col("p.grp")))
    rest = [F.col(f"r.{c}") for c in rows.columns]
    return met.select("tree", (F.col("before") + F.col("place") - F.col("tree")).alias("pos"), "size", *rest)


def _levels(leaves: DataFrame, folder: str) -> list[DataFrame]:
    """Levels from 1 up of trees given by their leaves (tree, pos, size, leaf as packed bytes).

    Each has (tree, pos, size, digest, children); ``size`` counts the nodes of the tree at that level.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0
    below, out = leaves.select("tree", "pos", "size", F.col("leaf").alias("digest")), []
    while most > 1:
        most = -(-most // FAN_OUT)
        run = F.array_sort(F.collect_list(F.struct(F.pmod("pos", F.lit(FAN_OUT)).alias("k"), F.hex("digest").alias("h"))))
        grouped = below.where("size > 1").groupBy("tree", F.floor(F.col("pos") / FAN_OUT).alias("up")).agg(F.first("size").alias("size"), run.alias("run"))
        children = F.unhex(F.array_join("run.h", ""))
        nodes = grouped.select("tree", F.col("up").alias("pos"), F.ceil(F.col("size") / FAN_OUT).alias("size"), children.alias("children"))
        nodes = nodes.select("tree", "pos", "size", F.unhex(digest(_hex("children"))).alias("digest"), "children")
        below = _written(nodes, f"{folder}/level={len(out) + 1}")
        out.append(below)
    return out


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, up, children, path, top): what the leaves of each run of level 0 need beyond their own place.

    ``tops`` has (tree, level, top, path): each tree's highest level, its root's digest and the path from
    there on. ``children`` is null where the tree is a lone leaf.
    """
    empty = F.lit(None).cast("binary")
    above = None
    for k in range(len(levels), -1, -1):
        # Rows that nodes of level k meet: their parents, and the paths of the trees that end here.
        ends = tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("up"), empty.alias("children"), "path", "top")
        above = ends if above is None else above.unionByName(ends)
        if k:
            node = levels[k - 1].select("tree", "pos", F.col("children").alias("own"), F.floor(F.col("pos") / FAN_OUT).alias("up"))
            step = F.struct(F.pmod("pos", F.lit(FAN_OUT)).cast("int").alias("at"), F.col("children").alias("run"))
            path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(F.array(step), "path"))
            above = node.join(above, ["tree", "up"]).select("tree", F.col("pos").alias("up"), F.col("own").alias("children"), path.alias("path"), "top")
    return above


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, level, digest) of the roots of all trees."""
    found = leaves.where("size = 1").select("tree", F.lit(0).alias("level"), F.col("leaf").alias("digest"))
    for k, level in enumerate(levels, start=1):
        found = found.unionByName(level.where("size = 1").select("tree", F.lit(k).alias("level"), "digest"))
    return found


@dataclass
class Manifest:
    """A stored tree of trees; ``leaves`` has (tree, pos, size, grp, key, leaf) and the columns that were carried along."""

    folder: str
    root: str | None
    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    root_levels: list[DataFrame]

    def proofs(self) -> DataFrame:
        """``leaves`` with ``subroot`` and ``path``: for each level up to the root, the place among the run's nodes and their packed digests."""
        none = F.array().cast("array<struct<at:int,run:binary>>")
        crown = self.leaves.sparkSession.range(0 if self.root is None else 1).select(
            F.lit(ROOTS).cast("long").alias("tree"), F.lit(len(self.root_levels)).alias("level"), none.alias("path"), F.unhex(F.lit(self.root).cast("string")).alias("top")
        )
        met = self._met(self.subroots, _paths(self.root_levels, crown))
        tops = met.select(F.col("of").alias("tree"), "level", F.col("leaf").alias("top"), "path")
        return self._met(self.leaves, _paths(self.levels, tops)).withColumn("subroot", F.lower(F.hex("top"))).drop("top")

    @staticmethod
    def _met(leaves: DataFrame, above: DataFrame) -> DataFrame:
        step = F.struct(F.pmod("pos", F.lit(FAN_OUT)).cast("int").alias("at"), F.col("children").alias("run"))
        path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(F.array(step), "path"))
        met = leaves.withColumn("up", F.floor(F.col("pos") / FAN_OUT)).join(above, ["tree", "up"])
        return met.withColumn("path", path).drop("up", "children")


def siblings(path: str = "path") -> Column:
    """The other digests of each run on the way to the root, left to right, as one hex text."""
    one = lambda s: F.concat(_left(s), _right(s))
    return F.array_join(F.transform(path, one), "")


def _left(step: Column) -> Column:
    return F.substring(_hex(step["run"]), F.lit(1), step["at"] * 64)


def _right(step: Column) -> Column:
    return F.substring(_hex(step["run"]), step["at"] * 64 + 65, F.lit(64 * FAN_OUT))


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf (hex) and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(_left(s), h, _right(s)).cast("binary"), 256))


def build(rows: DataFrame, group: str, key: str, columns: list[str], carry: dict[str, Column] | None = None, folder: str | None = None) -> Manifest:
    """The manifest of ``rows``: leaves over ``columns``, trees by ``group``, order by ``key``.

    ``carry`` names further expressions over the rows that the leaves keep (none of tree, pos, size, grp, key, leaf, came, at, run, place).
    """
    spark = rows.sparkSession
    folder = folder or store_folder(spark)
    leaf = F.unhex(row_digest(*[F.col(c) for c in columns]))
    taken = rows.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"), *[c.alias(n) for n, c in (carry or {}).items()])
    leaves = _written(_sorted_leaves(taken, folder), f"{folder}/level=0")
    levels = _levels(leaves, folder)
    tops = cut(_tops(leaves, levels))
    subroots = _roots(tops, f"{folder}/roots")
    root_levels = _levels(subroots, f"{folder}/roots")
    last = (root_levels[-1].select("digest") if root_levels else subroots.select("leaf")).first()
    return Manifest(folder, last and last[0].hex(), leaves, levels, subroots, root_levels)


def _roots(tops: DataFrame, folder: str) -> DataFrame:
    """The roots of all trees as leaves of one tree, in the order of the trees' numbers, by sorted runs as well."""
    runs = _written(tops.repartitionByRange(F.asc("tree")).sortWithinPartitions("tree").withColumn("at", F.monotonically_increasing_id()), f"{folder}/runs")
    runs = runs.withColumns({"run": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)})
    sizes = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("run", (F.sum("n").over(W.orderBy("run")) - F.col("n")).alias("before"))  # a row for each run
    n = tops.count()
    return cut(
        runs.join(before, "run").select(
            F.lit(ROOTS).cast("long").alias("tree"), (F.col("before") + F.col("place")).alias("pos"), F.lit(n).cast("long").alias("size"), F.col("digest").alias("leaf"), F.col("tree").alias("of"), "level"
        )
    )
