"""Shared plumbing of the text operators: lineage cuts, Arrow maps, checks."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.runtime import unsized


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; make one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vireo-checkpoint-"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix="vireo-ship-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for x in files:
                if x.endswith(".py"):
                    full = os.path.join(folder, x)
                    out.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return unsized(df.checkpoint())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle and checkpoint files of plans that nothing refers to any more.

    It acts on garbage collection on the driver, which an iterative job has little of.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one record batch into batches of ``schema``.

    The output arrays are cast to the declared types, so ``fn`` may return
    NumPy-born columns in a dict or a list of such dicts.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            got = fn(batch)
            for cols in got if isinstance(got, list) or hasattr(got, "__next__") else [got]:
                arrays = [
                    c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
                    for f, c in ((f, cols[f.name]) for f in target)
                ]
                arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def map_partitions_arrow(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns all batches of a partition, one at a time, into dicts of columns."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def may_be_in(df: DataFrame, key: str, wanted: DataFrame, bits: int = 23) -> DataFrame:
    """Rows of ``df`` whose binary ``key`` may be in ``wanted``; none of those is lost.

    A bitmap of 2^bits hashed keys, 2^bits / 8 bytes at most whatever the input, goes to all
    tasks before anything is shuffled; what it lets through is exact only
    after a join with ``wanted`` (an inner one: a semi-join would be pushed below).
    """
    bit = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    maps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("map_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map_bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("map_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.join(F.broadcast(maps), F.bitmap_bucket_number(bit) == F.col("map_no"))
    return joined.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("map_no", "map_bits")
