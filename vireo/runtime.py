"""Session defaults and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "vireo", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one of our own is made only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vireo-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and drop the lineage."""
    checkpoint_folder(df.sparkSession)
    return unsized(df.checkpoint())


def unsized(df: DataFrame) -> DataFrame:
    """A checkpointed frame without the estimate of its size that Spark carries over from the plan before.

    A join's estimate is the product of its sides', so over a chain of cuts its digits grow exponentially, to numbers of
    many MB that the driver multiplies in every plan. And an explode is sized too low. Unknown sizes are taken as large;
    adaptive execution broadcasts by what it measures.
    """
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    plan, none = df._jdf.queryExecution().logical(), jvm.scala.Option.empty()
    again = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, again), df.sparkSession)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of one's own, on any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def planned_once(spark: SparkSession):
    """Plans made inside run as one job each.

    Adaptive execution makes a job of every exchange, with all stages behind it anew, which long chains of exchanges
    of known size have nothing from.
    """
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop shuffle and checkpoint files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scalar(df: DataFrame):
    """The only value of a one-row, one-column frame."""
    row = df.first()
    return None if row is None else row[0]
