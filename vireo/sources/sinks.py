"""Results to files: CSV, JSON, NPY and SVG for small ones, Spark writers for tables."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the metrics table.
METRICS = (
    "snapshot", "model", "update_latency_ms", "compute_update_latency_ms", "simulated_wait_ms", "batch_events", "macro_f1", "macro_f1_std",
    "micro_f1", "micro_f1_std", "link_auc", "link_ap", "reconstruction_auc", "labeled_nodes_raw", "labeled_nodes", "eval_dropped_labeled_nodes",
    "eval_class_count_raw", "eval_class_count", "eval_dropped_class_count", "label_cleanup_mode", "min_class_support", "f1_eval_repeats",
    "f1_eval_successful_repeats", "f1_eval_protocol",
)


def _on(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, so that any store a table can be on will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, which appears whole or not at all: it is written beside its place and renamed into it."""
    store, where = _on(spark, path)
    folder = where.getParent()
    if folder is not None:
        store.mkdirs(folder)
    _, draft = _on(spark, f"{path}.{uuid.uuid4().hex}.part")
    try:
        out = store.create(draft)
        for k in range(0, len(content), 1 << 20):
            out.write(bytearray(content[k : k + (1 << 20)]))
        out.close()
        if store.exists(where):
            store.delete(where, False)
        if not store.rename(draft, where):
            raise OSError(f"{path} can't be written")
    finally:
        store.delete(draft, False)


def write_one_csv(spark: SparkSession, path: str, header: Iterable[str], rows: Iterable[Iterable]) -> None:
    """A small table to one file on any store."""
    text = io.StringIO(newline="")
    writer = csv.writer(text)
    writer.writerow(header)
    writer.writerows(rows)
    put(spark, path, text.getvalue().encode())


def write_table(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet") -> None:
    """Commit-protocol write; an existing table is an error unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_metrics(spark: SparkSession, path: str, rows: list[dict]) -> None:
    write_one_csv(spark, path, METRICS, [["" if r.get(c) is None else r[c] for c in METRICS] for r in rows])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Numbers as doubles; link_ap and reconstruction_auc are 0 where an old file lacks them."""
    df = spark.read.option("header", True).csv(path)
    text = {"model", "label_cleanup_mode", "f1_eval_protocol"}
    cols = [F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in df.columns]
    out = df.select(*cols)
    for c in ("link_ap", "reconstruction_auc"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0))
    return out


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    put(spark, path, json.dumps(summary, indent=2, ensure_ascii=False).encode())


#: Numbers up to which an embedding is also written as one .npy file, through the driver: 128 MB of doubles.
NPY_LIMIT = 1 << 24


def write_embedding(spark: SparkSession, path: str, emb: DataFrame, index: DataFrame, vec: str = "vec", dtype: str = "float64", overwrite: bool = True) -> None:
    """Rows with their index as the Parquet table ``path``, as the tasks write them; and as ``path``.npy in index order where that is ``NPY_LIMIT`` numbers at most."""
    rows = emb.join(index, "node_id").select("idx", "node_id", vec)
    write_table(rows.repartitionByRange("idx").sortWithinPartitions("idx"), path, overwrite)
    table = spark.read.parquet(path)
    n, width = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vec)), F.lit(0))).first()
    if n * width <= NPY_LIMIT:
        held = io.BytesIO()
        np.save(held, np.array([list(r[0]) for r in table.orderBy("idx").select(vec).collect()], dtype=dtype))
        put(spark, f"{path}.npy", held.getvalue())
    else:
        remove_stale(spark, f"{path}.npy")


def write_node_mapping(path: str, index: DataFrame, overwrite: bool = True) -> None:
    """(node_id, index) as a CSV table in order of index."""
    rows = index.select("node_id", F.col("idx").alias("index")).repartitionByRange("index").sortWithinPartitions("index")
    write_table(rows, path, overwrite, "csv")


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _on(spark, path)
    return store.exists(where)


def remove_stale(spark: SparkSession, path: str) -> None:
    store, where = _on(spark, path)
    if store.exists(where):
        store.delete(where, True)


def replace(spark: SparkSession, fresh: str, path: str) -> None:
    """``fresh`` in the place of ``path``."""
    store, where = _on(spark, path)
    remove_stale(spark, path)
    if not store.rename(_on(spark, fresh)[1], where):
        raise OSError(f"{fresh} can't take the place of {path}")


def guard_outputs(spark: SparkSession, folder: str, names: Iterable[str], overwrite: bool) -> None:
    found = [n for n in names if exists(spark, f"{folder}/{n}")]
    if found and not overwrite:
        raise FileExistsError(f"{folder} has {', '.join(found)} already")


def curves_svg(spark: SparkSession, path: str, rows: list[dict], panels: tuple[tuple[str, ...], ...] = (("macro_f1", "micro_f1"), ("link_auc", "reconstruction_auc"))) -> None:
    """Two panels of lines over snapshots, values between 0 and 1."""
    width, height, pad = 420, 240, 40
    colors = ("#1b6ca8", "#c4572b", "#3b8b4a", "#7a4fa3")
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width * len(panels)}" height="{height}" font-family="sans-serif" font-size="11">']
    n = max(1, len(rows) - 1)
    for p, names in enumerate(panels):
        left = p * width + pad
        parts.append(f'<path d="M{left},{pad} V{height - pad} H{left + width - 2 * pad}" fill="none" stroke="#444"/>')
        for k, name in enumerate(names):
            xy = [(left + i * (width - 2 * pad) / n, height - pad - float(r.get(name) or 0.0) * (height - 2 * pad)) for i, r in enumerate(rows)]
            parts.append(f'<polyline fill="none" stroke="{colors[k % 4]}" stroke-width="2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in xy)}"/>')
            parts.append(f'<text x="{left + 8 + 110 * k}" y="{pad - 12}" fill="{colors[k % 4]}">{name}</text>')
    parts.append("</svg>")
    put(spark, path, "\n".join(parts).encode())
