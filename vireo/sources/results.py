"""The results table across runs: one row per run, columns under their current names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.sources.sinks import exists, replace, write_table

#: The columns and the names they have had.
COLUMNS: dict[str, tuple[str, ...]] = {
    "dataset": ("dataset",),
    "model": ("model", "algorithm", "algo"),
    "fidelity": ("fidelity", "implementation_fidelity"),
    "snapshot_mode": ("snapshot_mode",),
    "variant": ("variant", "ablation_tag"),
    "binary": ("binary", "binary_quantize"),
    "update_rate": ("update_rate",),
    "nodes": ("nodes", "num_nodes"),
    "dim": ("dim", "embedding_dim"),
    "snapshots": ("snapshots", "num_snapshots"),
    "init_ms": ("init_ms", "initialization_latency_ms"),
    "update_ms": ("update_ms", "avg_update_latency_ms"),
    "macro_f1": ("macro_f1", "final_macro_f1"),
    "micro_f1": ("micro_f1", "final_micro_f1"),
    "link_auc": ("link_auc", "final_link_auc"),
    "link_ap": ("link_ap", "final_link_ap"),
    "recon_auc": ("recon_auc", "final_reconstruction_auc"),
    "eff_rate": ("eff_rate", "effective_update_rate"),
    "compression_x": ("compression_x", "quantization_compression_ratio"),
}


def merge_aliases(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Current columns as text; the first alias that isn't blank wins."""
    have = {c.lower(): c for c in rows.columns}
    out = [F.col(c) for c in keep or []]
    for name, aliases in COLUMNS.items():
        own = [F.col(have[a]).cast("string") for a in aliases if a in have]
        filled = [F.when(F.trim(c) != "", c) for c in own]
        out.append((F.coalesce(*filled, F.lit("")) if filled else F.lit("")).alias(name))
    return rows.select(*out)


def append_results(spark: SparkSession, path: str, summary: dict) -> DataFrame:
    """Adds a run to the CSV table at ``path``, on any store, and returns the table with the current columns.

    A table with other columns (of an earlier layout) is first brought to the current ones; else a row is appended as a part file of its own, so nothing is read or rewritten.
    """
    row = merge_aliases(spark.createDataFrame([{k: "" if v is None else str(v) for k, v in summary.items()}]))
    have = spark.read.option("header", True).csv(path) if exists(spark, path) else None
    if have is not None and have.columns != list(COLUMNS):
        fresh = f"{path}.{uuid.uuid4().hex}.part"
        write_table(merge_aliases(have), fresh, False, "csv")
        replace(spark, fresh, path)
    row.coalesce(1).write.mode("append").option("header", True).csv(path)
    return merge_aliases(spark.read.option("header", True).csv(path))
