"""The projection model on a small planted graph, before and after its changes; prints metrics and writes no files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vireo.plans.run import RunConfig, measured
from vireo.runtime import session

SHOWN = ("macro_f1", "micro_f1", "link_auc", "link_ap", "reconstruction_auc")


def demo(spark: SparkSession, nodes: int = 90, rounds: int = 2) -> dict:
    rows, summary, _, _ = measured(spark, RunConfig(dim=32, quantize=True, synthetic_nodes=nodes, synthetic_rounds=rounds, eval_protocol="single_random", classifier="centroid"))
    for name in ("num_nodes", "feature_dim", "embedding_dim", "initialization_latency_ms", "avg_update_latency_ms", "p95_update_latency_ms"):
        print(f"{name}: {summary[name]:g}")
    for title, row in (("initial", rows[0]), ("updated", rows[-1])):
        print(f"{title}: " + ", ".join(f"{k} {row[k]:.4f}" for k in SHOWN))
    print(f"int8: {summary['quantization_compression_ratio']:.3f} times smaller, error {summary['quantization_error']:.6f}")
    return summary


if __name__ == "__main__":
    demo(session())
