"""Whole runs: graph, model, replay, evaluation, files; and matrices of runs."""

from __future__ import annotations

import argparse
import time
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vireo.models.attention import AttentionModel
from vireo.models.base import Changes, EmbeddingModel
from vireo.models.projection import ProjectionModel
from vireo.models.spectral import SpectralModel
from vireo.operators import evaluate as ev
from vireo.operators import quantize as qz
from vireo.runtime import cut, session
from vireo.sources import sinks, synthetic, tables
from vireo.sources.results import append_results
from vireo.streaming.replay import effective_rate, percentile, replay

MODELS = ("projection", "spectral", "attention")


# The defaults of the options.
@dataclass(frozen=True)
class RunConfig:
    mode: str = "synthetic"
    data_dir: str = "data"
    output_dir: str = ""
    model: str = "projection"
    snapshots: int = 8
    snapshot_mode: str = "window"
    max_nodes: int = 10_000
    dim: int = 64
    order: int = 2
    projection_density: float = 0.12
    learning_rate: float = 0.55
    attr_topk: int = 20
    similarity_block: int = 512
    perturbation_rank: int = 64
    patch_size: int = 2
    history: int = 8
    hidden_dim: int = 96
    attention_temperature: float = 1.0
    update_rate: float = 0.0
    quantize: bool = False
    binary_quantize: bool = False
    no_attr: bool = False
    no_hyperbolic: bool = False
    no_inc: bool = False
    seed: int = 42
    classifier: str = "logreg"
    eval_protocol: str = "repeated_stratified"
    eval_repeats: int = 10
    eval_train_ratio: float = 0.7
    label_cleanup_mode: str = "off"
    min_class_support: int = 5
    logreg_epochs: int = 260
    logreg_weight_decay: float = 1e-4
    logreg_class_weight: str = "none"
    synthetic_nodes: int = 600
    synthetic_classes: int = 6
    synthetic_features: int = 24
    synthetic_rounds: int = 50


# What the options of these names may be.
CHOICES = {
    "mode": ("synthetic", "file"),
    "model": MODELS,
    "snapshot_mode": ("window", "cumulative"),
    "classifier": ("centroid", "logreg"),
    "eval_protocol": ("single_random", "repeated_stratified"),
    "label_cleanup_mode": ("off", "eval_only"),
    "logreg_class_weight": ("none", "balanced"),
}


def checked(c: RunConfig) -> RunConfig:
    """``c``, or an error that names the first option out of its range."""
    for name, known in CHOICES.items():
        if getattr(c, name) not in known:
            raise ValueError(f"{name} must be one of {', '.join(known)}")
    for name in ("dim", "snapshots", "order", "eval_repeats", "min_class_support", "logreg_epochs", "patch_size", "history", "hidden_dim", "synthetic_nodes", "synthetic_classes"):
        if getattr(c, name) < 1:
            raise ValueError(f"{name} must be 1 or more")
    for name in ("max_nodes", "update_rate", "synthetic_rounds"):
        if getattr(c, name) < 0:
            raise ValueError(f"{name} must not be negative")
    if not 0 < c.eval_train_ratio < 1 or not 0 < c.projection_density <= 1:
        raise ValueError("eval_train_ratio lies between 0 and 1, projection_density is at most 1")
    return c


def build_model(c: RunConfig) -> EmbeddingModel:
    if c.model not in MODELS:
        raise ValueError(f"model must be one of {', '.join(MODELS)}")
    if c.model != "projection" and (c.no_attr or c.no_hyperbolic):
        raise ValueError("attribute and geometry ablations are for the projection model only")
    if c.model == "projection":
        return ProjectionModel(c.dim, c.order, c.projection_density, c.learning_rate, c.quantize, c.binary_quantize, not c.no_attr, not c.no_hyperbolic, seed=c.seed)
    if c.model == "spectral":
        return SpectralModel(c.dim, c.attr_topk, c.similarity_block, c.perturbation_rank, c.seed)
    return AttentionModel(c.dim, c.patch_size, c.history, c.hidden_dim, c.attention_temperature, c.seed)


def ablation_tag(c: RunConfig) -> str:
    off = [name for flag, name in ((c.no_attr, "w/o-Attr"), (c.no_hyperbolic, "w/o-Hyperbolic"), (c.no_inc, "w/o-Inc")) if flag]
    return "+".join(off) or "full"


def _source(spark: SparkSession, c: RunConfig):
    """(initial edges, attributes, labels, index, batches)."""
    if c.mode == "synthetic":
        graph = synthetic.planted_partition(spark, c.synthetic_nodes, c.synthetic_classes, 0.16, 0.02, c.seed, c.synthetic_features)
        edges, attrs = synthetic.change_rounds(graph, c.synthetic_nodes, c.synthetic_rounds, c.seed + 1, c.synthetic_features)
        edges, attrs = cut(edges), cut(attrs)
        steps = range(1, c.synthetic_rounds + 1)
        index = graph.labels.select("node_id", F.col("node_id").alias("idx"))
        parts = (cut(graph.edges), cut(graph.attributes), cut(graph.labels), index)
    else:
        g = tables.from_directory(spark, c.data_dir, snapshots=c.snapshots, mode=c.snapshot_mode, max_nodes=c.max_nodes, seed=c.seed)
        edges, attrs, steps = g.deltas, g.updates, range(1, g.count)
        parts = (g.initial, g.attributes, g.labels, g.index)
    batches = [Changes(edges=edges.where(F.col("snap") == i).select("op", "u", "v"), attributes=None if attrs is None else attrs.where(F.col("snap") == i).select("node_id", "vec")) for i in steps]
    return *parts, batches


def measured(spark: SparkSession, c: RunConfig):
    """(metrics rows, summary, model, index) of one run; writes nothing."""
    checked(c)
    edges, attrs, labels, index, batches = _source(spark, c)
    model = build_model(c)
    how = ev.Protocol(c.classifier, c.eval_protocol, c.eval_repeats, c.eval_train_ratio, c.label_cleanup_mode, c.min_class_support, c.logreg_class_weight, c.logreg_epochs, c.logreg_weight_decay)
    began = time.perf_counter()
    model.fit(edges, attrs)
    model.embedding().count()
    first = {"snapshot": 0, "update_latency_ms": 1e3 * (time.perf_counter() - began)}
    check = lambda i: ev.evaluate_snapshot(model.embedding(), labels, model.edges, index, c.dim, c.seed + (1 if i == 0 else 100 + i), how)
    rows = [first | check(0), *replay(model, attrs, batches, not c.no_inc, c.update_rate, check)]
    for r in rows:
        r["model"] = c.model
    done, last = rows[1:], rows[-1]
    work = [r["compute_update_latency_ms"] for r in done]
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    n = index.count()
    summary = asdict(c) | {
        "dataset": c.mode, "implementation_fidelity": model.fidelity, "ablation_tag": ablation_tag(c), "f1_eval_protocol_used": last["f1_eval_protocol"],
        "supports_incremental_updates": model.supports_incremental_updates, "online_update_mode": model.online_update_mode,
        "num_nodes": n, "feature_dim": model.width, "embedding_dim": c.dim, "num_snapshots": len(rows),
        "initialization_latency_ms": rows[0]["update_latency_ms"], "avg_update_latency_ms": mean([r["update_latency_ms"] for r in done]),
        "avg_compute_update_latency_ms": mean(work), "avg_pacing_wait_ms": mean([r["simulated_wait_ms"] for r in done]), "p95_update_latency_ms": percentile([r["update_latency_ms"] for r in done], 0.95),
        **{f"final_{k}": last[k] for k in ("macro_f1", "macro_f1_std", "micro_f1", "micro_f1_std", "link_auc", "link_ap", "reconstruction_auc", "labeled_nodes_raw", "labeled_nodes", "eval_dropped_labeled_nodes", "eval_class_count_raw", "eval_class_count", "eval_dropped_class_count")},
        "effective_update_rate": effective_rate(done), "quantization_compression_ratio": 0.0, "quantization_error": 0.0, "binary_compression_ratio": 0.0, "binary_error": 0.0,
    }
    if isinstance(model, ProjectionModel):
        if c.quantize:
            summary["quantization_compression_ratio"] = qz.int8_ratio(n, c.dim)
            back = model.embedding(dequantize=True).select("node_id", F.col("vec").alias("back"))
            summary["quantization_error"] = qz.relative_error(model.embedding().join(back, "node_id"), "vec", "back").first()[0]
        if c.binary_quantize:
            summary["binary_compression_ratio"] = qz.BINARY_RATIO
            summary["binary_error"] = qz.relative_error(qz.binary_quantize(model.embedding()), "vec", "b").first()[0]
    return rows, summary, model, index


def run(spark: SparkSession, c: RunConfig) -> dict:
    """One run; writes its files if ``output_dir`` is set and returns the summary."""
    rows, summary, model, index = measured(spark, c)
    if not c.output_dir:
        return summary
    at = lambda name: f"{c.output_dir}/{name}"
    sinks.write_metrics(spark, at("metrics_per_snapshot.csv"), rows)
    sinks.write_node_mapping(at("node_mapping.csv"), index)
    sinks.write_summary(spark, at("summary.json"), summary)
    sinks.write_embedding(spark, at("final_embedding"), model.embedding(), index)
    if isinstance(model, ProjectionModel) and c.quantize:
        sinks.write_embedding(spark, at("final_embedding_int8"), model.quantized(), index, "q", "int8")
        sinks.write_one_csv(spark, at("final_embedding_int8_scale.csv"), ["scale"], [[x] for x in model.scales])
    if isinstance(model, ProjectionModel) and c.binary_quantize:
        sinks.write_embedding(spark, at("final_embedding_binary"), model.signs(), index, "b", "int8")
    sinks.curves_svg(spark, at("metrics_curves.svg"), rows)
    append_results(spark, at("all_results.csv"), summary)
    return summary


def matrix(spark: SparkSession, base: RunConfig, rates=(10, 100, 1000), out_dir: str = "") -> list[dict]:
    """Runs over update rates, then over ablations, in one session."""
    if any(r <= 0 or int(r) != r for r in rates):
        raise ValueError("rates are positive whole numbers")
    variants = {"projection": ({}, {"no_attr": True}, {"no_hyperbolic": True}, {"no_inc": True}), "spectral": ({}, {"no_inc": True}), "attention": ({},)}
    stages = {"rate": [replace(base, update_rate=float(r)) for r in rates], "ablation": [replace(base, update_rate=0.0, **v) for v in variants[base.model]]}
    rows = []
    for stage, configs in stages.items():
        for k, c in enumerate(configs):
            rows.append({"stage": stage} | run(spark, replace(c, output_dir=f"{out_dir}/{stage}-{k}" if out_dir else "")))
    if out_dir:
        for stage in (*stages, "combined"):
            own = [r for r in rows if stage in (r["stage"], "combined")]
            sinks.write_one_csv(spark, f"{out_dir}/{stage}_results.csv", list(rows[0]), [list(r.values()) for r in own])
    return rows


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vireo")
    for f in fields(RunConfig):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            out.add_argument(flag, action="store_true")
        else:
            out.add_argument(flag, type=type(f.default), default=f.default, choices=CHOICES.get(f.name))
    out.add_argument("--matrix-rates", type=int, nargs="+", help="run over these update rates and over the ablations; each run's files go below --output-dir")
    return out


def main(argv: list[str] | None = None) -> dict | list[dict]:
    args = vars(parser().parse_args(argv))
    rates = args.pop("matrix_rates")
    config = checked(RunConfig(**args))
    return matrix(session(), config, rates, config.output_dir) if rates else run(session(), config)

if __name__ == "__main__":
    main()
