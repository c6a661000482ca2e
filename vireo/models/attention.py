"""Attention over a bounded history of snapshot tokens, with fixed random weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vireo.models.base import Changes, EmbeddingModel
from vireo.operators.graph import both_ways, degree
from vireo.runtime import cut


def patch_means(rows: DataFrame, key: str, t: str, columns: list[str], history: int, patch: int) -> DataFrame:
    """(key, patch, columns): means over groups of ``patch`` tokens of the last ``history``.

    A group that is not full repeats the last token.
    """
    order = W.partitionBy(key).orderBy(t)
    late = W.partitionBy(key).orderBy(F.desc(t))
    kept = rows.withColumn("_late", F.row_number().over(late)).where(F.col("_late") <= history)
    placed = kept.withColumn("_at", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key)))
    missing = F.pmod(F.lit(patch) - F.pmod("_n", F.lit(patch)), F.lit(patch))
    weight = F.when(F.col("_late") == 1, 1 + missing).otherwise(F.lit(1))
    placed = placed.select(key, F.floor(F.col("_at") / patch).cast("int").alias("patch"), weight.alias("_w"), *columns)
    return placed.groupBy(key, "patch").agg(*[(F.sum(F.col(c) * F.col("_w")) / patch).alias(c) for c in columns])


class AttentionModel(EmbeddingModel):
    online_update_mode = "refit"
    state_tables = (*EmbeddingModel.state_tables, "tokens")
    state_values = (*EmbeddingModel.state_values, "steps")
    options = (*EmbeddingModel.options, "patch", "history", "hidden", "temperature")

    def __init__(self, dim: int = 64, patch: int = 2, history: int = 8, hidden: int = 96, temperature: float = 1.0, seed: int = 42):
        super().__init__(dim, seed)
        self.patch, self.history = max(1, patch), max(1, history)
        self.hidden, self.temperature = max(hidden, dim), max(temperature, 1e-6)
        gen = np.random.default_rng(seed)
        h = self.hidden
        draw = lambda *shape: gen.normal(size=shape) / math.sqrt(h)
        self.w = {"struct": draw(h, h), "attr": draw(h, h), "q": draw(h, h), "k": draw(h, h), "v": draw(h, h), "out": draw(h, dim)}
        self.tokens: DataFrame | None = None
        self.steps = 0

    def fit(self, edges: DataFrame, attrs: DataFrame) -> AttentionModel:
        self.set_graph(edges, attrs)
        self.tokens, self.steps = None, 0
        self._append()
        return self

    def _append(self) -> None:
        """Adds the token of the current snapshot; keeps the last ``history`` of them."""
        position = min(self.steps, self.history) + 1
        scale, h, w = position / self.history, self.hidden, self.w
        deg = degree(self.edges)
        neighbors = both_ways(self.edges).join(self.attrs.select(F.col("node_id").alias("v"), F.col("vec")), "v")
        sums = neighbors.groupBy(F.col("u").alias("node_id")).agg(F.array(*[F.sum(F.col("vec")[j]) for j in range(self.width)]).alias("sum"))
        rows = self.attrs.join(sums, "node_id", "left").join(deg, "node_id", "left")
        width = self.width

        def token(frames):
            for f in frames:
                n = len(f)
                d = f["degree"].fillna(0).to_numpy(float)[:, None]
                x = np.vstack(f["vec"]) if n else np.zeros((0, width))
                s = np.vstack([np.zeros(width) if v is None else v for v in f["sum"]]) if n else x
                fit_ = lambda m: np.pad(m[:, :h], ((0, 0), (0, max(0, h - m.shape[1]))))
                smooth = s / np.maximum(d, 1.0)
                out = np.tanh(fit_(np.hstack([smooth, d, np.log1p(d)])) @ w["struct"]) + np.tanh(fit_(np.hstack([x, x**2])) @ w["attr"]) + scale * np.log1p(d)
                yield pd.DataFrame({"node_id": f["node_id"], "token": list(out)})

        kind = self.attrs.schema["node_id"].dataType.simpleString()
        fresh = rows.select("node_id", "vec", "sum", "degree").mapInPandas(token, f"node_id {kind}, token array<double>").withColumn("t", F.lit(self.steps))
        held = fresh if self.tokens is None else self.tokens.where(F.col("t") > self.steps - self.history).unionByName(fresh)
        self.tokens = cut(held)
        self.steps += 1

    def apply_updates(self, batch: Changes) -> DataFrame:
        self.validate(batch)
        edges, attrs, touched = self.changed_graph(batch)
        self.edges, self.attrs = edges, attrs
        self._append()
        return touched if not touched.isEmpty() else self.nodes

    def embedding(self) -> DataFrame:
        """Each node's tokens meet in one task: at most ``history`` rows, missing ones are zero."""
        first = max(0, self.steps - self.history)
        count, h, w, patch = self.steps - first, self.hidden, self.w, self.patch
        root = math.sqrt(h * self.temperature)
        held = self.tokens.groupBy("node_id").agg(F.collect_list(F.struct("t", "token")).alias("held"))
        kind = self.attrs.schema["node_id"].dataType.simpleString()

        def attend(frames):
            for f in frames:
                n = len(f)
                x = np.zeros((n, count, h))
                for i, rows in enumerate(f["held"]):
                    for r in rows:
                        x[i, r["t"] - first] = r["token"]
                latest = x[:, -1]
                rest = count % patch
                if rest:
                    x = np.concatenate([x, np.repeat(x[:, -1:], patch - rest, axis=1)], axis=1)
                p = x.reshape(n, -1, patch, h).mean(axis=2)
                s = np.einsum("nth,nsh->nts", p @ w["q"], p @ w["k"]) / root
                s = np.exp(s - s.max(axis=2, keepdims=True))
                s /= np.maximum(s.sum(axis=2, keepdims=True), 1e-12)
                y = np.tanh((np.einsum("nts,nsh->nth", s, p @ w["v"]).mean(axis=1) + latest) @ w["out"])
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"node_id": f["node_id"], "vec": list(y)})

        return held.mapInPandas(attend, f"node_id {kind}, vec array<double>")
