"""Splits, classifiers and ranking metrics over embeddings."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vireo.functions.rng import order_key, uniform
from vireo.functions.vectors import l2_normalize, standard_stats, standardize
from vireo.operators.graph import both_ways, dense_index
from vireo.operators.similarity import pair_cosine
from vireo.runtime import cut


def random_split(nodes: DataFrame, ratio: float, seed: int, key: str = "node_id") -> DataFrame:
    """``nodes`` with ``train``: the first floor(n * ratio) in shuffled order.

    Ranks come from key ranges and their sizes, so no task sorts all rows.
    """
    size = int(nodes.count() * ratio)
    drawn = nodes.withColumn("_key", F.struct(order_key(seed, F.col(key)).alias("k"), F.col(key).alias("id")))
    return dense_index(drawn, "_key", "_nth").withColumn("train", F.col("_nth") < size).select(*nodes.columns, "train")


def stratified_split(nodes: DataFrame, ratio: float, seed: int, label: str = "label", key: str = "node_id") -> DataFrame | None:
    """``nodes`` with ``train``: round-half-even(n * ratio) of each class, between 1 and n - 1.

    None with fewer than two classes, or with a class of one. Rows are ranked
    by class and shuffled key together, in ranges that may part a large class.
    """
    sizes = nodes.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes, least = sizes.agg(F.count(F.lit(1)), F.min("_n")).first()
    if classes < 2 or least < 2:
        return None
    quota = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.rint(F.col("_n") * ratio).cast("long")))
    lower = F.coalesce(F.sum("_n").over(W.orderBy(label).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per class
    drawn = nodes.withColumn("_key", F.struct(F.col(label).alias("c"), order_key(seed, F.col(key)).alias("k"), F.col(key).alias("id")))
    ends = sizes.select(label, (lower + quota).alias("_end"))
    return dense_index(drawn, "_key", "_nth").join(ends, label).withColumn("train", F.col("_nth") < F.col("_end")).select(*nodes.columns, "train")


@dataclass
class LabelCleanup:
    labels: DataFrame
    counts: dict = field(default_factory=dict)


def clean_labels(nodes: DataFrame, mode: str = "off", min_support: int = 5) -> LabelCleanup:
    """Labels of classes with enough support, others -1, remapped to 0..k-1.

    In mode ``eval_only`` classes under max(2, min_support) rows are dropped;
    if fewer than two classes survive, all labels are.
    """
    known = nodes.where("label >= 0")
    support = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    raw_rows, raw_classes = support.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    counts = {"labeled_nodes_raw": raw_rows, "labeled_nodes": raw_rows, "eval_dropped_labeled_nodes": 0, "eval_class_count_raw": raw_classes, "eval_class_count": raw_classes, "eval_dropped_class_count": 0, "label_cleanup_mode": mode, "min_class_support": min_support}
    if mode != "eval_only":
        return LabelCleanup(nodes, counts)
    kept = support.where(F.col("n") >= max(2, min_support))
    rows, classes = kept.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if classes < 2:
        kept, rows, classes = kept.limit(0), 0, 0
    dense = kept.select("label", (F.dense_rank().over(W.orderBy("label")) - 1).alias("_dense"))
    out = nodes.join(F.broadcast(dense), "label", "left").withColumn("label", F.coalesce("_dense", F.lit(-1)).cast("long")).select(*nodes.columns)
    counts |= {"labeled_nodes": rows, "eval_dropped_labeled_nodes": raw_rows - rows, "eval_class_count": classes, "eval_dropped_class_count": raw_classes - classes}
    return LabelCleanup(out, counts)


def confusion(predicted: DataFrame, label: str = "label", guess: str = "pred") -> DataFrame:
    """(class, tp, fp, fn) for the classes that occur in ``label``."""
    cells = predicted.groupBy(label, guess).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(True).alias("true")), F.struct(F.col(guess).alias("class"), F.lit(False).alias("true")))).alias("side"), F.col(label) == F.col(guess), "n").toDF("side", "hit", "n")
    out = both.groupBy(F.col("side.class").alias("class")).agg(
        F.sum(F.when(F.col("side.true") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("side.true") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("side.true") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fn"),
        F.max("side.true").alias("_true"),
    )
    return out.where("_true").drop("_true")


def f1(predicted: DataFrame, label: str = "label", guess: str = "pred") -> DataFrame:
    """One row (macro_f1, micro_f1). Only classes of the true labels count."""
    c = confusion(predicted, label, guess)
    own = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return c.agg(F.coalesce(F.avg(own), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.when(tp > 0, 2.0 * tp / (2.0 * tp + fp + fn)), F.lit(0.0)).alias("micro_f1"))


def centroid_predict(emb: DataFrame, split: DataFrame, d: int) -> DataFrame:
    """(node_id, label, pred) of the test rows: the class whose mean train vector is nearest by cosine, ties to the lower class.

    Centroids are one row per class and go to all tasks.
    """
    rows = split.join(emb, "node_id")
    means = rows.where("train").groupBy("label").agg(F.array(*[F.avg(F.col("vec")[j]) for j in range(d)]).alias("mean"))
    means = means.select(F.col("label").alias("class"), l2_normalize(F.col("mean")).alias("mean"))
    test = rows.where(~F.col("train")).select("node_id", "label", l2_normalize(F.col("vec")).alias("vec"))
    score = F.aggregate(F.zip_with("vec", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = test.join(F.broadcast(means), F.lit(True)).select("node_id", "label", score.alias("score"), "class")
    return scored.groupBy("node_id", "label").agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("pred"))


#: Numbers (rows x columns) up to which all steps of a regression run in one task: 32 MB.
ONE_TASK = 1 << 22


def _softmax_sums(x: np.ndarray, code: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum over rows of x' (p - y) weight, columns x classes."""
    z = x @ w
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
    p[np.arange(len(code)), code] -= 1.0
    return x.T @ (p * weight[:, None])


def softmax_weights(rows: DataFrame, d: int, classes: int, total: float, steps: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights (d + 1 x classes, the last row is the bias) after ``steps`` full-batch steps from 0.01 normals.

    ``rows`` has (vec, code, weight), ``total`` is the sum of weights. A step sums the gradient class by class in the tasks; where all
    rows are at most ``ONE_TASK`` numbers, the steps run in the one task that they fit into. The driver holds the weights.
    """
    w = 0.01 * np.random.default_rng(seed).normal(size=(d + 1, classes))

    def parts(batch):
        x = np.asarray(batch.column("vec").flatten(), dtype=np.float64).reshape(batch.num_rows, d)
        return np.hstack([x, np.ones((len(x), 1))]), batch.column("code").to_numpy(zero_copy_only=False), batch.column("weight").to_numpy(zero_copy_only=False)

    def moved(w, sums):
        reg = decay * w
        reg[-1] = 0.0
        return w - rate * (sums / max(total, 1e-12) + reg)

    def by_class(sums):
        return pa.RecordBatch.from_pydict({"class": pa.array(range(classes), pa.int32()), "sums": pa.array(list(sums.T), pa.list_(pa.float64()))})

    schema = "class int, sums array<double>"
    rows = cut(rows.select("vec", "code", "weight"))
    if rows.count() * (d + 1) <= ONE_TASK:

        def all_steps(batches):
            got = [parts(b) for b in batches if b.num_rows]
            out = w
            if got:
                x, code, weight = (np.concatenate([g[i] for g in got]) for i in range(3))
                for _ in range(steps):
                    out = moved(out, _softmax_sums(x, code, weight, out))
            yield by_class(out)

        done = {r["class"]: r["sums"] for r in rows.coalesce(1).mapInArrow(all_steps, schema).collect()}
        return np.array([done[c] for c in range(classes)]).T

    def pack(batches):
        """Rows as bytes, an Arrow batch in one row: what every step reads goes to Python at once, not number by number."""
        for b in batches:
            if b.num_rows:
                x, code, weight = parts(b)
                yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "code": [code.astype(np.int64).tobytes()], "weight": [weight.tobytes()]})

    packed = cut(rows.mapInArrow(pack, "x binary, code binary, weight binary"))
    for _ in range(steps):

        def one_step(batches, w=w):
            total = np.zeros_like(w)
            for b in batches:
                for x, code, weight in zip(*(b.column(c) for c in ("x", "code", "weight")), strict=True):
                    total += _softmax_sums(np.frombuffer(x.as_buffer()).reshape(-1, d + 1), np.frombuffer(code.as_buffer(), np.int64), np.frombuffer(weight.as_buffer()), w)
            yield by_class(total)

        sums = np.zeros_like(w)
        for r in packed.mapInArrow(one_step, schema).groupBy("class").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(d + 1)]).alias("sums")).collect():
            sums[:, r["class"]] = r["sums"]
        w = moved(w, sums)
    return w


def logreg_predict(emb: DataFrame, split: DataFrame, d: int, weight_decay: float = 1e-4, epochs: int = 260, class_weight: str = "none", rate: float = 0.3, seed: int = 42) -> DataFrame:
    """(node_id, label, pred) of the test rows by softmax regression on standardised vectors: max(20, epochs) full-batch steps.

    With ``class_weight`` balanced, a row weighs n / (classes * rows of its class). Of equal scores the lower class wins.
    """
    rows = split.join(emb, "node_id")
    train, test = rows.where("train"), rows.where(~F.col("train"))
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    codes = cut(dense_index(sizes, "label", "_code"))
    k, n = codes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    if k < 2:
        return test.select("node_id", "label").join(codes.select(F.col("label").alias("pred")), F.lit(True), "left")  # one row at most
    mean, std = standard_stats(train, "vec", d)
    scaled = lambda df: df.withColumn("vec", standardize(F.col("vec"), mean, [max(s, 1e-8) for s in std]))
    weight = F.lit(float(n)) / (F.col("_size") * k) if class_weight == "balanced" else F.lit(1.0)
    ready = scaled(train).join(codes, "label").select("vec", F.col("_code").alias("code"), weight.cast("double").alias("weight"))
    w = softmax_weights(ready, d, k, float(n), max(20, epochs), rate, weight_decay, seed)
    kinds = {c: emb.schema["node_id"].dataType.simpleString() if c == "node_id" else split.schema["label"].dataType.simpleString() for c in ("node_id", "label")}

    def guess(batches):
        for b in batches:
            x = np.asarray(b.column("vec").flatten(), dtype=np.float64).reshape(b.num_rows, d)
            yield pa.RecordBatch.from_pydict({"node_id": b.column("node_id"), "label": b.column("label"), "_code": pa.array((x @ w[:-1] + w[-1]).argmax(axis=1) if len(x) else [], pa.int64())})

    coded = scaled(test).select("node_id", "label", "vec").mapInArrow(guess, f"node_id {kinds['node_id']}, label {kinds['label']}, _code long")
    return coded.join(codes.select("_code", F.col("label").alias("pred")), "_code").select("node_id", "label", "pred")


def auc(scored: DataFrame, positive: str = "positive", score: str = "score") -> DataFrame:
    """One row ``auc``: mean of [pos > neg] + half ties; 0 if a side is empty.

    By rank sum over distinct scores: rows are counted per score first, and
    ranks come from running sums over score ranges, not one global window.
    """
    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("n"))
    ranked = _running(per, "s", ["n"])
    return ranked.agg(
        F.coalesce(F.sum(F.col("p") * (F.col("before_n") + 0.5 * F.col("n"))) / F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum("p") * F.sum("n")), F.lit(0.0)).alias("auc")
    )


def _running(per: DataFrame, key: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``per`` (one row per key) with ``before_<sum>``: the sums over all rows ahead of it."""
    order = F.desc(key) if descending else F.asc(key)
    dealt = cut(per.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    ahead = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_start_{c}") for c in sums])
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_range")
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_range", *[f"_start_{c}" for c in sums])


def average_precision(scored: DataFrame, positive: str = "positive", score: str = "score") -> DataFrame:
    """One row ``ap``; among equal scores positives come first.

    Inside one score the positives stand at consecutive ranks, so each score's
    share is a sum over its own count.
    """
    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("n"))
    ranked = _running(per, "s", ["p", "n"], descending=True)
    steps = F.when(F.col("p") > 0, F.sequence(F.lit(1).cast("long"), F.col("p"))).otherwise(F.array().cast("array<bigint>"))
    share = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + (F.col("before_p") + i) / (F.col("before_p") + F.col("before_n") + i))
    return ranked.agg(F.coalesce(F.sum(share) / F.when(F.sum("p") > 0, F.sum("p")), F.lit(0.0)).alias("ap"))


def positive_pairs(edges: DataFrame, size: int, seed: int) -> DataFrame:
    """Up to ``size`` edges (u < v) without replacement."""
    return edges.select("u", "v").orderBy(order_key(seed, F.col("u"), F.col("v")), "u", "v").limit(size)


def negative_pairs(edges: DataFrame, index: DataFrame, size: int, seed: int) -> DataFrame:
    """Up to ``size`` random non-edges; trials repeat and may give one pair twice.

    ``index`` has (node_id, idx) with idx from 0; max(30 * size, 1000) trials are drawn.
    """
    spark = edges.sparkSession
    n = index.count()
    trials = spark.range(max(30 * size, 1000))
    draw = lambda side: F.floor(uniform(seed, F.col("id"), side) * n).cast("long")
    drawn = trials.select(F.col("id").alias("trial"), draw("u").alias("i"), draw("v").alias("j")).where("i <> j")
    named = drawn.join(index.select(F.col("node_id").alias("x"), F.col("idx").alias("i")), "i").join(index.select(F.col("node_id").alias("y"), F.col("idx").alias("j")), "j")
    named = named.select("trial", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return named.join(edges.select("u", "v"), ["u", "v"], "left_anti").orderBy("trial").limit(size).select("u", "v")


def _pair_number(i, j):
    """Number of the pair i < j: all pairs of nodes below j come first."""
    return F.expr(f"{j} * ({j} - 1) div 2 + {i}")


def non_edges(edges: DataFrame, index: DataFrame, size: int, seed: int) -> DataFrame:
    """Up to ``size`` non-edges (u < v) without replacement, without making all pairs.

    ``index`` has (node_id, idx) with idx from 0, ``edges`` each pair once. Pairs are numbered, and non-edges by leaving out
    the edges' numbers: the r-th non-edge has number r plus the count of edges ahead of it, a running sum over ranges of
    numbers. Ranks are drawn by hash, the first ``size`` different ones of 4 * size + 100 draws; where half of all non-edges are wanted or more, all
    ranks are drawn and come in hashed order.
    """
    spark = edges.sparkSession
    n = index.count()
    at = lambda c, to: index.select(F.col("node_id").alias(c), F.col("idx").alias(to))
    placed = edges.select("u", "v").join(at("u", "_a"), "u").join(at("v", "_b"), "v").where("_a <> _b")
    numbers = placed.select(F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j")).select(_pair_number("i", "j").alias("e")).distinct()
    ranked = cut(dense_index(numbers, "e", "nth").select((F.col("e") - F.col("nth")).alias("at")))  # non-edges ahead of each edge
    free = n * (n - 1) // 2 - ranked.count()
    if free <= 0 or size <= 0:
        return edges.select("u", "v").limit(0)
    if 2 * size >= free:
        drawn = spark.range(free).select(F.col("id").alias("at"), order_key(seed, F.col("id")).alias("turn"))
    else:
        wide = F.floor((uniform(seed, F.col("id"), "high") + uniform(seed, F.col("id"), "low") / 2.0**32) * F.lit(float(free))).cast("long")
        drawn = spark.range(4 * size + 100).select(F.least(wide, F.lit(free - 1)).alias("at"), F.lpad(F.col("id").cast("string"), 20, "0").alias("turn")).groupBy("at").agg(F.min("turn").alias("turn"))
    drawn = cut(drawn.orderBy("turn", "at").limit(size))
    per = ranked.select("at", F.lit(1).alias("e")).union(drawn.select("at", F.lit(0))).groupBy("at").agg(F.sum("e").alias("e"))
    ahead = _running(per, "at", ["e"]).select("at", (F.col("before_e") + F.col("e")).alias("skip"))
    pairs = drawn.join(ahead, "at").select((F.col("at") + F.col("skip")).alias("p"))
    near = pairs.withColumn("j", F.floor((1.0 + F.sqrt(1.0 + 8.0 * F.col("p"))) / 2.0).cast("long"))
    near = near.withColumn("j", F.expr("case when j * (j - 1) div 2 > p then j - 1 when j * (j + 1) div 2 <= p then j + 1 else j end"))
    ends = near.select(F.expr("p - j * (j - 1) div 2").alias("_i"), F.col("j").alias("_j"))
    named = ends.join(at("_x", "_i"), "_i").join(at("_y", "_j"), "_j")
    return named.select(F.least("_x", "_y").alias("u"), F.greatest("_x", "_y").alias("v"))


def score_links(emb: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(u, v, positive, score) by cosine."""
    pairs = positives.select("u", "v", F.lit(True).alias("positive")).union(negatives.select("u", "v", F.lit(False)))
    return pair_cosine(pairs, emb)


def spread(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, mean, p95, std): mean, exact 95th percentile by linear interpolation and population deviation of a measure."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.95)).alias("p95"), F.stddev_pop(value).alias("std"))


@dataclass
class Protocol:
    classifier: str = "logreg"
    protocol: str = "repeated_stratified"
    repeats: int = 10
    train_ratio: float = 0.7
    cleanup: str = "off"
    min_support: int = 5
    class_weight: str = "none"
    epochs: int = 260
    weight_decay: float = 1e-4
    link_pairs: int = 512
    reconstruction_pairs: int = 1024


def evaluate_snapshot(emb: DataFrame, labels: DataFrame, edges: DataFrame, index: DataFrame, d: int, seed: int, how: Protocol | None = None) -> dict:
    """Node classification over repeated splits, link AUC and AP, and reconstruction AUC."""
    how = how or Protocol()
    out: dict = {"macro_f1": 0.0, "macro_f1_std": 0.0, "micro_f1": 0.0, "micro_f1_std": 0.0, "f1_eval_successful_repeats": 0}
    cleaned = clean_labels(labels, how.cleanup, how.min_support)
    out |= cleaned.counts
    known = cut(cleaned.labels.where("label >= 0").select("node_id", "label"))
    used, repeats = how.protocol, how.repeats if how.protocol == "repeated_stratified" else 1
    scores: list[tuple[float, float]] = []
    if known.count() > 10:
        for r in range(repeats):
            split = stratified_split(known, how.train_ratio, seed + r) if how.protocol == "repeated_stratified" else random_split(known, how.train_ratio, seed + r)
            if split is None:
                used, split = "single_random_fallback", random_split(known, how.train_ratio, seed)
            split = cut(split)
            if split.where("train").select("label").distinct().count() >= 2 and not split.where("not train").isEmpty():
                guess = centroid_predict(emb, split, d) if how.classifier == "centroid" else logreg_predict(emb, split, d, how.weight_decay, how.epochs, how.class_weight, seed=seed + r)
                scores.append(tuple(f1(guess).first()))
            if used == "single_random_fallback":
                break
    if scores:
        for i, name in enumerate(("macro_f1", "micro_f1")):
            xs = [s[i] for s in scores]
            mean = sum(xs) / len(xs)
            out[name], out[f"{name}_std"] = mean, (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5
    out |= {"f1_eval_successful_repeats": len(scores), "f1_eval_repeats": repeats, "f1_eval_protocol": used}
    links = cut(score_links(emb, p := positive_pairs(edges, how.link_pairs, seed), negative_pairs(edges, index, p.count(), seed)))
    out["link_auc"], out["link_ap"] = auc(links).first()[0], average_precision(links).first()[0]
    again = score_links(emb, q := positive_pairs(edges, how.reconstruction_pairs, seed + 999), negative_pairs(edges, index, q.count(), seed + 999))
    out["reconstruction_auc"] = auc(again).first()[0]
    return out
