"""Queries over the test tables, one for each operator or small group of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.functions import rng
from vireo.functions import text as tx
from vireo.functions import vectors as vx
from vireo.models.projection import gate_of
from vireo.operators import convert as cv
from vireo.operators import evaluate as ev
from vireo.operators import graph as g
from vireo.operators import quantize as qz
from vireo.operators import similarity as sim
from vireo.operators import snapshots as sn
from vireo.runtime import checkpoint_folder, cut
from vireo.streaming import replay as rp
from vireo.streaming.state import StateStore

K = 4
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(col):
    return F.unix_micros(F.col(col).cast("timestamp")) / 1e6


def bipartite(spark, sf_dir) -> DataFrame:
    """Raw temporal edges part - supplier."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), seconds("l_shipdate").alias("t"))


def emb(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


def papers(spark, sf_dir) -> DataFrame:
    """Orders as records: the parts of an order are its references, as order ids."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    refs = items.groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("references"))
    met = orders.join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return met.select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("id"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderpriority").alias("venue"), F.coalesce("references", F.array().cast("array<string>")).alias("references"))


def windows(spark, sf_dir) -> DataFrame:
    """Snapshots, cut, as the queries read them several times; the raw edges are read twice instead, once for their quantiles."""
    return cut(sn.window_snapshots(g.clean(bipartite(spark, sf_dir)), K))


def first_snapshot(spark, sf_dir) -> DataFrame:
    return windows(spark, sf_dir).where("snap = 0").select("u", "v")


def r6(c):
    return F.round(c, 6)


def r6_unsigned_zero(c):
    """Rounded sums, where the order of terms decides the sign of a zero."""
    return F.round(c, 6) + F.lit(0.0)


# ---- queries -------------------------------------------------------------


def edges_clean_undirected(spark, sf_dir):
    return g.canonical(g.clean(bipartite(spark, sf_dir)))


def node_index(spark, sf_dir):
    e = g.clean(bipartite(spark, sf_dir))
    return g.dense_index(g.universe(e.select("src"), e.select("dst")), "node_id")


def degree_topn(spark, sf_dir):
    return g.top_nodes(g.degree_with_repeats(bipartite(spark, sf_dir)), 50)


def downsample_edges(spark, sf_dir):
    kept = g.downsample(bipartite(spark, sf_dir), 200)
    return kept.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def downsample_nodes(spark, sf_dir):
    """Three quarters of all parts, suppliers and customers, by degree in the part-supplier graph; customers have no edge there."""
    key = lambda name, letter, col: table(spark, sf_dir, name).select(F.concat(F.lit(letter), F.col(col).cast("string")))
    nodes = cut(g.universe(key("part", "p", "p_partkey"), key("supplier", "s", "s_suppkey"), key("customer", "c", "c_custkey")))
    return g.downsample_nodes(nodes, bipartite(spark, sf_dir), nodes.count() * 3 // 4)


def snapshot_window(spark, sf_dir):
    return windows(spark, sf_dir)


def snapshot_cumulative(spark, sf_dir):
    return sn.cumulative_snapshots(windows(spark, sf_dir), K).groupBy("snap").agg(F.count(F.lit(1)).alias("edges"))


def snapshot_equal_count(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("l"))
    return sn.equal_count_snapshots(rows, K, ["l_orderkey", "l_linenumber", "k", "l"]).groupBy("snap").agg(F.count(F.lit(1)).alias("edges"))


def snapshot_delta(spark, sf_dir):
    return sn.deltas(windows(spark, sf_dir))


def flagship(spark, sf_dir):
    return snapshot_delta(spark, sf_dir).groupBy("snap", "op").agg(F.count(F.lit(1)).alias("edges"))


def delta_replay(spark, sf_dir):
    snaps = windows(spark, sf_dir)
    return sn.apply_delta(snaps.where("snap = 0"), sn.deltas(snaps).where("snap = 1"))


def attr_update_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(seconds("ts").alias("t"), "user_id", "event_id", "value")
    cuts = sn.quantiles(rows, "t", [i / K for i in range(K + 1)])
    return sn.attribute_updates(rows, cuts, "user_id", "t", "event_id", "value")


def affected_nodes(spark, sf_dir):
    snaps = windows(spark, sf_dir)
    touched = spark.createDataFrame([("s1",), ("s2",), ("p3",)], "node_id string")
    return g.affected(snaps.where("snap = 0"), snaps.where("snap = 1"), touched)


def norm_adjacency(spark, sf_dir):
    return g.normalized(first_snapshot(spark, sf_dir)).select("u", "v", F.round("w", 9).alias("w"))


def laplacian_entries(spark, sf_dir):
    return g.laplacian(first_snapshot(spark, sf_dir))


def neighbor_mean(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    out = g.neighbor_mean(first_snapshot(spark, sf_dir), part, ["size", "price"])
    return out.select("node_id", r6("size").alias("size"), r6("price").alias("price"))


def anchor_propagation(spark, sf_dir):
    """Anchors over all edges, at the width, density and order of the model."""
    from vireo.models.projection import ProjectionModel, random_projection, smoothed
    from vireo.operators.blocks import SparseBlocks

    model = ProjectionModel()
    d = model.dim
    edges = cut(edges_clean_undirected(spark, sf_dir))
    nodes = cut(g.both_ways(edges).select(F.col("u").alias("node_id")).distinct())
    matrix = SparseBlocks(g.normalized(edges, nodes), nodes)
    out = cut(smoothed(matrix, vx.pack(random_projection(nodes, d, model.density, SEED), d), model.order, steps=0))
    matrix.close()
    return vx.unpack(out, "vec", d).select("node_id", *[r6_unsigned_zero(f"y{j}").alias(f"y{j}") for j in range(d)])


def feature_standardize(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("vec"))
    mean, std = vx.standard_stats(rows, "vec", 2)
    z = vx.standardize(F.col("vec"), mean, std)
    return rows.select("p_partkey", r6(z[0]).alias("size"), r6(z[1]).alias("price"))


def row_l2_normalize(spark, sf_dir):
    v = vx.l2_normalize(F.col("vec"))
    return emb(spark, sf_dir).select("node_id", r6(v[0]).alias("first"), r6(v[63]).alias("last"), r6(vx.norm(v)).alias("norm"))


def cosine_pairs(spark, sf_dir):
    e = emb(spark, sf_dir)
    pairs = e.select(F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"))
    return sim.pair_cosine(pairs, e.select("node_id", "vec")).select("u", "v", r6("score").alias("score"))


def topk_cosine_graph(spark, sf_dir):
    graph = sim.topk_graph(emb(spark, sf_dir).select("node_id", "vec"), 5)
    return graph.select("u", "v", r6("w").alias("w"))


def exp_log_map(spark, sf_dir):
    v = vx.scale(vx.l2_normalize(F.col("vec")), 0.5)
    up = vx.exp0(v)
    back = vx.log0(up)
    return emb(spark, sf_dir).select("node_id", r6(up[0]).alias("up"), r6(back[0]).alias("back"), r6(vx.norm(up)).alias("radius"))


def mobius_fuse(spark, sf_dir):
    half = lambda a: vx.l2_normalize(F.slice("vec", a, 4))
    fused = vx.fuse(F.lit(0.3), half(1), half(5))
    out = emb(spark, sf_dir).select("node_id", fused.alias("f"))
    return out.select("node_id", *[r6(F.col("f")[j]).alias(f"f{j}") for j in range(4)])


def _quantized(spark, sf_dir):
    e = emb(spark, sf_dir).select("node_id", "vec")
    scales = qz.int8_scales(e, 64)
    return qz.int8_quantize(e, scales), scales


def int8_quantize(spark, sf_dir):
    q, _ = _quantized(spark, sf_dir)
    return q.select("node_id", F.posexplode("q").alias("dim", "q")).select("node_id", F.col("dim").cast("long").alias("dim"), F.col("q").cast("long").alias("q"))


def int8_error(spark, sf_dir):
    q, scales = _quantized(spark, sf_dir)
    return qz.relative_error(qz.dequantize(q, scales, out="back"), "vec", "back").select(r6("error").alias("error"))


def binary_quantize(spark, sf_dir):
    b = qz.binary_quantize(emb(spark, sf_dir))
    return b.select("node_id", F.aggregate("b", F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"), F.col("b")[0].cast("long").alias("first"))


def _delta_edges(spark, sf_dir):
    snaps = windows(spark, sf_dir)
    return snaps.where("snap = 0").select("u", "v"), cut(sn.deltas(snaps).where("snap = 1"))


def incremental_struct_update(spark, sf_dir):
    from vireo.models.projection import incremental_structure, random_projection

    d = 4
    before, delta = _delta_edges(spark, sf_dir)
    after = cut(sn.apply_delta(before, delta))
    nodes = g.universe(*[g.both_ways(e).select("u") for e in (before, after)])
    old = cut(random_projection(nodes, d, 0.5, SEED))
    out = incremental_structure(old, delta, after, d, 0.55)
    return out.select("node_id", *[r6_unsigned_zero(f"y{j}").alias(f"y{j}") for j in range(d)])


def text_hash_features(spark, sf_dir):
    counts = cv.hashed_counts(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 16)
    return counts.select("doc_id", F.col("bucket").cast("long").alias("bucket"), "n")


def venue_labels(spark, sf_dir):
    return cv.venue_support(cv.valid_records(papers(spark, sf_dir), cv.ConvertConfig()), 100)


def _scored(spark, sf_dir):
    config = cv.ConvertConfig(min_venue_support=100).resolved()
    valid = cut(cv.valid_records(papers(spark, sf_dir), config))
    return cv.paper_scores(cv.first_per_id(valid), cv.in_counts(valid), cv.venue_support(valid, config.min_venue_support))


def paper_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", F.col("in_count").cast("long").alias("in_count"), F.col("out_count").cast("long").alias("out_count"), "score")


def dense_select(spark, sf_dir):
    pool = cut(cv.best(_scored(spark, sf_dir), 600))
    return cv.best(cv.dense_rescore(pool), 300).select("id", "score")


def unresolved_references(spark, sf_dir):
    kept = cut(cv.best(_scored(spark, sf_dir), 600))
    edges, missing = cv.resolved_references(kept)
    return edges.agg(F.count(F.lit(1)).alias("resolved")).join(missing, F.lit(True))


def record_counters(spark, sf_dir):
    return cv.record_counters(papers(spark, sf_dir), cv.ConvertConfig(min_year=1996, max_year=2000))


def reference_edges(spark, sf_dir):
    return cv.internal_links(cv.valid_records(papers(spark, sf_dir), cv.ConvertConfig()))


def _labelled(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "source")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node_id"), (F.col("quality") * 2 + F.col("toxic")).cast("long").alias("label"))
    return rows.join(lab, "node_id", "left").select("node_id", F.coalesce("label", F.lit(-1)).alias("label"))


def label_cleanup(spark, sf_dir):
    return ev.clean_labels(_labelled(spark, sf_dir), "eval_only", 20).labels


def stratified_split(spark, sf_dir):
    return ev.stratified_split(emb(spark, sf_dir).select("node_id", "label"), 0.7, SEED)


def random_split(spark, sf_dir):
    return ev.random_split(emb(spark, sf_dir).select("node_id"), 0.7, SEED)


def _predicted(spark, sf_dir):
    e = emb(spark, sf_dir)
    return ev.centroid_predict(e.select("node_id", "vec"), ev.stratified_split(e.select("node_id", "label"), 0.7, SEED), 64)


def centroid_predict(spark, sf_dir):
    return _predicted(spark, sf_dir)


def confusion(spark, sf_dir):
    return ev.confusion(_predicted(spark, sf_dir))


def f1_scores(spark, sf_dir):
    return ev.f1(_predicted(spark, sf_dir)).select(r6("macro_f1").alias("macro_f1"), r6("micro_f1").alias("micro_f1"))


def _purchase_or_view(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    return rows.select((F.col("event_type") == "purchase").alias("positive"), F.col("value").alias("score"))


def link_auc(spark, sf_dir):
    return ev.auc(_purchase_or_view(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


def link_ap(spark, sf_dir):
    return ev.average_precision(_purchase_or_view(spark, sf_dir)).select(F.round("ap", 9).alias("ap"))


def pair_sampling_pos(spark, sf_dir):
    return ev.positive_pairs(first_snapshot(spark, sf_dir), 128, SEED)


def pair_sampling_neg(spark, sf_dir):
    edges = first_snapshot(spark, sf_dir)
    index = g.dense_index(g.both_ways(edges).select(F.col("u").alias("node_id")).distinct(), "node_id")
    return ev.negative_pairs(edges, index, 128, SEED)


def copurchase_selfjoin(spark, sf_dir):
    pairs = g.shared_targets(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", 500)
    return g.degree(pairs).select("node_id", "degree")


def latency_p95(spark, sf_dir):
    got = ev.spread(table(spark, sf_dir, "events"), "value", "event_type")
    return got.select("event_type", F.round("mean", 9).alias("mean"), F.round("p95", 9).alias("p95"), r6("std").alias("std"))


def global_quantiles(spark, sf_dir):
    qs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = sn.quantiles(table(spark, sf_dir, "events"), "value", qs)
    return spark.createDataFrame(list(zip(qs, [round(x, 9) for x in got], strict=True)), "q double, value double")


def results_alias_merge(spark, sf_dir):
    from vireo.sources.results import merge_aliases

    rows = table(spark, sf_dir, "events")
    blank = lambda cond, x: F.when(cond, x).otherwise(F.lit(" "))
    shown = rows.select("event_id", blank(F.col("event_id") % 3 == 0, F.col("event_type")).alias("algo"), blank(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).alias("algorithm"), F.lit("").alias("model"), F.col("event_id").cast("string").alias("num_nodes"))
    return merge_aliases(shown, keep=["event_id"]).select("event_id", "model", "nodes")


def history_patch_mean(spark, sf_dir):
    from vireo.models.attention import patch_means

    rows = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id", F.day(F.col("ts")).alias("t")).agg(F.avg("value").alias("y0"))
    out = patch_means(rows, "user_id", "t", ["y0"], history=8, patch=3)
    return out.select("user_id", F.col("patch").cast("long").alias("patch"), r6("y0").alias("y0"))


def last_wins_upsert(spark, sf_dir):
    from vireo.sources.tables import last_wins

    rows = table(spark, sf_dir, "events").select("user_id", F.struct("event_type", "value").alias("r"), F.col("event_id").alias("seq"))
    return last_wins(rows, "r", "user_id").select("user_id", "r.event_type", "r.value")


def node_universe(spark, sf_dir):
    e = bipartite(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    supp = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    return g.universe(e.select("src"), e.select("dst"), part, supp)


def venue_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), F.upper("p_type"), F.lit("\t \n"), F.col("p_name"), F.lit(" ")).alias("raw"))
    return rows.select("p_partkey", tx.venue(F.col("raw")).alias("venue"))


def scalar_parsing(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "abc").when(F.col("event_id") % 5 == 2, "1999.7").when(F.col("event_id") % 5 == 3, "nan").otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", tx.number(F.col("raw")).alias("number"), tx.year(F.col("raw")).cast("long").alias("year"))


def dense_labels(spark, sf_dir):
    kinds = g.dense_index(table(spark, sf_dir, "part").select("p_brand").distinct(), "p_brand", "label")
    return table(spark, sf_dir, "part").join(F.broadcast(kinds), "p_brand").select("p_partkey", "label")


def argmax_label(spark, sf_dir):
    return emb(spark, sf_dir).select("node_id", vx.argmax(F.col("vec")).cast("long").alias("place"))


def sigmoid_softmax(spark, sf_dir):
    s = vx.softmax(F.slice("vec", 1, 8))
    return emb(spark, sf_dir).select("node_id", r6(vx.sigmoid(F.col("vec")[0] * 10)).alias("sig"), r6(s[0]).alias("soft"), r6(F.aggregate(s, F.lit(0.0), lambda a, x: a + x)).alias("total"))


def default_attributes(spark, sf_dir):
    from vireo.sources.tables import with_defaults

    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"))
    known = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node_id"), F.array("p_retailprice").alias("vec"))
    return with_defaults(nodes, known, 1, SEED).select(F.col("node_id").alias("p_partkey"), r6(F.col("vec")[0]).alias("x"))


def text_statistics(spark, sf_dir):
    s = tx.statistics(F.regexp_replace("text", r"[^\x21-\x7E]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.col("s.words").cast("long").alias("words"), F.col("s.chars").cast("long").alias("chars"), r6("s.log_words").alias("log_words"))


def one_hot_membership(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("col"), F.lit(1.0).alias("value")).distinct()
    places = cv.top_columns(pairs, 3)
    out = cv.dense_from_sparse(pairs, places, 3)
    return out.select("node_id", *[F.col("vec")[j].cast("long").alias(f"c{j}") for j in range(3)])


def top_features(spark, sf_dir):
    return cv.top_columns(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("col")), 64).select("col", F.col("place").cast("long").alias("place"))


def batch_event_counts(spark, sf_dir):
    return sn.deltas(windows(spark, sf_dir)).groupBy("snap").agg(F.count_if(F.col("op") == "add").alias("added"), F.count_if(F.col("op") == "remove").alias("removed"), F.count(F.lit(1)).alias("events"))


def gate_value(spark, sf_dir):
    half = lambda a: vx.l2_normalize(F.slice("vec", a, 4))
    return emb(spark, sf_dir).select("node_id", r6(gate_of(half(1), half(5), [0.1 * (j % 3 - 1) for j in range(8)], 0.05)).alias("gate"))


def reconstruction_scores(spark, sf_dir):
    e = emb(spark, sf_dir)
    graph = sim.topk_graph(e.select("node_id", "vec"), 3).select("u", "v")
    index = g.dense_index(e.select("node_id"), "node_id")
    links = ev.score_links(e.select("node_id", "vec"), ev.positive_pairs(graph, 200, SEED), ev.non_edges(graph, index, 200, SEED))
    return ev.auc(links).select(r6("auc").alias("auc"))


def synthetic_graph(spark, sf_dir):
    """Links drawn among all customers, most of them inside a market segment."""
    from vireo.sources.synthetic import planted_links

    return planted_links(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("label")), 4, 1, SEED)


def spectral_values(spark, sf_dir):
    """Least eigenvalues of the customer-nation graph, whose components are stars: a zero for each nation, and ones."""
    from vireo.models.spectral import spectral_embedding

    links = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("u"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("v"), F.lit(1.0).alias("w"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    _, values = spectral_embedding(links, g.universe(links.select("u"), nations), 30, SEED)
    return spark.createDataFrame([(k, round(float(x), 4) + 0.0) for k, x in enumerate(values)], "place long, value double")


def stream_daily_windows(spark, sf_dir):
    """Opens a stream on the events, runs it until all are read and returns the last state of each window."""
    path = f"{sf_dir}/events.parquet"
    folder = f"{checkpoint_folder(spark)}/windows-{uuid.uuid4().hex}"
    either = f"{sf_dir}/event[s].parquet"  # a pattern: as a plain path a stream takes a folder only
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(either).select("event_type", "ts", "value")
    counts = rp.windowed_counts(stream, "ts", "event_type", late=None, value="value")
    rp.stream_windows(counts, f"{folder}/out", f"{folder}/state").awaitTermination()
    last = rp.latest_windows(spark.read.parquet(f"{folder}/out"), "event_type")
    return last.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", r6("total").alias("total"))


def stream_restart_structure(spark, sf_dir):
    """Structure vectors after two streams of changes, where a new driver goes on from the state that the first one left."""
    from vireo.models.projection import ProjectionModel

    snaps = windows(spark, sf_dir)
    rows = cut(sn.deltas(snaps).where("snap <= 2"))
    folder = f"{checkpoint_folder(spark)}/restart-{uuid.uuid4().hex}"
    unfitted = lambda: ProjectionModel(4, order=0, density=0.5, learning_rate=0.55, quantize=False, use_attributes=False, steps=0, seed=SEED)
    nodes = g.both_ways(snaps.where("snap <= 2")).select(F.col("u").alias("node_id")).distinct()
    model = unfitted().fit(snaps.where("snap = 0").select("u", "v"), nodes.withColumn("vec", F.array(F.lit(0.0))))
    for snap in (1, 2):
        none = {f.name: F.lit(None).cast(f.dataType) for f in T._parse_datatype_string(rp.CHANGE) if f.name not in rows.columns}
        rows.where(F.col("snap") == snap).withColumns(none).selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()})" for f in T._parse_datatype_string(rp.CHANGE)]).write.mode("append").parquet(f"{folder}/in")
        rp.stream_updates(spark.readStream.schema(rp.CHANGE).parquet(f"{folder}/in"), model, f"{folder}/out", f"{folder}/progress").awaitTermination()
        model = unfitted()
    last, _ = StateStore(spark, f"{folder}/out/state").load()
    return vx.unpack(last["structure"], "s", 4).select("node_id", *[r6_unsigned_zero(f"y{j}").alias(f"y{j}") for j in range(4)])


QUERIES = {
    f.__name__: f
    for f in (
        flagship, edges_clean_undirected, node_index, node_universe, degree_topn, downsample_edges, downsample_nodes, snapshot_window, snapshot_cumulative,
        snapshot_equal_count, snapshot_delta, delta_replay, batch_event_counts, attr_update_bins, affected_nodes, norm_adjacency,
        laplacian_entries, neighbor_mean, anchor_propagation, feature_standardize, row_l2_normalize, cosine_pairs, topk_cosine_graph,
        exp_log_map, mobius_fuse, gate_value, sigmoid_softmax, int8_quantize, int8_error, binary_quantize, incremental_struct_update,
        text_hash_features, text_statistics, venue_labels, venue_normalize, scalar_parsing, paper_score, dense_select, reference_edges,
        unresolved_references, record_counters, label_cleanup, stratified_split, random_split, centroid_predict, confusion, f1_scores,
        link_auc, link_ap, reconstruction_scores, pair_sampling_pos, pair_sampling_neg, copurchase_selfjoin, latency_p95, global_quantiles,
        results_alias_merge, history_patch_mean, last_wins_upsert, dense_labels, argmax_label, default_attributes, one_hot_membership,
        top_features, synthetic_graph, spectral_values, stream_daily_windows, stream_restart_structure,
    )
}
