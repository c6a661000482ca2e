"""Sparse blocks, the spectral solver, non-edges, regression steps and builders against plain versions."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.models.projection import smoothed
from vireo.models.spectral import _rayleigh_ritz, spectral_embedding
from vireo.operators import blocks
from vireo.operators import evaluate as ev
from vireo.operators import graph as g
from vireo.operators import snapshots as sn
from vireo.operators.convert import ConvertConfig, convert, enough_ids, record_counters
from vireo.operators.graph import normalized
from vireo.runtime import cut
from vireo.sources import archives, builders


def rows(df, vec="vec"):
    return {r["node_id"]: np.array(r[vec]) for r in df.collect()}


def random_matrix(n, seed):
    gen = np.random.default_rng(seed)
    a = np.triu(gen.random((n, n)) < 0.15, 1) * gen.random((n, n))
    a = a + a.T
    a[3] = a[:, 3] = 0  # a node without entries
    return a


@pytest.mark.parametrize("entries", [1 << 18, 20])
def test_products_of_blocks(spark, monkeypatch, entries):
    monkeypatch.setattr(blocks, "ENTRIES", entries)
    a, x = random_matrix(50, 1), np.random.default_rng(2).normal(size=(50, 3))
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(50)], "node_id string")
    cells = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "u string, v string, w double")
    matrix = blocks.SparseBlocks(cells, nodes)
    assert matrix.split == (entries == 20)
    at = matrix.start(spark.createDataFrame([(f"n{i:02d}", x[i].tolist()) for i in range(49)], "node_id string, vec array<double>"), send="y")
    x[49] = 0.0
    step = lambda own, p: {"y": p + own["y"], "#squares": (p * p).sum(axis=0)}
    at = cut(matrix.step(matrix.step(at, step), step))
    y = x + a @ x
    got = rows(matrix.rows(at))
    assert np.allclose([got[f"n{i:02d}"] for i in range(50)], y + a @ y) and np.allclose(matrix.total(at, "#squares"), ((a @ y) ** 2).sum(axis=0))
    plan = matrix.step(at, step)._jdf.queryExecution().executedPlan().toString()
    own_exchanges = plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning") + sum(p.split("AdaptiveSparkPlan isFinalPlan")[0].count("Exchange hashpartitioning") for p in plan.split("InMemoryRelation")[1:])
    assert own_exchanges == (2 if matrix.split else 1)
    matrix.close()


def test_cuts_keep_the_last_one_only(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from vireo.runtime import checkpoint_folder

    a = random_matrix(50, 1)
    cells = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "u long, v long, w double")
    matrix = blocks.SparseBlocks(cells, spark.range(50).toDF("node_id"))
    folders = lambda: set(Path(urlparse(checkpoint_folder(spark)).path).glob("blocks-*"))
    before = folders()
    at = matrix.cut(matrix.random(3, 5, send="y"))
    x = rows(matrix.rows(at))
    for _ in range(2):
        at = matrix.cut(matrix.step(at, lambda own, p: {"y": p}))
    got = rows(matrix.rows(at))
    assert np.allclose([got[i] for i in range(50)], a @ a @ np.array([x[i] for i in range(50)]))
    assert len(folders() - before) == 1
    matrix.close()
    assert folders() == before


def test_smoothing_equals_numpy(spark):
    edges = [(i, (i * 7 + k) % 30) for i in range(30) for k in (1, 4) if i != (i * 7 + k) % 30]
    pairs = sorted({(min(p), max(p)) for p in edges})
    e = spark.createDataFrame(pairs, "u long, v long")
    nodes = spark.range(30).toDF("node_id")
    start = np.random.default_rng(4).normal(size=(30, 3))
    a = np.eye(30)
    for u, v in pairs:
        a[u, v] = a[v, u] = 1.0
    s = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    base = unit(6 / 11 * start + 3 / 11 * s @ start + 2 / 11 * s @ s @ start)
    y = base
    for _ in range(5):
        r = y - s @ y
        y = unit(y - 0.35 * 2 * (r - s @ r + 0.2 * (y - base)))
    matrix = blocks.SparseBlocks(normalized(e, nodes), nodes)
    given = spark.createDataFrame([(i, start[i].tolist()) for i in range(30)], "node_id long, vec array<double>")
    got = rows(smoothed(matrix, given, 2, steps=5, tol=0.0))
    assert np.allclose([got[i] for i in range(30)], y)


def test_spectral_solver_beyond_the_dense_size(spark):
    n, gen = 700, np.random.default_rng(6)
    group = np.arange(n) % 3  # three groups, so two values well below the bulk; node 699 has no edge
    pairs = {(i, j) for i in range(n - 1) for j in gen.choice(n - 1, 14) if i < j and (group[i] == group[j] or gen.random() < 0.1)}
    edges = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in pairs], "u long, v long, w double")
    vecs, values = spectral_embedding(edges, spark.range(n).toDF("node_id"), 4, 1)
    got = rows(vecs)
    y = np.array([got[i] for i in range(n)])
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1.0
    d = a.sum(1)
    mass = np.maximum(d, 1.0)
    assert np.allclose((y * mass[:, None] * y).sum(0), 1.0, atol=1e-6)
    residual = ((np.diag(d) - a) @ y - mass[:, None] * y * values) / np.sqrt(mass)[:, None]
    assert np.linalg.norm(residual, axis=0).max() < 1e-3
    half = 1 / np.sqrt(mass)
    exact = np.linalg.eigvalsh((np.diag(d) - a) * half[:, None] * half)
    # Of the least five values those above zero come first, then the zeros (of nodes without edges).
    assert np.allclose(values, [*[x for x in exact[:5] if x > 1e-9], *[x for x in exact[:5] if x <= 1e-9]][:4], atol=1e-4)


def test_directions_lost_in_rounding_are_no_eigenpairs():
    gen = np.random.default_rng(3)
    h = np.diag(np.r_[np.zeros(3), np.ones(37)])
    y = gen.normal(size=(40, 8))
    y[:3] *= 1e9  # as a filter leaves it: the part of eigenvalue 1 is below the rounding of the Gram matrix
    both = np.hstack([y, h @ y])
    turn, values, residual = _rayleigh_ritz(both.T @ both)
    assert turn.shape == (8, 8) and np.isfinite(turn).all() and (np.diff(values) >= 0).all()
    assert np.isfinite(residual).sum() == 3 and (residual[:3] < 1e-3).all() and np.isinf(residual[3:]).all()


def test_values_of_stars(spark):
    n, k = 1500, 25
    links = spark.range(n).selectExpr("concat('c', id) as u", f"concat('n', id % {k}) as v", "1.0D as w")
    nodes = links.selectExpr("u as node_id").union(links.select("v").distinct())
    _, values = spectral_embedding(links, nodes, 30, 42)
    assert np.round(np.abs(values), 4).tolist() == [1.0] * (31 - k) + [0.0] * (k - 1)


@pytest.mark.parametrize("size", [30, 5, 1, 1000])
def test_non_edges(spark, size):
    rng = random.Random(size)
    ids = [f"x{i:02d}" for i in range(20)]
    pairs = {tuple(sorted(rng.sample(ids, 2))) for _ in range(60)}
    edges = spark.createDataFrame(sorted(pairs), "u string, v string")
    index = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "node_id string, idx long")
    got = [tuple(r) for r in ev.non_edges(edges, index, size, 7).collect()]
    free = 190 - len(pairs)
    assert len(got) == len(set(got)) == min(size, free) and not set(got) & pairs and all(u < v for u, v in got)
    assert sorted(got) == sorted(tuple(r) for r in ev.non_edges(edges.repartition(3), index, size, 7).collect())
    assert "NestedLoop" not in ev.non_edges(edges, index, 5, 7)._jdf.queryExecution().executedPlan().toString()


def test_non_edges_of_a_full_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "u string, v string")
    index = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "node_id string, idx long")
    assert ev.non_edges(edges, index, 5, 1).count() == 0


def plain_regression(x, y, test, steps, rate, decay, seed, balanced):
    classes = np.unique(y)
    code = np.searchsorted(classes, y)
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-8)
    xb, tb = (np.hstack([(m - mean) / std, np.ones((len(m), 1))]) for m in (x, test))
    w = 0.01 * np.random.default_rng(seed).normal(size=(xb.shape[1], len(classes)))
    weight = len(y) / (np.bincount(code) * len(classes))[code] if balanced else np.ones(len(y))
    for _ in range(steps):
        z = np.exp(xb @ w - (xb @ w).max(1, keepdims=True))
        off = (z / z.sum(1, keepdims=True) - np.eye(len(classes))[code]) * weight[:, None]
        reg = decay * w
        reg[-1] = 0
        w = w - rate * (xb.T @ off / weight.sum() + reg)
    return w, classes[(tb @ w).argmax(1)]


@pytest.mark.parametrize("balanced", [False, True])
@pytest.mark.parametrize("one_task", [1 << 22, 10])
def test_regression_equals_numpy(spark, monkeypatch, balanced, one_task):
    monkeypatch.setattr(ev, "ONE_TASK", one_task)
    steps = 260 if one_task > 10 else 25
    gen = np.random.default_rng(3)
    y = gen.choice([5, -2, 9], size=90, p=[0.7, 0.2, 0.1])
    x = gen.normal(size=(90, 4)) + (y[:, None] == 9) * 0.9 - (y[:, None] == -2) * 0.5
    emb = spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "node_id long, vec array<double>").repartition(4)
    split = spark.createDataFrame([(i, int(y[i]), i % 3 > 0) for i in range(90)], "node_id long, label long, train boolean")
    train = np.arange(90) % 3 > 0
    got = {r["node_id"]: r["pred"] for r in ev.logreg_predict(emb, split, 4, 1e-2, steps, "balanced" if balanced else "none", seed=11).collect()}
    w, want = plain_regression(x[train], y[train], x[~train], steps, 0.3, 1e-2, 11, balanced)
    assert [got[i] for i in np.flatnonzero(~train)] == want.tolist()
    code = np.searchsorted([-2, 5, 9], y)
    weight = train.sum() / (np.bincount(code[train]) * 3) if balanced else np.ones(3)
    mean, std = x[train].mean(0), x[train].std(0)
    ready = spark.createDataFrame([(((x[i] - mean) / std).tolist(), int(code[i]), float(weight[code[i]])) for i in np.flatnonzero(train)], "vec array<double>, code long, weight double")
    assert np.allclose(ev.softmax_weights(ready, 4, 3, float(train.sum()), steps, 0.3, 1e-2, 11), w, atol=1e-9)


def test_regression_with_one_class(spark):
    emb = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "node_id long, vec array<double>")
    split = spark.createDataFrame([(i, 3 if i < 3 else 4, i < 3) for i in range(4)], "node_id long, label long, train boolean")
    assert [tuple(r) for r in ev.logreg_predict(emb, split, 1).collect()] == [(3, 4, 3)]


def plain_walk(neighbours, total, max_nodes, max_edges, fan=32):
    """Nodes in the order in which a loop meets them, and edges by their places, first mention first."""
    met = []
    for i in range(total):
        for x in ([i, *neighbours[i][:fan]] if neighbours[i] else []):
            if len(met) < max_nodes and x < total and x not in met:
                met.append(x)
    edges = []
    for i, x in enumerate(met):
        for y in neighbours[x]:
            if y in met and y != x:
                e = tuple(sorted((i, met.index(y))))
                if e not in edges and len(edges) < max_edges:
                    edges.append(e)
    return met, edges


@pytest.mark.parametrize("seed", range(4))
def test_citation_builder_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    total = 40
    neighbours = [[rng.randrange(45) for _ in range(rng.choice([0, 0, 2, 5, 40]))] for _ in range(45)]
    adjacency = spark.createDataFrame([(i, s, j) for i, ns in enumerate(neighbours) for s, j in enumerate(ns)], "row long, slot long, col long")
    classes = spark.createDataFrame([(i, i % 7) for i in range(total)], "row long, label long")
    cells = spark.createDataFrame([(i, c, float(i + c)) for i in range(45) for c in range(6) if rng.random() < 0.4], "row long, col long, value double")
    for max_nodes, max_edges in ((12, 1000), (25, 9), (500, 1000)):
        met, edges = plain_walk(neighbours, total, max_nodes, max_edges)
        got = builders.citation_graph(adjacency, cells, classes, max_nodes, max_edges, columns=4)
        assert sorted((int(r["src"][1:]), int(r["dst"][1:])) for r in got["edges"].collect()) == sorted(edges)
        assert {r["node_id"]: r["label"] for r in got["labels"].collect()} == {f"m{i}": x % 7 for i, x in enumerate(met)}
        assert got["features"].count() == len(met) and {len(v) for v in rows(got["features"]).values()} == {4}
    plain = rows(builders.citation_graph(adjacency, cells.limit(0), classes, 12)["features"])
    assert all(len(v) == 3 and np.isclose(v[1], np.log1p(v[0])) for v in plain.values())


def test_conversion_reads_archives_once_and_counts(spark, tmp_path):
    records = [{"id": f"p{i % 5}", "year": 2000 + i, "venue": "V", "references": []} for i in range(8)] + [{"year": 2001}, {"id": "q", "year": "x"}, {"id": "r", "year": 1990, "venue": "V"}]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.json", "\n".join(map(json.dumps, records)))
    config = ConvertConfig(min_venue_support=1, feature_dim=4, min_year=1995)
    opened = spark.sparkContext.accumulator(0)
    raw = archives.read_records(spark, str(tmp_path / "*.zip"))

    def touch(batches):
        for b in batches:
            opened.add(b.num_rows)
            yield b

    watched = raw.mapInArrow(touch, raw.schema)
    out = convert(watched, config)
    assert out.counters["duplicate_ids"] == 3 and opened.value == len(records)
    assert {k: out.counters[k] for k in ("records_total", "missing_id", "invalid_year", "out_of_range", "accepted")} == record_counters(raw, config).first().asDict() == {"records_total": 11, "missing_id": 1, "invalid_year": 1, "out_of_range": 1, "accepted": 8}
    assert out.edges.count() == 0


def test_prefix_opens_no_member_behind_the_cut(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in (3, 1, 2, 0, 5, 4):  # scanned in the order of the directory, not of names
            z.writestr(f"m{k}.JSON", "\n".join(json.dumps({"id": f"p{k}-{i % 3}", "year": 2000, "venue": "V", "references": []}) for i in range(5)))
        z.writestr("readme.txt", "x")
    config = ConvertConfig(max_papers=4, strategy="legacy", min_venue_support=1, feature_dim=4)
    lots = []
    whole = archives.member_lines
    monkeypatch.setattr(archives, "member_lines", lambda members, most: (lots.append(sorted(r["member"] for r in members.collect())), whole(members, most))[1])
    early = archives.read_until(spark, str(tmp_path / "*.zip"), enough_ids(config), first=1)
    assert lots == [["m3.JSON"], ["m1.JSON", "m2.JSON"]]
    every = convert(archives.read_records(spark, str(tmp_path / "*.zip")), config)
    got = convert(early, config)
    assert sorted(map(tuple, got.labels.collect())) == sorted(map(tuple, every.labels.collect())) == [("p1-0", 0), ("p3-0", 0), ("p3-1", 0), ("p3-2", 0)]
    assert got.counters == every.counters and got.counters["records_total"] == 6 and got.counters["duplicate_ids"] == 2


def test_archive_beyond_two_gigabytes_is_shared_by_tasks(spark, tmp_path):
    with open(tmp_path / "big.zip", "wb") as out:
        out.seek(2_300_000_000)  # a hole ahead of the archive, which takes no disk
        out.write(b"x")
    with zipfile.ZipFile(tmp_path / "big.zip", "a") as z:
        for k in range(3):
            z.writestr(f"{k}.json", b'{"id": "p"}\n\n{"id": "' + b"y" * 300 + b'"}\nno json\n{"id": "\xff"}\n{"id": "last"}')
    lines = archives.zip_lines(spark, str(tmp_path / "*.zip"), max_bytes=100)
    assert lines.rdd.getNumPartitions() == 3
    assert sorted((r["number"], r["line_no"], r["raw"]) for r in lines.collect() if r["number"] == 1) == [(1, 0, '{"id": "p"}'), (1, 3, "no json"), (1, 4, None), (1, 5, '{"id": "last"}')]
    assert archives.json_records(lines).count() == 6


def test_key_ranges_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(g, "RANGE", 200)
    keys = [(i * 7919) % 5000 for i in range(5000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    out = g.dense_index(df, "k")
    assert {r["k"]: r["idx"] for r in out.collect()} == {k: k for k in keys}
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 20 and max(sizes) < 5 * 200


def test_deltas_of_many_snapshots_without_a_join(spark):
    """Changes of over two words of bits, as by comparing sets; gaps in the numbers are empty snapshots."""
    rng = np.random.default_rng(5)
    held = {s: {("a", f"b{i}") for i in range(6) if rng.random() < 0.5} for s in range(130) if s % 7}
    snaps = spark.createDataFrame([(s, u, v) for s, es in held.items() for u, v in es], "snap int, u string, v string")
    out = sn.deltas(snaps)
    last = max(s for s, es in held.items() if es)
    want = {(s, op, u, v) for s in range(1, last + 1) for op, a, b in (("add", s, s - 1), ("remove", s - 1, s)) for u, v in held.get(a, set()) - held.get(b, set())}
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert out.columns == ["snap", "op", "u", "v"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sn.deltas(snaps.where("snap < 1")).isEmpty()


def test_delta_is_applied_without_a_join(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "u string, v string")
    delta = spark.createDataFrame([("add", "d", "a"), ("remove", "c", "a"), ("add", "e", "f"), ("remove", "e", "f"), ("add", "g", "g"), ("remove", "x", "y")], "op string, u string, v string")
    out = sn.apply_delta(edges, delta)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "b"), ("a", "d")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scores_read_the_records_once(spark, sf_dir):
    from vireo.plans import catalogue

    assert "parquet" not in catalogue._scored(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_structure_without_products_packs_no_matrix(spark, monkeypatch):
    from vireo.models import projection

    monkeypatch.setattr(projection, "SparseBlocks", None)
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "u string, v string")
    attrs = spark.createDataFrame([(n, [0.0]) for n in "abcd"], "node_id string, vec array<double>")
    model = projection.ProjectionModel(4, order=0, density=0.9, quantize=False, use_attributes=False, steps=0).fit(edges, attrs)
    rows = {r["node_id"]: np.linalg.norm(r["s"]) for r in model.structure.collect()}
    assert set(rows) == set("abcd") and all(np.isclose(x, 1.0) or x == 0.0 for x in rows.values())


def test_anchors_are_those_of_all_edges_at_the_models_width(spark, tmp_path):
    """The last rows in time, outside the first of the windows, reach nodes that no earlier one does."""
    from vireo.models.projection import ProjectionModel
    from vireo.plans import catalogue

    rows = ", ".join(f"({1 + i}, {1 + i % 2}, date '2020-01-{1 + i:02d}')" for i in range(12))
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(l_partkey, l_suppkey, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalogue.anchor_propagation(spark, str(tmp_path))
    assert {r["node_id"] for r in out.collect()} == {f"p{i}" for i in range(1, 13)} | {"s1", "s2"}
    assert len(out.columns) == 1 + ProjectionModel().dim
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert catalogue.anchor_propagation(spark, f"{tmp_path}/none").isEmpty()


def test_a_cut_carries_no_size_estimate_over(spark):
    """Spark sizes a join by the product of its sides: estimates that outlive a cut double their digits at each join."""
    from vireo import runtime
    from vireo.llm import common

    for cut in (runtime.cut, common.cut):
        df = cut(spark.range(20).withColumn("n", F.col("id") % 3))
        for _ in range(8):
            df = cut(df.join(df.select("id", F.col("n").alias("m")), "id").select("id", (F.col("n") + F.col("m")).alias("n")))
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 128
        assert sorted(tuple(r) for r in df.collect()) == [(i, i % 3 * 2**8) for i in range(20)]


def test_a_matrix_leaves_no_tables_and_cuts_no_sent_rows(spark, monkeypatch):
    """What a step sends to other blocks is no part of its cut; the tables a matrix is packed from go as soon as it is."""
    import os

    from vireo.runtime import checkpoint_folder

    monkeypatch.setattr(blocks, "ROWS", 4)
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    e = spark.createDataFrame([(i, (i * 7 + 1) % 20) for i in range(20) if i != (i * 7 + 1) % 20], "u long, v long")
    nodes = spark.range(20).toDF("node_id")
    matrix = blocks.SparseBlocks(normalized(e, nodes), nodes)
    assert len([f for f in set(os.listdir(folder)) - before if f.startswith("blocks-")]) == 1
    given = spark.range(20).select(F.col("id").alias("node_id"), F.array(F.lit(1.0), F.col("id") / 7).alias("vec"))
    out = smoothed(matrix, given, 1, steps=1, tol=0.0)
    kept = spark.read.parquet(matrix._kept)
    assert {r["name"] for r in kept.select("name").distinct().collect()} == {"y", "a", "#moved"}
    assert out.count() == 20
    matrix.close()
    assert not [f for f in set(os.listdir(folder)) - before if f.startswith("blocks-")]
