import gzip
import io
import json
import tarfile
import zipfile

import numpy as np
import pytest

from vireo.operators import evaluate as ev
from vireo.operators.convert import ConvertConfig, convert
from vireo.sources import archives, sinks, tables
from vireo.sources.results import COLUMNS, append_results
from vireo.streaming.replay import CHANGE, percentile, stream_updates, windowed_counts


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_directory_to_snapshots(spark, tmp_path):
    put(tmp_path / "edges.csv", "﻿src,dst,time\n u1 ,u2,1\nu2,u3,2\nu1,u1,3\n,u2,4\nu3,u4,2020-01-01\nu1,u2,9\n")
    put(tmp_path / "features.csv", "node_id,f1,f2\nu1,1,\nu2,2,5\nu1,7,8\n")
    put(tmp_path / "labels.csv", "node_id,label\nu1,1.9\nu5,-2\n")
    put(tmp_path / "attr_updates.csv", "time,node_id,f1,f2\n1577836800,u1,5,6\n0,u9,bad,1\n")
    g = tables.from_directory(spark, str(tmp_path), snapshots=2)
    assert [r[0] for r in g.index.orderBy("idx").collect()] == ["u1", "u2", "u3", "u4", "u5"]
    got = {r["node_id"]: r["vec"] for r in g.attributes.collect()}
    assert got["u1"] == [7.0, 8.0] and len(got["u3"]) == 2
    assert {r["node_id"]: r["label"] for r in g.labels.collect()} == {"u1": 1, "u2": -1, "u3": -1, "u4": -1, "u5": -2}
    assert [(r["snap"], r["node_id"], r["vec"]) for r in g.updates.collect()] == [(1, "u1", [5.0, 6.0])]


def test_down_sampling_keeps_chosen_nodes_without_edges(spark):
    edges = spark.createDataFrame([("a", "b", "1"), ("b", "c", "2"), ("c", "d", "3"), ("h", "b", "4")], "src string, dst string, time string")
    features = spark.createDataFrame([(x, "1") for x in "abcdefgh"], "node_id string, f1 string")
    labels = spark.createDataFrame([("e", "3"), ("g", "4")], "node_id string, label string")
    for n, kept in ((6, "abcdeh"), (3, "abc"), (8, "abcdefgh"), (0, "abcdefgh")):
        g = tables.build(spark, edges, features, labels, snapshots=2, max_nodes=n)
        assert "".join(r[0] for r in g.index.orderBy("idx").collect()) == kept
        assert {r[0] for r in g.labels.where("label >= 0").collect()} == {"e", "g"} & set(kept) and g.attributes.count() == len(kept)
    assert tables.build(spark, edges, features, labels, snapshots=2, max_nodes=3).snapshots.select("u", "v").distinct().count() == 2
    lonely = spark.createDataFrame([("y", "z", "1"), ("a", "b", "1")], "src string, dst string, time string")
    with pytest.raises(ValueError, match="down-sampling"):
        tables.build(spark, lonely, None, None, max_nodes=1)


@pytest.mark.parametrize("bad", ["nan", "inf", "-Infinity", "abc", "", None, "1e30"])
def test_labels_must_be_finite(spark, bad):
    with pytest.raises(ValueError, match="node 'u1'"):
        tables.labels(spark.createDataFrame([("u1", bad), ("u1", "2"), (" ", "x")], "node_id string, label string"))


def test_labels_are_cut_toward_zero(spark):
    rows = [("a", "-0.5"), ("b", "2.9"), ("c", "-3.9"), ("d", " 7 "), ("e", "1"), ("e", "1e2"), ("", "x")]
    got = tables.labels(spark.createDataFrame(rows, "node_id string, label string")).collect()
    assert {r[0]: r[1] for r in got} == {"a": 0, "b": 2, "c": -3, "d": 7, "e": 100}


@pytest.mark.parametrize("bad", ["nan", "inf", "x"])
def test_vectors_must_be_finite(spark, tmp_path, bad):
    df = tables.read_csv(spark, put(tmp_path / "f.csv", f"node_id,f1,f2\nu1,{bad},1\n"))
    with pytest.raises(ValueError, match="f1 of node 'u1'"):
        tables.vectors(df)


def test_missing_files_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.resolve(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="dst"):
        tables.edges(tables.read_csv(spark, put(tmp_path / "e.csv", "src,x\na,b\n")))


def archive(path, records):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("part.json", "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def paper(i, year, refs, venue, **more):
    return {"id": i, "year": year, "references": refs, "venue": venue, "title": "graph study"} | more


def test_convert_archive(spark, tmp_path):
    archive(tmp_path / "a.zip", [paper("p1", 2020, ["p2"], "KDD"), paper("p2", "2019", [], " kdd "), paper("p3", 2021, ["p1"], "WWW"), "{broken", "", paper("big", 2020, [], "KDD", abstract="x" * 2000)])
    records = archives.read_records(spark, str(tmp_path / "*.zip"), max_bytes=500)
    out = convert(records, ConvertConfig(feature_dim=8, min_venue_support=2))
    assert out.counters["kept_papers"] == 2 and out.counters["supported_venues"] == 1
    assert [tuple(r) for r in out.edges.collect()] == [("p1", "p2", 2020)]
    assert all(len(r["features"]) == 8 for r in out.features.collect())
    everyone = convert(records, ConvertConfig(feature_dim=8, min_venue_support=2, keep_unlabeled=True))
    assert {r[0]: r[1] for r in everyone.labels.collect()} == {"p1": 0, "p2": 0, "p3": -1}
    with pytest.raises(ValueError, match="malformed"):
        archives.read_records(spark, str(tmp_path / "*.zip"), strict=True)


def test_dense_selection_links_more(spark, tmp_path):
    solo = [paper(f"a{i}", 2020, [], "V") for i in range(4)]
    ring = [paper(f"b{i}", 2020, [f"b{(i + 1) % 4}", f"b{(i + 2) % 4}"], "V") for i in range(4)]
    archive(tmp_path / "a.zip", solo + ring)
    records = archives.read_records(spark, str(tmp_path / "*.zip"))
    n = {s: convert(records, ConvertConfig(max_papers=4, candidate_multiplier=2, min_venue_support=1, feature_dim=4, strategy=s)) for s in ("dense", "legacy")}
    assert all(c.labels.count() == 4 for c in n.values())
    assert n["dense"].edges.count() > n["legacy"].edges.count()


def test_label_cleanup(spark):
    labels = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "node_id long, label long")
    kept = ev.clean_labels(labels([0, 0, 0, 1, 1, 1, 2, 3, -1]), "eval_only", 3)
    assert [r["label"] for r in kept.labels.orderBy("node_id").collect()] == [0, 0, 0, 1, 1, 1, -1, -1, -1]
    assert kept.counts["eval_dropped_labeled_nodes"] == 2 and kept.counts["eval_class_count"] == 2
    none = ev.clean_labels(labels([0, 0, 0, 1, 1, 2, -1]), "eval_only", 3)
    assert {r["label"] for r in none.labels.collect()} == {-1} and none.counts["eval_dropped_class_count"] == 3


def test_evaluate_separable(spark):
    points = [(i, [float(i % 3 == 0) + 0.01 * i, float(i % 3 == 1)], i % 3) for i in range(15)]
    emb = spark.createDataFrame([(i, v) for i, v, _ in points], "node_id long, vec array<double>")
    labels = spark.createDataFrame([(i, c) for i, _, c in points], "node_id long, label long")
    edges = spark.createDataFrame([(i, i + 3) for i in range(12)], "u long, v long")
    index = emb.selectExpr("node_id", "node_id as idx")
    out = ev.evaluate_snapshot(emb, labels, edges, index, 2, 1, ev.Protocol(classifier="centroid", repeats=2))
    assert out["f1_eval_successful_repeats"] == 2 and 0 <= out["link_auc"] <= 1


def test_sinks(spark, tmp_path):
    rows = [{"snapshot": i, "model": "m", "macro_f1": 0.5, "link_auc": 0.7} for i in range(3)]
    sinks.write_metrics(spark, str(tmp_path / "m.csv"), rows)
    assert sinks.read_metrics(spark, str(tmp_path / "m.csv")).count() == 3
    sinks.curves_svg(spark, str(tmp_path / "m.svg"), rows)
    with pytest.raises(FileExistsError):
        sinks.guard_outputs(spark, str(tmp_path), ["m.csv"], False)
    for _ in range(2):
        table = append_results(spark, str(tmp_path / "all.csv"), {"algo": "x", "num_nodes": 3})
    assert table.count() == 2 and table.columns == list(COLUMNS) and table.first()["model"] == "x"
    put(tmp_path / "old.csv", "algo,num_nodes,extra\ny,7,z\n")
    table = append_results(spark, str(tmp_path / "old.csv"), {"model": "x"})
    assert sorted((r["model"], r["nodes"]) for r in table.collect()) == [("x", ""), ("y", "7")] and list(COLUMNS) == table.columns


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(6.0).reshape(3, 2))
    np.savez(tmp_path / "c.npz", data=np.array([1, 2]), indices=np.array([1, 0]), indptr=np.array([0, 1, 2]))
    assert [r["vec"] for r in archives.npy_rows(spark, str(tmp_path / "x.npy"), first=2).collect()] == [[0, 1], [2, 3]]
    assert sorted(tuple(r) for r in archives.csr_entries(spark, str(tmp_path / "c.npz")).collect()) == [(0, 1, 1.0), (1, 0, 2.0)]


def test_stream(spark, tmp_path):
    from vireo.models.projection import ProjectionModel

    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "u string, v string")
    attrs = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [4.0])], "node_id string, vec array<double>")
    model = ProjectionModel(dim=2, steps=1, gate_steps=1).fit(edges, attrs)
    spark.createDataFrame([(1, "add", "a", "c", None, None, None), (1, "attr", None, None, "a", [3.0], None)], CHANGE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in"))
    stream_updates(stream, model, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/embedding")).count() == 3 and model.edges.count() == 3


def test_windowed_counts_and_percentile(spark, sf_dir):
    got = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type")
    assert got.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert percentile([1.0, 2.0, 4.0], 0.75) == 3.0


def test_windows_over_a_stream_are_those_of_the_table(spark, sf_dir, tmp_path):
    from vireo.streaming.replay import latest_windows, stream_windows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_windows(windowed_counts(stream, "ts", "event_type", late=None), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    versions = spark.read.parquet(str(tmp_path / "out"))
    assert versions.select("version").distinct().count() == 3
    got, want = latest_windows(versions, "event_type"), windowed_counts(events, "ts", "event_type")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    from vireo.streaming.replay import latest_windows, stream_windows

    schema = "ts timestamp, event_type string"
    for day in ("2024-01-10 00:30:00", "2024-01-11 00:30:00", "2024-01-02 00:30:00"):
        spark.sql(f"SELECT TIMESTAMP '{day}' AS ts, 'x' AS event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_windows(windowed_counts(stream, "ts", "event_type", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = latest_windows(spark.read.parquet(str(tmp_path / "out")), "event_type")
    assert sorted(r[0] for r in got.selectExpr("date_format(window.start, 'dd')").collect()) == ["10", "11"]


def test_dataset_command(spark, tmp_path):
    from vireo.plans import dataset

    archive(tmp_path / "a.zip", [paper("p1", 2020, ["p2", "px"], "KDD"), paper("p2", 2019, [], "KDD"), paper("p3", 2021, ["p1"], "WWW")])
    out = tmp_path / "out"
    args = ["--convert", "--input-glob", str(tmp_path / "*.zip"), "--output-dir", str(out), "--feature-dim", "8", "--min-venue-support", "2"]
    dry = dataset.main([*args, "--dry-run"])
    assert dry["kept_papers"] == 2 and "written_edges" not in dry and not out.exists()
    with pytest.raises(FileNotFoundError, match="edges.csv"):
        dataset.main(["--output-dir", str(out)])
    got = dataset.main([*args, "--include-attr-updates"])
    assert got["written_edges"] == 1 and got["written_features"] == 2 and got["unresolved_references"] == 1
    assert tables.read_csv(spark, str(out / "attr_updates.csv")).columns == ["time", "node_id"] + [f"f{j}" for j in range(1, 9)]
    with pytest.raises(FileExistsError, match="labels.csv"):
        dataset.main(args)
    dataset.main([*args, "--overwrite", "--keep-unlabeled"])
    assert not (out / "attr_updates.csv").exists()
    assert {r["node_id"]: r["label"] for r in tables.read_csv(spark, str(out / "labels.csv")).collect()} == {"p1": "0", "p2": "0", "p3": "-1"}
    assert dataset.main(["--output-dir", str(out)]) == {}
    g = tables.from_directory(spark, str(out), snapshots=2)
    assert g.index.count() == 3 and g.attributes.count() == 3


def test_tar_members_and_complete_stems(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name, text in (("t/1.feat", "a\r\nb\n"), ("t/1.edges", "a b"), ("t/2.feat", "c"), ("u/3.feat", "d"), ("u/3.edges", "e"), ("t/none", "f")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    rows = archives.tar_members(spark, str(tmp_path / "x.tar.gz"))
    assert sorted((r["line_no"], r["line"]) for r in rows.where("member = 't/1.feat'").collect()) == [(0, "a"), (1, "b")]
    assert [r[0] for r in archives.complete_stems(rows, ("feat", "edges"), "t/").collect()] == ["t/1"]


def test_gzip_lines_and_node_link(spark, tmp_path):
    with gzip.open(tmp_path / "x.json.gz", "wt", encoding="utf-8") as out:
        out.write("".join(f'{{"k": {i}}}\n' for i in range(5)))
    assert [tuple(r) for r in archives.gzip_json_lines(spark, str(tmp_path / "x.json.gz"), first=2).collect()] == [(0, '{"k": 0}'), (1, '{"k": 1}')]
    put(tmp_path / "g.json", '{"nodes": [], "links": [{"source": 1, "target": 2}]}')
    assert [tuple(r) for r in archives.node_link(spark, str(tmp_path / "g.json")).collect()] == [("1", "2")]


def test_run_options_are_checked(spark):
    from vireo.plans.run import RunConfig, checked, parser

    for bad in ({"classifier": "svm"}, {"dim": 0}, {"update_rate": -1.0}, {"eval_train_ratio": 1.0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            checked(RunConfig(**bad))
    with pytest.raises(SystemExit):
        parser().parse_args(["--snapshot-mode", "x"])


@pytest.fixture(scope="module")
def mount(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{folder}")
    return folder


@pytest.fixture
def store(mount, request):
    """(a folder under a path that only Hadoop's file systems can open, the same folder as a local path)."""
    local = mount / request.node.name
    local.mkdir()
    return f"viewfs://store/in/{local.name}", local


SMALL = {"dim": 4, "synthetic_nodes": 24, "synthetic_classes": 2, "synthetic_features": 4, "synthetic_rounds": 1, "eval_protocol": "single_random", "classifier": "centroid"}


def test_run_files(spark, store, monkeypatch):
    from vireo.plans.run import RunConfig, run

    store, local = store
    got = run(spark, RunConfig(output_dir=f"{store}/out", quantize=True, binary_quantize=True, **SMALL))
    out = local / "out"
    q, bits, x = (np.load(out / f"final_embedding{k}.npy") for k in ("_int8", "_binary", ""))
    scale = np.array([float(v) for v in (out / "final_embedding_int8_scale.csv").read_text().split()[1:]])
    assert q.dtype == bits.dtype == np.int8 and np.abs(q * scale - x).max() <= scale.max() / 2 + 1e-9 and ((x >= 0) == (bits > 0)).all()
    table = spark.read.parquet(f"{store}/out/final_embedding").orderBy("idx").collect()
    assert np.allclose([r["vec"] for r in table], x) and [r["idx"] for r in table] == list(range(24))
    assert got["num_snapshots"] == 2 and json.loads((out / "summary.json").read_text())["ablation_tag"] == "full"
    assert spark.read.option("header", True).csv(f"{store}/out/node_mapping.csv").count() == 24
    monkeypatch.setattr(sinks, "NPY_LIMIT", 10)
    run(spark, RunConfig(output_dir=f"{store}/out", **SMALL))
    assert not (out / "final_embedding.npy").exists() and spark.read.parquet(f"{store}/out/final_embedding").count() == 24
    assert spark.read.option("header", True).csv(f"{store}/out/all_results.csv").count() == 2


def test_file_run_from_a_store(spark, store):
    from vireo.plans.run import RunConfig, run

    store, tmp_path = store
    (tmp_path / "data").mkdir()
    put(tmp_path / "data/edges.csv", "src,dst,time\n" + "\n".join(f"u{i % 14:02d},u{(i * 5 + 1 + i // 30) % 14:02d},{i}" for i in range(60)))
    put(tmp_path / "data/features.csv", "node_id,f1,f2\n" + "\n".join(f"u{i:02d},{i},{i % 3}" for i in range(16)))
    put(tmp_path / "data/labels.csv", "node_id,label\n" + "\n".join(f"u{i:02d},{i % 2}" for i in range(16)))
    options = {"dim": 4, "snapshots": 2, "eval_protocol": "repeated_stratified", "eval_repeats": 2, "classifier": "centroid", "label_cleanup_mode": "eval_only", "min_class_support": 3}
    got = run(spark, RunConfig(mode="file", data_dir=f"{store}/data", output_dir=f"{store}/run", model="attention", hidden_dim=6, **options))
    assert (got["num_nodes"], got["feature_dim"], got["num_snapshots"], got["f1_eval_protocol_used"]) == (16, 2, 2, "repeated_stratified")
    assert got["final_labeled_nodes"] == 16 and got["final_eval_class_count"] == 2 and got["dataset"] == "file"
    metrics = sinks.read_metrics(spark, f"{store}/run/metrics_per_snapshot.csv").orderBy("snapshot").collect()
    assert [r["snapshot"] for r in metrics] == [0, 1] and metrics[0]["compute_update_latency_ms"] is None and metrics[1]["batch_events"] > 0


def test_matrix_of_runs(spark, tmp_path):
    from vireo.plans.run import RunConfig, main, matrix

    with pytest.raises(ValueError, match="whole"):
        matrix(spark, RunConfig(), rates=(0,))
    flags = [x for k, v in (SMALL | {"synthetic_rounds": 0}).items() for x in (f"--{k.replace('_', '-')}", str(v))]
    rows = main([*flags, "--model", "spectral", "--matrix-rates", "500", "900", "--output-dir", str(tmp_path)])
    assert [(r["stage"], r["update_rate"], r["ablation_tag"]) for r in rows] == [("rate", 500.0, "full"), ("rate", 900.0, "full"), ("ablation", 0.0, "full"), ("ablation", 0.0, "w/o-Inc")]
    sizes = {n: len((tmp_path / f"{n}_results.csv").read_text().splitlines()) - 1 for n in ("rate", "ablation", "combined")}
    assert sizes == {"rate": 2, "ablation": 2, "combined": 4} and (tmp_path / "ablation-1" / "summary.json").exists()
