"""From files to dataset folders by one command, against plain loops."""

import gzip
import io
import json
import math
import random
import tarfile

import numpy as np
import pytest

from vireo.plans import dataset
from vireo.sources import tables


def made(spark, tmp_path, kind, inputs, *more):
    out = tmp_path / "out"
    counts = dataset.main(["--build", kind, "--output-dir", str(out), *more, *[x for k, v in inputs.items() for x in ("--input", f"{k}={v}")]])
    read = lambda n: [r.asDict() for r in tables.read_csv(spark, str(out / f"{n}.csv")).collect()]
    vec = lambda r: [float(r[f"f{j + 1}"]) for j in range(sum(k.startswith("f") for k in r))]
    return counts, read("edges"), {r["node_id"]: vec(r) for r in read("features")}, {r["node_id"]: int(r["label"]) for r in read("labels")}, out


def test_social(spark, tmp_path):
    rng = random.Random(1)
    ids = {f"t{i:02d}": (i * 7) % 20 for i in range(20)}
    links = [{"source": rng.randrange(20), "target": rng.randrange(20)} for _ in range(60)]
    x = np.arange(60.0).reshape(20, 3)
    (tmp_path / "ids.json").write_text(json.dumps(ids))
    (tmp_path / "classes.json").write_text(json.dumps({n: ([0, 1, 1] if i % 2 else 4) for n, i in ids.items() if i != 3}))
    (tmp_path / "g.json").write_text(json.dumps({"links": links}))
    np.save(tmp_path / "x.npy", x)
    inputs = {"ids": tmp_path / "ids.json", "classes": tmp_path / "classes.json", "links": tmp_path / "g.json", "features": tmp_path / "x.npy"}
    counts, edges, features, labels, out = made(spark, tmp_path, "social", inputs, "--max-nodes", "12")
    name = {i: n for n, i in ids.items() if i < 12}
    want = {tuple(sorted((name[k["source"]], name[k["target"]]))) for k in links if k["source"] in name and k["target"] in name and k["source"] != k["target"]}
    assert {(e["src"], e["dst"]) for e in edges} == want and len(edges) == len(want)
    assert all(1_710_000_000 <= int(e["time"]) < 1_715_000_000 for e in edges)
    assert features == {n: x[i].tolist() for i, n in name.items()} and labels == {n: (1 if i % 2 else 4) for i, n in name.items() if i != 3}
    updates = tables.read_csv(spark, str(out / "attr_updates.csv")).collect()
    assert counts["written_updates"] == len(updates) == 3000 and {r["node_id"] for r in updates} == set(labels)
    assert abs(np.std([float(r["f1"]) - x[ids[r["node_id"]], 0] for r in updates]) - 0.03) < 0.002
    assert tables.from_directory(spark, str(out), snapshots=2).index.count() == 12


def csr(rows, width):
    return {"indices": np.array([j for r in rows for j in r]), "indptr": np.cumsum([0, *map(len, rows)]), "shape": np.array([len(rows), width])}


@pytest.mark.parametrize("most", [1000, 7])
def test_products(spark, tmp_path, most):
    rng = random.Random(2)
    rows = [[rng.randrange(30) for _ in range(rng.choice([0, 1, 4]))] for _ in range(30)]
    np.savez(tmp_path / "a.npz", **csr(rows, 30))
    np.save(tmp_path / "x.npy", np.arange(50.0).reshape(25, 2))
    np.save(tmp_path / "y.npy", np.eye(28)[:, :5] + 0.1)
    _, edges, features, labels, _ = made(spark, tmp_path, "products", {"adjacency": tmp_path / "a.npz", "features": tmp_path / "x.npy", "classes": tmp_path / "y.npy"}, "--max-edges", str(most))
    want = []
    for i in range(25):
        for j in rows[i]:
            e = tuple(sorted((i, j)))
            if j < 25 and i != j and e not in want and len(want) < most:
                want.append(e)
    assert sorted((int(e["src"][1:]), int(e["dst"][1:])) for e in edges) == sorted(want)
    assert features == {f"a{i}": [2.0 * i, 2.0 * i + 1] for i in range(25)} and labels == {f"a{i}": i if i < 5 else 0 for i in range(25)}


def test_citations(spark, tmp_path):
    rows = [[3, 1], [], [0], [9, 2]]
    attributes = [[0, 5], [], [5], [5, 7]]
    parts = {f"adj_matrix.{k}": v for k, v in csr(rows, 10).items()} | {f"attr_matrix.{k}": v for k, v in csr(attributes, 8).items()}
    np.savez(tmp_path / "c.npz", labels=np.array([4, 5, 6, 7]), **parts, **{"attr_matrix.data": np.full(5, 2.0)})
    _, edges, features, labels, _ = made(spark, tmp_path, "citations", {"matrix": tmp_path / "c.npz"})
    assert labels == {"m0": 4, "m1": 7, "m2": 5, "m3": 6}  # met as 0, its neighbours 3 and 1, then 2
    assert sorted((e["src"], e["dst"]) for e in edges) == [("m0", "m1"), ("m0", "m2"), ("m0", "m3"), ("m1", "m3")]
    assert features == {"m0": [2.0, 2.0, 0.0], "m1": [2.0, 0.0, 2.0], "m2": [0.0, 0.0, 0.0], "m3": [2.0, 0.0, 0.0]}  # columns 5, 0, 7


def test_egos(spark, tmp_path):
    files = {
        "n/1.featnames": "0 #red\n1 blue sky\n", "n/1.egofeat": "1 0\n", "n/1.feat": "7 0 1\n8 1 1\n9 1\n5 0 0\n", "n/1.circles": "c0 8 99\nc1 7 8\n", "n/1.edges": "7 8\n7 99\n8 8\n",
        "n/2.featnames": "0 #red\n", "n/2.egofeat": "1\n", "n/2.feat": "8 1\n3 0\n", "n/2.circles": "cx\t3\t8\n", "n/2.edges": "3 8\n",
        "n/3.feat": "4 1\n", "m/4.featnames": "0 a\n",
    }
    with tarfile.open(tmp_path / "e.tar.gz", "w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    _, edges, features, labels, _ = made(spark, tmp_path, "egos", {"archive": tmp_path / "e.tar.gz"})
    assert {(e["src"], e["dst"]) for e in edges} == {("1", "7"), ("1", "8"), ("1", "5"), ("7", "8"), ("2", "8"), ("2", "3"), ("3", "8")}
    assert features == {"1": [1.0, 0.0], "7": [0.0, 1.0], "8": [1.0, 1.0], "5": [0.0, 0.0], "2": [1.0, 0.0], "3": [0.0, 0.0]}
    assert labels == {"8": 0, "7": 1, "3": 2}  # 1:c0, 1:c1, 2:cx
    few = made(spark, tmp_path, "egos", {"archive": tmp_path / "e.tar.gz"}, "--max-nodes", "3", "--overwrite")
    assert set(few[2]) == {"1", "7", "8"} and {(e["src"], e["dst"]) for e in few[1]} == {("1", "7"), ("1", "8"), ("7", "8")}


def test_product_text(spark, tmp_path):
    rows = [{"uid": "A", "title": "Red shoe", "content": "a b c", "target_ind": [4, 9], "target_rel": [0.2, 0.9]}, {"uid": "B", "title": "x", "content": "", "target_ind": [9, 2], "target_rel": [0.5]},
            {"uid": "C", "title": "", "content": "q", "target_ind": [1]}, {"uid": "D", "title": "t", "content": "u", "target_ind": [2, 4], "target_rel": [0.7, 0.7]}]
    with gzip.open(tmp_path / "p.json.gz", "wt") as out:
        out.write("\n".join(map(json.dumps, rows)))
    _, edges, features, labels, _ = made(spark, tmp_path, "product-text", {"records": tmp_path / "p.json.gz"})
    assert {(e["src"], e["dst"]) for e in edges} == {("A", "B"), ("A", "D"), ("B", "D")} and labels == {"A": 1, "B": 1, "D": 0}
    assert features["A"][:8] == pytest.approx([2, 3, 5, 2, 2, math.log1p(2), 0.55, 0.9]) and sum(features["A"][8:]) == 5 and len(features["B"]) == 24
    assert made(spark, tmp_path, "product-text", {"records": tmp_path / "p.json.gz"}, "--max-nodes", "2", "--overwrite")[0]["written_features"] == 2


def test_build_checks_its_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="adjacency"):
        dataset.build_dataset(spark, "products", {"x": "y"}, str(tmp_path))
