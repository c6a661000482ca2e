"""Whitening, byte-level BPE and Merkle manifests against NumPy, tiktoken and plain loops."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from vireo.llm import bpe, merkle, whitening
from vireo.llm.queries import QUERIES

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
VECTORS = "vec_id long, embedding array<float>, whitened string, deviation int"


# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


def planted(n=700, d=9, seed=3):
    gen = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(gen.normal(size=(d, d)))
    return [(i, v.tolist()) for i, v in enumerate((gen.normal(size=(n, d)) * 2.0 ** -np.arange(d) * 40) @ turn + gen.normal(size=d) * 900)]


def expected(rows, d, k):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = (x - s // n).astype(float) - np.array([(t % n) / n for t in s])
    values, directions = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)
    values, directions = values[order], directions[:, order]
    return [int(((n * r - s) ** 2).sum()) for r in x], (y @ directions[:, :k]) / np.sqrt(values[:k]), values


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_equals_numpy(spark, parts):
    rows = planted()
    got = whitening.whiten(vectors(spark, rows).repartition(parts, "vec_id"), components=8)
    assert got.columns[4:] == ["whitened_1", "deviation_1"]
    ours = {r["vec_id"]: r for r in got.collect()}
    deviation, white, _ = expected(rows, 9, 8)
    w = np.array([ours[i]["whitened_1"] for i, _ in rows])
    assert [ours[i]["deviation_1"] for i, _ in rows] == deviation
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-7
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9


def test_whitening_model(spark):
    rows = planted()
    model = whitening.fit(vectors(spark, rows), components=20)
    _, _, values = expected(rows, 9, 9)
    assert model.n == 700 and model.taken == 9 and model.identity_error < 1e-9
    assert np.allclose(model.deviations**2, values, rtol=1e-9) and np.allclose(model.explained, values / values.sum())
    assert np.allclose(model.components.T @ model.components, np.eye(9), atol=1e-13)
    table = whitening.components_table(vectors(spark, rows), model).collect()
    assert [r["component"] for r in table] == list(range(1, 10)) and len(table[0]["direction"]) == 9


def test_whitening_drops_what_does_not_count(spark):
    good = planted(60, 3)
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 1.0]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0]), (None, good[0][1])]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    assert sorted(r["vec_id"] for r in got if r["vec_id"] is not None) == [i for i, _ in good] and len(got) == 61
    model = whitening.fit(vectors(spark, good + bad))
    assert model.n == 61


def test_whitening_without_spread_or_rows(spark):
    assert whitening.fit(vectors(spark, [])) is None
    assert whitening.whiten(vectors(spark, [(1, None)])).columns == ["vec_id", "embedding", "whitened", "deviation", "whitened_1", "deviation_1"]
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    same = whitening.whiten(vectors(spark, [(i, [1.5, -2.0]) for i in range(5)])).collect()
    assert all(r["whitened_1"] == [0.0, 0.0] and r["deviation_1"] == 0 for r in same)
    line = vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])  # one direction with spread
    model = whitening.fit(line)
    assert model.identity_error < 1e-9 and abs(model.explained[0] - 1) < 1e-12
    assert all(r["whitened_1"][1:] == [0.0, 0.0] for r in whitening.whiten(line, model=model).collect())


def test_deviation_beyond_64_bits_is_exact_or_null(spark):
    model = whitening.Whitening(4, [0, 4], np.eye(2), np.ones(2), 2)
    x = np.array([[2**40, 1], [3, -7]], dtype=np.int64)
    assert model.squared_deviation(x) == [(4 * 2**40) ** 2, 144 + 32**2]
    far = whitening.whiten(vectors(spark, [(1, [2.0**36]), (2, [-(2.0**36)])])).collect()
    assert [r["deviation_1"] for r in far] == [None, None]


def test_jacobi_keeps_small_lengths():
    gen = np.random.default_rng(1)
    for d in (1, 2, 7, 32):
        lengths = 10.0 ** -np.linspace(0, 6, d)
        left, right = np.linalg.qr(gen.normal(size=(d + 5, d)))[0], np.linalg.qr(gen.normal(size=(d, d)))[0]
        got, turn = whitening.one_sided_jacobi(np.linalg.qr(left @ np.diag(lengths) @ right, mode="r"))
        assert np.allclose(got, lengths, rtol=1e-8) and np.allclose(turn.T @ turn, np.eye(d), atol=1e-13)


def test_whitening_query(spark, sf_dir):
    got = QUERIES["op11_embedding_whitening"](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert got.count() == 8 * n and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    row = got.agg(F.max("identity_error"), F.min("component"), F.max("component"), F.min("n")).first()
    assert row[0] < 1e-9 and tuple(row)[1:] == (1, 8, n)


# --- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue_gives_least_rank_then_least_place():
    rng = random.Random(2)
    queue, plain = bpe.RankQueue(60000), []
    for _ in range(5000):
        if plain and rng.random() < 0.45:
            want = min(plain)
            plain.remove(want)
            assert queue.pop() == want
        else:
            e = (rng.choice([rng.randrange(60000), rng.randrange(5)]), rng.randrange(1000))
            plain.append(e)
            queue.push(*e)
    while plain:
        want = min(plain)
        plain.remove(want)
        assert queue.pop() == want
    assert queue.pop() is None and not queue.buckets and not any(queue.low)


def test_bpe_equals_library(ranks, library):
    encoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(5)
    for alphabet in ("ab", "aeiou ", "the ing'", "日本é ß\n\t😀", "0123 ,.-_=", "".join(map(chr, range(1, 400)))):
        for n in (0, 1, 2, 7, 60, 700):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert list(encoder.encode(text)) == library.encode_ordinary(text), text
    for text in ("a" * 70001, "=-" * 40000, "".join(rng.choice("quickbrown") for _ in range(90000)), "<|endoftext|>"):
        assert list(encoder.encode(text)) == library.encode_ordinary(text)
    assert not encoder.queue.buckets and not any(encoder.queue.low)


def test_bpe_remembers_a_bounded_number(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = "qzx vbnq wqrt plmk qzx vbnq jjkq qzx qzx vbnq"
    assert list(encoder.encode(text)) == library.encode_ordinary(text)
    assert len(encoder.memo) - len(encoder.memo.words) <= 3 and len(encoder.memo.old) - len(encoder.memo.words) <= 3


def test_bpe_table_round_trip(spark, ranks, library, monkeypatch):
    texts = [None, "", " \t\n", "word", "word", "é É ß ﬁ\x00", "tick tock " * 20000, "x" * 30000, "last"]
    rows = [(i if i != 4 else None, "s", None, 0, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("token_ids", F.lit("taken")).withColumn("decoded", F.lit("taken")).coalesce(1)
    monkeypatch.setattr(bpe, "OUT", 50)
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    assert ids.columns[-1] == "token_ids_1" and ids.columns[:5] == docs.columns[:5]
    out = bpe.decode(ids, ranks, "token_ids_1").collect()
    assert len(out) == len(texts)
    for r in out:
        assert r["token_ids_1"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded_1"]).decode() == (r["text"] or "")
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "k int, token_ids array<int>").coalesce(1)
    assert [bytes(r["decoded"]) for r in bpe.decode(odd, ranks).collect()] == [b"", b"", b"ab"]
    with pytest.raises(Exception, match="no word"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "k int, token_ids array<int>"), ranks).collect()


def test_bpe_needs_all_bytes(ranks):
    with pytest.raises(ValueError, match="single byte"):
        bpe.Encoder({b"a": 0}, public_tokenizers.PATTERN)


def test_bpe_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op12_bpe_codes"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """(root, for each leaf its (left, right) siblings level by level)."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, wide = [], []
        for k in range(0, len(nodes), 8):
            run, span = nodes[k : k + 8], []
            for j in range(len(run)):
                for leaf in spans[k + j]:
                    paths[leaf].append((run[:j], run[j + 1 :]))
                    span.append(leaf)
            up.append(h(*run))
            wide.append(span)
        nodes, spans = up, wide
    return nodes[0], paths


def plain_manifest(rows):
    """Rows of the query by plain loops."""
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        head = [framed(v) for v in (doc_id, source, lang, n_chars)]
        leaf = changed = h(*head, framed(text))
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            changed = h(*head, framed("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    out, keys = [], sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g])]) for g in keys]
    root, crown = plain_tree([t[0] for t in trees])
    for g, (subroot, paths), rest in zip(keys, trees, crown, strict=True):
        for x, path in zip(sorted(groups[g]), paths, strict=True):
            digest = x[3]
            for left, right in path + rest:
                digest = h(*left, digest, *right)
            out.append((x[4], x[2], subroot, root, h(*[d for a, b in path + rest for d in a + b]), digest, digest == root))
    return sorted(map(str, out))


def check_manifest(spark, tmp_path, rows, parts):
    spark.createDataFrame(rows, DOCS).repartition(parts).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit("x")).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.collect()) == (plain_manifest(rows) if rows else [])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8}, {"b": 9}, {"a": 64, "b": 65, None: 1}, {"a": 530, "B": 1, "é": 7, "": 3, None: 72}])
def test_merkle_equals_plain_trees(spark, tmp_path, sizes):
    rng = random.Random(str(sizes))
    rows = [(rng.randrange(-50, 10**6), rng.choice([None, "s", "é"]), lang, rng.choice([None, 7]), rng.choice([None, "", "Ab É", "ab", "X" * 5000])) for lang, n in sizes.items() for _ in range(n)]
    check_manifest(spark, tmp_path, rows, 5)


def test_merkle_awkward_rows(spark, tmp_path):
    check_manifest(spark, tmp_path, [], 1)
    same = [(5, "s", "en", 3, "Same")] * 75 + [(None, None, None, None, None)] * 20 + [(None, "s", "en", 1, f"T{i}") for i in range(11)] + [(5, "s", "en", 3, "other"), (6, "s", "en", 9, "Long " * 200000)]
    check_manifest(spark, tmp_path, same, 7)
    check_manifest(spark, tmp_path, [(i, "s", f"g{i % 77}", 1, "t") for i in range(100)], 3)  # many groups: a tree of roots of three levels


def test_merkle_store_and_proofs(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s", "en" if i % 3 else None, i, f"t{i}") for i in range(300)], DOCS)
    manifest = merkle.build(rows, "lang", "doc_id", ["doc_id", "text"], folder=str(tmp_path / "store"))
    assert [x.count() for x in manifest.levels] == [13 + 25, 2 + 4, 2]
    assert spark.read.parquet(str(tmp_path / "store" / "level=1")).count() == 38
    proofs = manifest.proofs().withColumn("again", merkle.fold(F.lower(F.hex("leaf"))))
    assert proofs.where(F.col("again") != manifest.root).count() == 0 and proofs.count() == 300
    steps = proofs.where("key = 299").first()["path"]
    assert [s["at"] for s in steps] == [199 % 8, 199 // 8 % 8, 199 // 64, 1]
    again = merkle.build(rows.repartition(7), "lang", "doc_id", ["doc_id", "text"])
    assert again.root == manifest.root
    other = merkle.build(rows.withColumn("text", F.when(F.col("doc_id") == 7, "t").otherwise(F.col("text"))), "lang", "doc_id", ["doc_id", "text"])
    assert other.root != manifest.root
