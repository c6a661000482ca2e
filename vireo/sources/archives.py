"""Archives and array files as tables."""

from __future__ import annotations

import io
import tarfile
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.runtime import cut

RECORD = "id string, title string, abstract string, keywords string, year string, references string, venue string"


def _files(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content")


#: Stores that tasks reach without Spark: local paths and those of pyarrow's file systems. Others come through binary cells, of 2 GB at most.
REACHED = ("file", "hdfs", "s3", "gs", "abfs")


def _open(path: str, content=None):
    """A file to seek in, from its content if that came along."""
    if content is not None:
        return io.BytesIO(content)
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow.fs import FileSystem

    store, where = FileSystem.from_uri(path)
    return store.open_input_file(where)


def _listed(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content): content is null where tasks open the path themselves."""
    found = spark.read.format("binaryFile").load(glob)
    paths = found.select("path")  # no content is read for this
    others = paths.where(~F.split("path", ":")[0].isin(*REACHED)).limit(1).collect()
    return found.select("path", "content") if others else paths.withColumn("content", F.lit(None).cast("binary"))


def zip_members(spark: SparkSession, glob: str) -> DataFrame:
    """(file, number, member, bytes, content) of all .json members, from the central directories; numbers are their places there.

    An archive without one is an error.
    """

    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                with _open(path, content) as held, zipfile.ZipFile(held) as z:
                    found = [(path, k, m.filename, m.compress_size, content) for k, m in enumerate(z.infolist()) if m.filename.lower().endswith(".json")]
                if not found:
                    raise ValueError(f"{path} has no .json member")
                yield pd.DataFrame(found, columns=["file", "number", "member", "bytes", "content"])

    paths = _listed(spark, glob)
    return paths.mapInPandas(run, "file string, number long, member string, bytes long, content binary")


def _lines(held, most: int):
    """(number, line) of the lines of at most ``most`` bytes with their end (0: any); longer ones are passed over in pieces."""
    no, limit = 0, most + 1 if most > 0 else -1
    while piece := held.readline(limit):
        whole = piece
        while limit > 0 and len(piece) == limit and not piece.endswith(b"\n"):
            whole = None
            piece = held.readline(limit)
        if whole is not None and (most <= 0 or len(whole) <= most):
            yield no, whole
        no += 1


def member_lines(members: DataFrame, max_bytes: int = 4_000_000) -> DataFrame:
    """(file, number, member, line_no, raw) of members as ``zip_members`` gives them; blank and overlong lines are left out.

    A task takes one member at a time, which it finds by its offset and streams, so an archive of any size is shared by as many
    tasks as it has members, and none holds more than a lot of lines. Bytes that aren't UTF-8 give a null.
    """
    columns = ["file", "number", "member", "line_no", "raw"]

    def run(frames):
        for f in frames:
            for path, number, name, content in zip(f["file"], f["number"], f["member"], f["content"], strict=True):
                rows, size = [], 0
                with _open(path, content) as held, zipfile.ZipFile(held) as z, z.open(z.infolist()[number]) as lines:
                    for no, line in _lines(lines, max_bytes):
                        if not line.strip():
                            continue
                        try:
                            rows.append((path, number, name, no, line.decode("utf-8").strip()))
                        except UnicodeDecodeError:
                            rows.append((path, number, name, no, None))
                        size += len(line)
                        if len(rows) >= 5000 or size >= 1 << 25:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    tasks = max(1, members.count())
    dealt = members.repartitionByRange(tasks, "file", "number")
    return dealt.mapInPandas(run, "file string, number long, member string, line_no long, raw string")


def zip_lines(spark: SparkSession, glob: str, max_bytes: int = 4_000_000) -> DataFrame:
    """``member_lines`` of all archives."""
    return member_lines(zip_members(spark, glob), max_bytes)


def json_records(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Records with ``seq`` in scan order; lines that are no JSON object are dropped, or an error if ``strict``."""
    kinds = F.from_json("raw", "map<string,string>", {"mode": "PERMISSIVE"})
    seq = F.struct("file", "number", "line_no")
    rows = lines.select(seq.alias("seq"), "raw", kinds.alias("m"))
    if strict:
        bad = rows.where("m is null").limit(1).collect()
        if bad:
            raise ValueError(f"malformed record at {bad[0]['seq']}")
    m = F.col("m")
    words = lambda k: F.coalesce(F.from_json(m[k], "array<string>"), F.when(m[k].isNotNull(), F.array(m[k])), F.array().cast("array<string>"))
    return rows.where("m is not null").select("seq", *[m[k].alias(k) for k in ("id", "title", "abstract", "year", "venue")], words("keywords").alias("keywords"), F.coalesce(F.from_json(m["references"], "array<string>"), F.array().cast("array<string>")).alias("references"))


def read_records(spark: SparkSession, glob: str, max_bytes: int = 4_000_000, strict: bool = False) -> DataFrame:
    return json_records(zip_lines(spark, glob, max_bytes), strict)


def read_until(spark: SparkSession, glob: str, enough, max_bytes: int = 4_000_000, strict: bool = False, first: int = 0) -> DataFrame:
    """Records of the first archive members, in scan order, up to a member at which ``enough(records)`` holds; members behind that stay closed.

    Members are opened in lots, ``first`` to begin with (0: as many as tasks run at once), then twice as many as before. What has been read is kept in the checkpoint folder.
    """
    members = cut(zip_members(spark, glob))
    ranked = members.select("file", "number").orderBy("file", "number").collect()  # a name and a number each
    lot, at, done = first or spark.sparkContext.defaultParallelism, 0, None
    while at < len(ranked):
        low, high = ranked[at], ranked[min(at + lot, len(ranked)) - 1]
        key = F.struct("file", "number")
        bound = lambda r: F.struct(F.lit(r["file"]).alias("file"), F.lit(r["number"]).alias("number"))
        got = cut(json_records(member_lines(members.where((key >= bound(low)) & (key <= bound(high))), max_bytes), strict))
        done = got if done is None else done.unionByName(got)
        at, lot = at + lot, 2 * lot
        if enough(done):
            break
    return done


def npy_rows(spark: SparkSession, path: str, key: str | None = None, first: int = 0) -> DataFrame:
    """(row, vec) of a 2-d .npy array, or of array ``key`` of an .npz; ``first`` rows only if positive."""

    def run(frames):
        for f in frames:
            for where, content in zip(f["path"], f["content"], strict=True):
                with _open(where, content) as held:
                    data = np.load(held, allow_pickle=False)
                    array = data[key] if key else data
                    array = array[:first] if first else array
                    array = array.reshape(len(array), -1)
                    for at in range(0, len(array), 4096):
                        part = array[at : at + 4096].astype(float)
                        yield pd.DataFrame({"row": np.arange(at, at + len(part)), "vec": list(part)})

    return _listed(spark, path).mapInPandas(run, "row long, vec array<double>")


def csr_slots(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(row, slot, col, value) of a CSR matrix in an .npz with data, indices and indptr; slots are places in a row. Without data all values are 1."""
    columns = "row long, slot long, col long, value double"

    def run(frames):
        for f in frames:
            for where, content in zip(f["path"], f["content"], strict=True):
                with _open(where, content) as held:
                    z = np.load(held, allow_pickle=False)
                    indices, indptr = (z[f"{prefix}{k}"] for k in ("indices", "indptr"))
                    data = z[f"{prefix}data"] if f"{prefix}data" in z.files else np.ones(len(indices))
                    for at in range(0, len(indices), 1 << 18):
                        place = np.arange(at, min(at + (1 << 18), len(indices)))
                        row = np.searchsorted(indptr, place, side="right") - 1
                        yield pd.DataFrame({"row": row, "slot": place - indptr[row], "col": indices[place], "value": data[place].astype(float)})

    return _listed(spark, path).mapInPandas(run, columns)


def csr_entries(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(row, col, value) of a CSR matrix in an .npz."""
    return csr_slots(spark, path, prefix).select("row", "col", "value")


def csr_rows(spark: SparkSession, path: str, prefix: str = "") -> int:
    """How many rows a CSR matrix in an .npz has."""

    def run(frames):
        for f in frames:
            for where, content in zip(f["path"], f["content"], strict=True):
                with _open(where, content) as held:
                    yield pd.DataFrame({"n": [len(np.load(held, allow_pickle=False)[f"{prefix}indptr"]) - 1]})

    return _listed(spark, path).mapInPandas(run, "n long").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def node_link(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a node-link JSON graph."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("links").alias("l")).select(F.col("l.source").cast("string").alias("src"), F.col("l.target").cast("string").alias("dst"))


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(member, line_no, line) of the text members of a .tar.gz, which one task streams from front to end."""
    columns = ["member", "line_no", "line"]

    def run(frames):
        for f in frames:
            for where, content in zip(f["path"], f["content"], strict=True):
                with _open(where, content) as held, tarfile.open(fileobj=held, mode="r|gz") as tar:
                    for m in tar:
                        if not m.isfile():
                            continue
                        rows = []
                        for no, line in enumerate(tar.extractfile(m)):
                            rows.append((m.name, no, line.decode("utf-8", "replace").rstrip("\r\n")))
                            if len(rows) >= 5000:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                        yield pd.DataFrame(rows, columns=columns)

    return _listed(spark, path).mapInPandas(run, "member string, line_no long, line string")


def complete_stems(members: DataFrame, needed: tuple[str, ...], folder: str = "") -> DataFrame:
    """(stem): names below ``folder`` of which there is a member with each ending in ``needed``.

    What a member has no line of is no row of ``members``, so an empty member counts as absent.
    """
    shape = r"^(.*)\.([^./]*)$"
    named = members.where(F.col("member").startswith(folder) & F.col("member").rlike(shape)).select("member").distinct()
    stem, ending = (F.regexp_extract("member", shape, k) for k in (1, 2))
    ends = named.groupBy(stem.alias("stem")).agg(F.collect_set(ending).alias("ends"))
    return ends.where(F.size(F.array_except(F.array(*[F.lit(x) for x in needed]), "ends")) == 0).select("stem")


def gzip_json_lines(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(line_no, raw) of one gzipped JSON-lines file, which is one split, so its rows are numbered from 0."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))
    return lines.where(F.col("line_no") < first) if first else lines
