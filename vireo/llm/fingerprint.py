"""Document fingerprints: a canonical exact digest.

A text is put in canonical form (NFKC, case folding, NFKC again, blanks folded
to single spaces), digested with the 128-bit xxh3 and grouped by digest. Inside
a digest held by more than one text form the canonical bytes are compared; if
they differ, the later forms (in byte order) get a numbered suffix, so that
equal fingerprints mean equal canonical texts, and the other way round.

Scale: digests are counted on narrow rows with map-side partial sums; only
members of repeated digests meet, each against its digest's smallest
canonical text (one row per digest, kept by partial minimum), so a group with
a third of all rows is a skewed inner join with one row on the other side, and
nothing is collected.

Defined results: null text reads as empty; empty and blank texts share one
fingerprint; rows that repeat share theirs; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.llm.common import cut, free_name, map_arrow, may_be_in
from vireo.llm.lines import document_key

DOCS_PER_RANGE = 512
MAX_RANGES = 1 << 16


def canonical(text: str | None) -> str:
    """NFKC, case folded, with runs of blanks as one space and none at the ends."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


def digest(form: str) -> bytes:
    """Wide xxhash of a canonical text."""
    return xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass"))


def add_digest(df: DataFrame, text_col: str, out: str, digest_fn=digest) -> DataFrame:
    """``df`` with the digest of the canonical form of ``text_col``."""
    names = df.columns

    def run(batch: pa.RecordBatch) -> dict:
        cols = {c: batch.column(c) for c in names}
        return cols | {out: pa.array([digest_fn(canonical(t)) for t in batch.column(text_col).to_pylist()], pa.binary())}

    return map_arrow(df, run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def _collisions(rows: DataFrame, docs: DataFrame, edits: bool, digest_fn=digest) -> DataFrame:
    """(key, next_key, kind, nth): texts whose digest belongs to a smaller, different form.

    ``rows`` has ``key``, ``next_key`` and the digests ``own`` (of the text)
    and, with ``edits``, ``edited``; ``docs`` has (``key``, ``text``). Only the
    members of repeated digests are read again. Per digest the least and the
    greatest canonical bytes are kept (partial minima in every task): they are
    equal unless the hash has failed, and only then are its texts told apart.
    """
    every = rows.select("key", "next_key", F.lit("own").alias("kind"), F.col("own").alias("digest"))
    if edits:
        every = every.unionByName(rows.select("key", "next_key", F.lit("edited").alias("kind"), F.col("edited").alias("digest")))
    repeated = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    held = cut(may_be_in(every, "digest", repeated).join(repeated, "digest").distinct())

    def own_forms(batch: pa.RecordBatch) -> dict:
        made = [canonical(t) for t in batch.column("text").to_pylist()]
        return {"key": batch.column("key"), "next_key": batch.column("key"), "kind": pa.array(["own"] * len(made)), "digest": pa.array([digest_fn(x) for x in made], pa.binary()), "form": pa.array([_bytes(x) for x in made], pa.binary())}

    def edited_forms(batch: pa.RecordBatch) -> dict:
        made = [canonical(edited_half(t, f)) for t, f in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)]
        return {"key": batch.column("key"), "next_key": batch.column("next_key"), "kind": pa.array(["edited"] * len(made)), "digest": batch.column("digest"), "form": pa.array([_bytes(x) for x in made], pa.binary())}

    shape = "key binary, next_key binary, kind string, digest binary, form binary"
    # What the bitmap lets through besides stands alone in its digest and changes nothing.
    forms = map_arrow(may_be_in(docs, "key", held.where("kind = 'own'").select("key")), own_forms, shape)
    if edits:
        pairs = held.where("kind = 'edited'")
        wanted = pairs.select("key").union(pairs.select("next_key")).distinct()
        texts = may_be_in(docs, "key", wanted).join(wanted, "key").distinct()
        after = texts.select(F.col("key").alias("next_key"), F.col("text").alias("following"))
        forms = forms.unionByName(map_arrow(pairs.join(texts, "key").join(after, "next_key"), edited_forms, shape))
    ends = forms.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("greatest"))
    failed = cut(ends.where("least <> greatest").select("digest", "least"))
    other = may_be_in(forms, "digest", failed.select("digest")).join(failed, "digest").where("form <> least")
    return other.select("key", "next_key", "kind", F.dense_rank().over(W.partitionBy("digest").orderBy("form")).alias("nth")).distinct()


def _bytes(form: str) -> bytes:
    return form.encode("utf-8", "surrogatepass")


def _named(digest_col: str, nth: str):
    """Digest as hex, with the number of its text form in a collision."""
    shown = F.lower(F.hex(digest_col))
    return F.when(F.col(nth).isNull(), shown).otherwise(F.concat_ws("-", shown, F.col(nth).cast("string")))


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", out: str = "fingerprint", digest_fn=digest) -> DataFrame:
    """``df`` with the fingerprint of every text in ``out``.

    The fingerprint is the digest or, in a collision, ``digest-nth``.
    """
    plain, key, nth, out = free_name(df, "digest"), free_name(df, "print_key"), free_name(df, "nth"), free_name(df, out)
    base = add_digest(df.withColumn(key, document_key(F.col(id_col), F.col(text_col))), text_col, plain, digest_fn)
    rows = base.select(F.col(key).alias("key"), F.col(key).alias("next_key"), F.col(plain).alias("own"))
    docs = df.select(document_key(F.col(id_col), F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    clash = _collisions(rows, docs, False, digest_fn).select(F.col("key").alias(key), F.col("nth").alias(nth)).distinct()
    return base.join(clash, key, "left").withColumn(out, _named(plain, nth)).select(*df.columns, out)


def next_by_id(df: DataFrame, id_col: str, carry: dict[str, str], ties: tuple[str, ...] = (), ids: DataFrame | None = None) -> DataFrame:
    """``df`` with columns of the next row in descending id order, the first row's after the last.

    ``carry`` maps new column names to the columns they bring over. Equal ids
    are ordered by ``ties``, null ids come last. No global sort: rows are dealt to
    ranges of ids, each range also gets the first row of the range below it
    (the lowest gets the very first row), and one window per range looks ahead.
    ``ids``, if given, is a cheaper plan of the same ids, to find the ranges by.
    """
    ids = (df if ids is None else ids).select(id_col)
    n, low = ids.agg(F.count(F.lit(1)), F.min(id_col)).first()
    if not n:
        return df.select("*", *[F.col(c).alias(new) for new, c in carry.items()])
    bucket, dest, guest = free_name(df, "id_range"), free_name(df, "id_dest"), free_name(df, "id_guest")
    ranges = max(1, min(MAX_RANGES, n // DOCS_PER_RANGE))
    ends: list[int] = []
    if low is not None and ranges > 1:
        ends = sorted(set(ids.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0]))
    # Range 0 is of null ids; range k holds ids in (ends[k-2], ends[k-1]].
    place = F.when(F.col(id_col).isNull(), F.lit(0))
    cell = f"{bucket}_cell"

    def deal(frame: DataFrame) -> DataFrame:
        if not ends:
            return frame.withColumn(bucket, place.otherwise(F.lit(1)))
        cells = Bucketizer(splits=[-float("inf"), *map(float, ends), float("inf")], inputCol=f"{cell}_id", outputCol=cell, handleInvalid="keep")
        put = cells.transform(frame.withColumn(f"{cell}_id", F.col(id_col).cast("double")))
        return put.withColumn(bucket, place.otherwise(F.col(cell).cast("int") + 1)).drop(cell, f"{cell}_id")

    dealt = deal(df)
    # The first row of each range that has rows: at most MAX_RANGES + 1 of them.
    tops = sorted(((r[0], r[1]) for r in deal(ids).groupBy(bucket).agg(F.max(id_col)).collect()), reverse=True)
    heads = [(tops[i][1], tops[i - 1][0] if i else tops[-1][0]) for i in range(len(tops))]
    at, to = free_name(df, "head_id"), free_name(df, "head_dest")
    heads = df.sparkSession.createDataFrame(heads, T.StructType([T.StructField(at, df.schema[id_col].dataType), T.StructField(to, T.IntegerType())]))
    dealt = dealt.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col(at)), "left")
    both = F.array(F.struct(F.col(bucket).alias("b"), F.lit(0).alias("g")), F.struct(F.col(to).alias("b"), F.lit(1).alias("g")))
    dealt = dealt.withColumn(dest, F.explode(F.when(F.col(to).isNull(), F.slice(both, 1, 1)).otherwise(both)))
    look = W.partitionBy(f"{dest}.b").orderBy(F.col(f"{dest}.g"), F.col(id_col).desc_nulls_last(), *ties)
    out = dealt.select(*df.columns, F.col(f"{dest}.g").alias(guest), *[F.lead(c).over(look).alias(new) for new, c in carry.items()])
    return out.where(F.col(guest) == 0).drop(guest)


def edited_half(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_probe(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest_fn=digest) -> DataFrame:
    """Fingerprints of all texts and of their edits (see ``edited_half``), with likenesses.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). The texts are shuffled once, by
    ranges of ids, each compressed by itself.
    """
    named = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", document_key(F.col("id"), F.col("text")))

    def pack(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=3)
        texts = batch.column("text").to_pylist()
        return {"id": batch.column("id"), "key": batch.column("key"), "own": pa.array([digest_fn(canonical(t)) for t in texts], pa.binary()), "text": pa.array([press.compress(t.encode()) for t in texts], pa.binary())}

    def probe(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdDecompressor()
        texts, after = ([press.decompress(t).decode() for t in batch.column(c).to_pylist()] for c in ("text", "following"))
        made = [edited_half(t, f) for t, f in zip(texts, after, strict=True)]
        return {c: batch.column(c) for c in ("id", "key", "next_key", "own", "next_own")} | {
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x.encode()).digest() for x in made], pa.binary()),
            "edited": pa.array([digest_fn(canonical(x)) for x in made], pa.binary()),
        }

    packed = map_arrow(named, pack, T.StructType([named.schema["id"], *T._parse_datatype_string("key binary, own binary, text binary").fields]))
    paired = next_by_id(packed, "id", {"following": "text", "next_own": "own", "next_key": "key"}, ("key",), named)
    schema = T.StructType([named.schema["id"], *T._parse_datatype_string("key binary, next_key binary, n_chars long, edited_sha256 binary, own binary, edited binary, next_own binary").fields])
    rows = cut(map_arrow(paired, probe, schema))
    clash = cut(_collisions(rows, named.select("key", "text"), True, digest_fn))
    own = clash.where("kind = 'own'").select("key", F.col("nth").alias("own_nth")).distinct()
    following = own.select(F.col("key").alias("next_key"), F.col("own_nth").alias("next_nth"))
    edited = clash.where("kind = 'edited'").select("key", "next_key", F.col("nth").alias("edited_nth"))
    joined = rows.join(own, "key", "left").join(following, "next_key", "left").join(edited, ["key", "next_key"], "left")
    printed = joined.select("id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), _named("own", "own_nth").alias("fingerprint"), _named("edited", "edited_nth").alias("edited_fingerprint"), _named("next_own", "next_nth").alias("next_fingerprint"))
    alike = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return printed.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "next_fingerprint").alias("near_next"),
    )
