"""Line dedup: drop lines that recur in many documents.

Normalised lines are exploded per document and hashed to 128 bits; a hash's
distinct documents are counted with map-side partial sums; the lines of hashes
at or over the threshold go; texts are put together again by line position.

Shuffles: the narrow (document key, line hash) pairs twice, and the texts once,
to meet their dropped hashes. A line that stands in a third of all documents
is one count per task in the first shuffle, and in the join an inner-join hot
key with one row on the other side, which AQE splits (or broadcasts, by its
measured size).

Defined results: null or empty text is one empty line and stays empty; an empty
table gives an empty table; rows that repeat count as documents of their own;
all other columns pass through, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.llm.common import cut, free_name, map_arrow

BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """ASCII blanks stripped at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def document_key(id_col, text_col):
    """A 128-bit key of (id, text); rows equal in both share it and their fate."""
    shown = F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(shown, F.lit("|"), F.coalesce(text_col, F.lit("")))))


def line_counts(df: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(line hash, documents): in how many rows each normalised line stands."""
    pairs = _pairs(df.select(F.lit(b"").alias("key"), F.col(text_col).alias("text")), min_chars)
    return pairs.groupBy("line").agg(F.count(F.lit(1)).alias("documents"))


def _pairs(keyed: DataFrame, min_chars: int) -> DataFrame:
    def explode(batch: pa.RecordBatch) -> dict:
        keys, lines = [], []
        texts = batch.column("text").to_pylist()
        for key, text in zip(batch.column("key").to_pylist(), texts, strict=True):
            if not text:
                continue
            own = {line_key(x) for x in text.encode().split(b"\n")}
            for x in own:
                if len(x) >= min_chars and (min_chars <= 1 or len(x.decode()) >= min_chars):
                    keys.append(key)
                    lines.append(xxhash.xxh3_128_digest(x))
        return {"key": pa.array(keys, pa.binary()), "line": pa.array(lines, pa.binary())}

    return map_arrow(keyed, explode, "key binary, line binary")


def dedup_lines(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_docs: int = 10,
    min_chars: int = 1,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``df`` with ``text_col`` rid of lines found in ``min_docs`` rows or more.

    Adds the line count before dropping and the number of dropped lines, under
    other names where ``df`` has such columns.
    """
    key, drop = free_name(df, "line_key"), free_name(df, "line_drop")
    lines_col, dropped_col = free_name(df, lines_col), free_name(df, dropped_col)
    names = list(df.columns)
    keyed = df.withColumn(key, document_key(F.col(id_col), F.col(text_col)))
    pairs = _pairs(keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text")), min_chars)
    # Cut, so that the join below has a shuffle of its own on either side and AQE can split a hot line.
    common = cut(line_counts(df, text_col, min_chars).where(F.col("documents") >= min_docs).select("line"))
    dropped = (
        pairs.join(common, "line")
        .groupBy(F.col("key").alias(key))
        .agg(F.collect_set("line").alias(drop))
    )
    joined = keyed.join(dropped, key, "left")
    at = names.index(text_col)
    schema = T.StructType(
        [*(f for f in df.schema.fields if f.name != text_col), T.StructField(text_col, T.StringType()), T.StructField(lines_col, T.LongType()), T.StructField(dropped_col, T.LongType())]
    )

    def rebuild(batch: pa.RecordBatch) -> dict:
        texts, n_lines, n_dropped = [], [], []
        for text, gone in zip(batch.column(text_col).to_pylist(), batch.column(drop).to_pylist(), strict=True):
            if not gone:
                texts.append(text or "")
                n_lines.append(1 + (text or "").count("\n"))
                n_dropped.append(0)
                continue
            gone = set(gone)
            lines = text.encode().split(b"\n")
            kept = [x for x in lines if not (k := line_key(x)) or xxhash.xxh3_128_digest(k) not in gone]
            texts.append(b"\n".join(kept).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        cols = {c: batch.column(c) for c in names if c != text_col}
        return cols | {text_col: pa.array(texts, pa.string()), lines_col: pa.array(n_lines, pa.int64()), dropped_col: pa.array(n_dropped, pa.int64())}

    order = [*names[:at], text_col, *names[at + 1 :], lines_col, dropped_col]
    return map_arrow(joined.select(*names, drop), rebuild, schema).select(*order)
