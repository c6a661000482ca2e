"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm import bpe, decontam, fingerprint, langid, licenses, lines, lm, merkle, mixing, neardup, passages, urlrules, whitening
from vireo.llm.common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = urlrules.page_labels(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return urlrules.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.with_class(documents(spark, sf_dir).select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    profiles = langid.train(docs.where(~F.col("held_out")), "text", "lang")
    return langid.predict(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir).select("doc_id", "text"), held_out=langid.held_out(F.col("doc_id"), 7, 2))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.spans(passages.repeats(documents(spark, sf_dir).select("doc_id", "text")))
    words = lambda p: p["end"] - p["start"]
    add = lambda a, p: a + words(p)
    return found.select(
        "doc_id",
        F.size("passages").alias("n_passages"),
        F.aggregate("passages", F.lit(0), add).alias("repeated_words"),
        F.aggregate(F.filter("passages", lambda p: p["removed"]), F.lit(0), add).alias("removed_words"),
        F.array_distinct(F.flatten(F.transform("passages", lambda p: p["passage_ids"]))).alias("passage_ids"),
        F.transform("passages", lambda p: p["start"]).alias("starts"),
        F.transform("passages", lambda p: p["end"]).alias("ends"),
        F.transform("passages", lambda p: p["removed"]).alias("removed"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_probe(documents(spark, sf_dir).select("doc_id", "text"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(vectors, "embedding", 8)
    rows = whitening.whiten(vectors, "embedding", 8, model)
    explained = model.explained.tolist() if model else []
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("nth", "value"))
    return long.select(
        "vec_id",
        (F.col("nth") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.element_at(F.array(*[F.lit(x) for x in explained[:8] or [0.0]]), F.col("nth") + 1).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def op12_bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    both = bpe.decode(ids, ranks)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    changed = F.when(tampered, merkle.row_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], lowered))
    manifest = merkle.build(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], carry={"changed": F.unhex(changed)})
    root = F.lit(manifest.root).cast("string")
    leaf = F.lower(F.hex("leaf"))
    folded = merkle.fold(F.coalesce(F.lower(F.hex("changed")), leaf))
    out = manifest.proofs().select(F.col("key").alias("doc_id"), leaf.alias("leaf"), "subroot", root.alias("root"), merkle.digest(merkle.siblings()).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_url_rules": op2_url_rules,
    "op3_source_mixing": op3_source_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_language_id": op6_language_id,
    "op7_lm_scores": op7_lm_scores,
    "op8_line_dedup": op8_line_dedup,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_fingerprints": op10_fingerprints,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_bpe_codes": op12_bpe_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {
    "op3_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17|' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents
), per AS (
  SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY src NULLS LAST) AS nth FROM per
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((nth - 1) % 3 + 1)::INT] AS weight, (3 * source_size)::DOUBLE AS most FROM numbered
), stops AS (
  SELECT *,
    (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0.0) AS left_over,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0) AS weight_left
  FROM weighed
  WINDOW b AS (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT arg_min(left_over / weight_left, (most / weight, nth)) AS level FROM stops WHERE left_over / weight_left <= most / weight
), targets AS (
  SELECT src, nth, source_size, coalesce(least(most, level * weight), 0.0) AS target FROM stops, levels
), queued AS (
  SELECT doc_id, draw, size, nth, source_size, target,
    sum(size) OVER (PARTITION BY nth ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS through
  FROM sized JOIN targets USING (src)
  UNION ALL
  SELECT doc_id, draw, size, nth, source_size, target,
    sum(size) OVER (PARTITION BY nth ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS through
  FROM sized JOIN targets ON sized.src IS NULL AND targets.src IS NULL
), numbered_rows AS (
  SELECT *, row_number() OVER () AS rid FROM queued
), entries AS (
  SELECT rid, (source_size * round + through)::DOUBLE / target AS finish, nth, round, draw, doc_id, size
  FROM numbered_rows, (VALUES (0), (1), (2)) v(round) WHERE size > 0 AND target > 0
), ranked AS (
  SELECT rid, size, sum(size) OVER (ORDER BY finish, nth, round, draw, coalesce(doc_id::VARCHAR, ''), size) AS spent FROM entries
), served AS (
  SELECT rid, sum(size)::BIGINT AS taken FROM ranked WHERE spent <= (SELECT sum(size) FROM sized) GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM numbered_rows LEFT JOIN served USING (rid)
""",
    "op8_line_dedup": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), exploded AS (
  SELECT rid, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT rid, string_split(text, chr(10)) AS parts FROM docs)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM exploded
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), marked AS (
  SELECT k.*, c.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN common c USING (key)
), kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS kept
  FROM marked GROUP BY rid
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256
FROM docs JOIN kept USING (rid)
""",
}
