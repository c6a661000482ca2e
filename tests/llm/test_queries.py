import glob
import os

import duckdb
import pytest

import corpus_pipeline
from vireo.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    rel = con.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert (docs.columns == columns) if k < 4 else set(columns) < set(docs.columns)
        assert 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == n


def test_pipeline_with_clashing_columns(spark, sf_dir):
    """Columns named as the stages' own change nothing in the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.selectExpr("*", "0 as _lang_score", "'und' as _LANG_PRED", "0 as _n_dropped", "7 as _n_lines")
    for stage in (corpus_pipeline.language_id, corpus_pipeline.line_dedup):
        plain, other = stage(spark, docs, sf_dir), stage(spark, odd, sf_dir)
        assert other.columns == odd.columns and plain.count() > 100
        assert other.select(docs.columns).exceptAll(plain).isEmpty() and plain.exceptAll(other.select(docs.columns)).isEmpty()


def test_pipeline_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
