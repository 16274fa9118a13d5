"""The registered queries and the pipeline on the smallest given tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from herdwatch.llm import catalog
from tests.llm.data import frame
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert compare(catalog.queries()[name](spark, SF_DIR), connect(SF_DIR), catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_gives_a_row_for_every_document(spark, name):
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())
    assert sorted(r[0] for r in catalog.queries()[name](spark, SF_DIR).select("doc_id").collect()) == ids


def test_stages_keep_columns_and_awkward_rows(spark):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_pipeline(spark):
    raw = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert 0 < len(out) < len(raw) and len({r.doc_id for r in out}) == len(out)
    good = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 0").collect()}
    assert not good & {r.doc_id for r in out}
