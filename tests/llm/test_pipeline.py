"""The pipeline and the SQL statements over the smallest tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from compare import compare, duck  # noqa: E402

from tapelib.llm import decontamination, exact_dedup, near_dedup, queries, toxicity  # noqa: E402
from tapelib.llm.queries import remainder  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    err, n = compare(spark, duck(sf), sf, queries.QUERIES[name], queries.SQL[name])
    assert err is None and n > 0, err


def test_stages_keep_what_their_operators_keep(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = corpus_pipeline.run(spark, sf).collect()
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"), remainder("id", 4) != 2)
    keep = {r.doc_id for r in toxicity.score(docs, model).filter("score < 0.3").select("doc.doc_id").collect()}
    text = {}
    for i in sorted(keep):
        text.setdefault(rows[i].text or "", i)
    keep = set(text.values())
    frame = docs.filter(docs.doc_id.isin(list(keep)))
    keep = {r.id for r in near_dedup.near_groups(frame).filter("kept").collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    dirty = {r.doc_id for r in decontamination.find_phrases(docs, bench).filter(decontamination.contaminated()).select("doc.doc_id").collect()}
    assert {r.doc_id for r in left} == keep - dirty
    assert exact_dedup.exact_dedup(docs).columns == docs.columns


def test_stage_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and stage(spark, docs.filter("false"), sf).count() == 0
