import corpus_pipeline
from gapwright.session import table, written

from .cases import documents, empty


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.agg({"length": "sum"}).collect()[0][0] > 0
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_awkward_documents(spark, sf):
    for df in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, df, sf)
            assert done.count() <= 3 * df.count(), name
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert done.columns == df.columns, name
