import corpus_pipeline
from repeatwise.llm.queries import ORACLES, QUERIES


def test_stages_keep_columns_and_rows(spark, edges, documents):
    for docs in (documents, edges):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").columns[0] == "doc_id"


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
