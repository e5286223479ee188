"""The pipeline's stages and registration."""

import pytest

import corpus_pipeline
from sitelens.llm import ordermh, piecebpe, queries, toxicity
from sitelens.llm.common import DOCUMENT_COLUMNS, table


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_one_by_one(shipped, sf_dir):
    docs = table(shipped, sf_dir, "documents")
    labels = table(shipped, sf_dir, "labels")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    first = stage["toxicity"](shipped, docs, sf_dir)
    assert tuple(first.columns) == DOCUMENT_COLUMNS
    assert ids(first) == sorted(r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect())

    second = stage["line_dedup"](shipped, docs, sf_dir)
    assert tuple(second.columns) == DOCUMENT_COLUMNS and ids(second) == ids(docs)
    assert second.filter("n_chars <> length(text)").count() == 0

    third = stage["near_dedup"](shipped, docs, sf_dir)
    kept = ordermh.near_duplicate_classes(docs).filter("kept")
    assert tuple(third.columns) == DOCUMENT_COLUMNS and ids(third) == ids(kept)

    fourth = stage["mixing"](shipped, docs, sf_dir)
    assert tuple(fourth.columns) == DOCUMENT_COLUMNS and set(ids(fourth)) == set(ids(docs))

    fifth = stage["encoding"](shipped, docs, sf_dir)
    assert sorted(map(str, fifth.collect())) == sorted(map(str, piecebpe.encode_documents(docs).collect()))


def test_run_keeps_what_stages_keep(shipped, sf_dir):
    docs = table(shipped, sf_dir, "documents")
    for _, f in corpus_pipeline.STAGES:
        docs = f(shipped, docs, sf_dir)
    assert sorted(map(str, corpus_pipeline.run(shipped, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_odd_documents_go_through(odd_documents, no_documents, shipped, tmp_path):
    labels = shipped.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows, n in ((odd_documents, 6), (no_documents, 0)):
        docs = rows
        for _, f in corpus_pipeline.STAGES:
            docs = f(shipped, docs, str(tmp_path))
        assert docs.count() >= n
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(shipped, sf_dir, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](shipped, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
