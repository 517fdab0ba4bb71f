"""The pipeline's stages: what goes, what stays, and which columns come out."""

import pytest
from samples import edited, prose

import __spark_entry__ as entry
import corpus_pipeline
from factorlab.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    item = prose(40, 500)
    rows = [(i, prose(80, i), "aa") for i in range(20)]
    rows += [(100, edited(prose(80, 3), 79, 1), "aa"), (101, prose(80, 4), None), (102, prose(50, 600) + ". " + item, None), (103, None, "aa"), (104, "12 34", None), (105, "", None), (106, "Mail a.b@example.org now", None), (106, "Mail a.b@example.org now", None)]
    documents(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, gone = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        kept = {r.doc_id: r.text for r in docs.collect()}
        gone.append({r.doc_id for r in before.collect()} - set(kept))
    assert gone == [{103, 104, 105}, {100, 101}, {102}, set()]
    assert kept[106] == "Mail [EMAIL] now" and kept[0] == prose(80, 0)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()} == {*range(20), 106}


def test_run_and_names(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() >= 21
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1
    assert set(SQL) <= set(QUERIES) and "pipeline" in entry.queries()
