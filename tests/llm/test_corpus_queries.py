"""The registered queries: against SQL where there is some, else that they run whole; and the pipeline's stages."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference, duck
from notalake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    assert difference(spark, duck(FOLDER), QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_the_whole_table(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name == "op10_decontaminate":
        assert rows.count() > 0
    elif name == "op7_packing":
        assert rows.select("doc_id").distinct().count() == documents
    else:
        assert rows.count() == documents


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


EXTRA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stage_keeps_columns_and_clean_rows(spark, stage):
    words = [" ".join(f"{a}{chr(97 + i % 26)}{chr(97 + k % 23)}{chr(97 + k % 7)}" for k in range(60)) + "." for i, a in enumerate(["ba", "ce", "di", "fo", "gu"])]
    rows = [(i, w, "en", None, None) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, EXTRA).selectExpr("*", "1 AS stats", "2 AS `quality_stats`", "3 AS secrets", "'k' AS keys", "'x' AS row")
    out = stage[1](spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 4]
    assert stage[1](spark, docs.limit(0), FOLDER).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, None, None, None), (8, "", None, None, 0), (9, words[0], None, None, 1), (9, words[0], None, None, 1)], EXTRA)
    kept = [r["doc_id"] for r in stage[1](spark, odd, FOLDER).collect()]
    assert kept.count(9) == (1 if stage[0] == "jaccard_join" else 2)
    assert set(kept) == ({9} if stage[0] == "quality_rules" else {None, 7, 8, 9})


def test_pipeline_stages_do_what_they_say(spark):
    docs = corpus_pipeline.table(spark, FOLDER, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = corpus_pipeline.stored(corpus_pipeline.STAGES[0][1](spark, docs, FOLDER), "t")
    assert 0 < good.count() < len(before)
    single = corpus_pipeline.stored(corpus_pipeline.STAGES[1][1](spark, good, FOLDER), "t")
    assert single.count() <= good.count()
    assert single.select("doc_id").distinct().count() == single.count()
    clean = corpus_pipeline.STAGES[2][1](spark, single, FOLDER)
    masked = corpus_pipeline.STAGES[3][1](spark, clean, FOLDER)
    assert masked.count() == clean.count() > 0
    pieces = corpus_pipeline.STAGES[4][1](spark, masked, FOLDER)
    assert pieces.select("doc_id").distinct().count() == masked.count()
