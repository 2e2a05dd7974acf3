import os
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from notalake.functions.text import clean_wide
from notalake.operators import embedding, chunking, conversations, profile, records, relate, search, vectors
from notalake.session import checkpoint_root
from notalake.sources import exports, files
from notalake.streaming import jobs

DOCS = "id int, document_type string, issuer_cnpj string, created_at timestamp_ntz, total_value double"


def docs(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, "NFe" if i % 2 else None, "11.222.333/0001-81" if i % 3 else "99", start + timedelta(hours=7 * (i // 3)), float(i % 10) if i % 4 else None) for i in range(60)]
    return spark.createDataFrame(rows, DOCS), rows


def test_facets(spark):
    df, rows = docs(spark)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(search.facet_filter(df, issuer_cnpj="11.222", document_type="", id=None)) == [r[0] for r in rows if r[2] != "99"]
    assert ids(search.facet_filter(df, issuer_cnpj="1122233300")) == []
    assert ids(search.facet_filter(df, document_type="n_E", created_before=datetime(2024, 1, 2))) == [r[0] for r in rows if r[1] and r[3] < datetime(2024, 1, 2)]
    assert ids(search.exact_filter(df, document_type="NFe", missing=1)) == [r[0] for r in rows if r[1]]


@pytest.mark.parametrize("column,direction", [("created_at", "desc"), ("created_at", "asc"), ("total_value", "desc"), ("total_value", "asc"), ("document_type", "asc")])
def test_pages_at_any_depth(spark, tmp_path, column, direction):
    """By top-k, by rank index and by keyset: the same rows, nulls and equal keys among them."""
    df, _ = docs(spark)
    expected = [r["id"] for r in df.orderBy(search.ordering(column, direction), "id").collect()]
    search.rank_index(df, str(tmp_path), column, direction, ranges=9)
    size, last = 7, (-(-len(expected) // 7))
    for n in (1, 2, 5, last, last + 1):
        want = expected[(n - 1) * size : n * size]
        assert [r["id"] for r in search.page(df, n, size, column, direction).collect()] == want
        assert [r["id"] for r in search.ranked_page(spark, str(tmp_path), n, size, column, direction).collect()] == want
    for n in (0, 14, 15, 16, 30):
        row = df.filter(F.col("id") == expected[n]).first()
        assert [r["id"] for r in search.page_after(df, row[column], row["id"], size, column, direction).collect()] == expected[n + 1 : n + 1 + size]
    deep = search.ranked_page(spark, str(tmp_path), 5, size, column, direction)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range_no" in deep


def test_heavy_keys_of_an_outer_join_are_split(spark):
    left = spark.createDataFrame([(i, f"d{i}") for i in range(50)] + [(3, "twice"), (None, "none")], "k bigint, name string")
    rows = [(3 if i % 2 else i % 40, i) for i in range(4000)] + [(None, -1), (99, -2)]
    right = spark.createDataFrame(rows, "k bigint, event bigint").repartition(4)
    got = relate.left_join_split(left, right, "k", ["event"], least=200)
    want = left.join(right, "k", "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        split = relate.left_join_split(left, right, "k", ["event"], least=25).groupBy(F.spark_partition_id()).count()
        sizes = sorted(r["count"] for r in split.collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_deletes_go_down_all_levels(spark):
    session = spark.createDataFrame([(1,), (2,)], "s int")
    message = spark.createDataFrame([(10, 1), (11, 2), (12, 1)], "m int, s int")
    chunk = spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, None)], "c int, m int")
    part = spark.createDataFrame([(100,), (101,), (102,), (103,)], "c int")
    left = relate.cascade_levels([("message", message, "m", "s"), ("chunk", chunk, "c", "m"), ("part", part, "c", "c")], session.filter("s = 1"), "s")
    assert {n: sorted(tuple(r)[0] for r in df.collect()) for n, df in left.items()} == {"message": [11], "chunk": [101, 103], "part": [101, 103]}


def test_texts_are_embedded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def model():
        def run(texts):
            seen.add(len(texts))
            return [[3.0 * len(t), 4.0 * len(t)] if t else None for t in texts]

        return run

    rows = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    first = embedding.embedded(rows("a", "b", "a", "", None), "t", model, str(tmp_path), "one")
    got = {r["id"]: r["embedding"] for r in first.collect()}
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8] and got[0] == got[2] and got[3] is None and got[4] is None and len(got) == 5
    assert seen.value == 3
    for _ in range(2):  # the second time replaces its own entries
        second = embedding.embedded(rows("b", "c", "", "c"), "t", model, str(tmp_path), "two")
        assert sum(r["embedding"] is not None for r in second.collect()) == 3
    assert seen.value == 5
    assert spark.read.schema(embedding.CACHE).parquet(str(tmp_path)).count() == 4


def test_nulls_lead_descending_pages(spark):
    df, rows = docs(spark)
    first = [r["total_value"] for r in search.page(df, 1, 15, "total_value", "desc").collect()]
    assert first == [None] * 15
    assert search.page(df, 1, 0).count() == 10
    assert search.page_totals(df, 1, 0).first()["total_pages"] == 6


def test_reference(spark):
    df = spark.createDataFrame([("NFe 12/3", None), ("x", "9-123"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(search.matches_reference("123", "a", "b")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(search.matches_reference(" X ", "a", "b")).collect()] == [False, True, True]


def test_running_numbers_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(1000), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, t int, i int")
    got = {(r["k"], r["i"]): r["seq"] for r in relate.numbered(df, ["k"], ["t", "i"], F.floor(F.col("t") / 50)).collect()}
    for key in range(5):
        mine = sorted((t, i) for k, t, i in rows if k == key)
        assert [got[key, i] for _, i in mine] == list(range(1, len(mine) + 1))
    gaps = spark.createDataFrame([(None, 5, 1), (None, None, 2), (1, None, 3)], "k int, t int, i int")
    assert {r["i"]: r["seq"] for r in relate.numbered(gaps, ["k"], ["t", "i"], F.floor(F.col("t") / 50)).collect()} == {1: 2, 2: 1, 3: 1}


def test_upsert_and_friends(spark):
    a = spark.createDataFrame([(1, "old", 1), (2, "keep", 1)], "id int, s string, v int")
    b = spark.createDataFrame([(1, "new", 2)], "id int, s string, v int")
    assert {(r["id"], r["s"]) for r in relate.upsert(a, b, ["id"], "v", "s").collect()} == {(1, "new"), (2, "keep")}
    kept, lost = relate.keep_known(a, b, "id")
    assert [r["id"] for r in kept.collect()] == [1] and [r["id"] for r in lost.collect()] == [2]
    assert {r["id"] for r in relate.first_source_wins([a, b.withColumn("id", F.lit(3))], "id").collect()} == {1, 2, 3}
    conf = spark.createDataFrame([(-1.0,), (0.456,), (9.0,)], "c double").select(relate.clamped_confidence(F.col("c")).cast("string"))
    assert [r[0] for r in conf.collect()] == ["0.00", "0.46", "1.00"]


def test_latest_is_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = relate.latest(df, ["k"], F.desc("id"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def brute_nearest(store, queries, k, threshold):
    out = {}
    for q, vec in queries:
        sims = []
        for i, e in store:
            if e is None or len(e) != len(vec):
                continue
            n = np.linalg.norm(e) * np.linalg.norm(vec)
            s = round(float(np.dot(e, vec) / n), 9) if n else 0.0
            if s >= threshold:
                sims.append((-s, i))
        out[q] = [i for _, i in sorted(sims)[:k]]
    return out


def test_nearest_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    store = [(i, [float(v) for v in rng.integers(-3, 4, 8)]) for i in range(300)]
    store += [(1000, None), (1001, [1.0, 2.0]), (1002, [0.0] * 8), (1003, store[5][1])]
    queries = [(q, [float(v) for v in rng.integers(-3, 4, 8)]) for q in range(7)]
    s = spark.createDataFrame(store, "vec_id bigint, embedding array<float>").repartition(5)
    qs = spark.createDataFrame(queries, "query_id bigint, vector array<double>")
    for limit in (2048, 2):
        monkeypatch.setattr(vectors, "MAX_CLOSURE_QUERIES", limit)
        for k, threshold in ((5, -1.0), (400, 0.3)):
            got = {}
            for r in vectors.nearest(s, qs, k, threshold).orderBy("query_id", "rank").collect():
                got.setdefault(r["query_id"], []).append(r["vec_id"])
            assert {q: got.get(q, []) for q, _ in queries} == brute_nearest(store, queries, k, threshold)


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [0.0, 1.0]), (2, None)], "label int, embedding array<float>")
    assert {r["query_id"]: list(r["vector"]) for r in vectors.centroids(df, "label", 2).collect()} == {1: [2.0, 4.0], 2: [0.0, 1.0]}


def test_text_keys(spark):
    store = spark.createDataFrame([("b-2", [1.0, 0.0], "x"), ("a-1", [1.0, 0.0], "x"), ("c-3", [0.0, 1.0], "y")], "vec_id string, embedding array<float>, label string")
    queries = vectors.centroids(store, "label", 2)
    assert {r["query_id"]: list(r["vector"]) for r in queries.collect()} == {"x": [1.0, 0.0], "y": [0.0, 1.0]}
    got = [(r["query_id"], r["vec_id"]) for r in vectors.nearest(store, queries, 2, 0.5).orderBy("query_id", "rank").collect()]
    assert got == [("x", "a-1"), ("x", "b-2"), ("y", "c-3")]


def test_centroids_leave_other_widths_out_and_count_them(spark):
    rows = [(1, [9.0, 9.0, 9.0]), (1, [1.0, 3.0]), (1, [3.0, 5.0]), (1, [2.0, 4.0]), (2, [])]
    df = spark.createDataFrame(rows, "label int, embedding array<float>").coalesce(1)
    for size in ("10000", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert [list(r["vector"]) for r in vectors.centroids(df, "label", 2).collect()] == [[2.0, 4.0]]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["width"], r["n"]) for r in vectors.other_widths(df, 2).collect()} == {(3, 1), (0, 1)}
    assert vectors.common_width(df) == 2


def test_consistency_and_status(spark):
    own = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "query_id int, own_type string")
    hits = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (1, 11, "a"), (2, 10, "a"), (2, 12, "b"), (2, 13, "b")], "query_id int, document_id int, document_type string")
    got = {r["query_id"]: (r["n_similar"], round(r["confidence"], 3), r["finding"], r["kept_as_insight"]) for r in vectors.neighbour_consistency(hits, own).collect()}
    assert got == {1: (2, 1.0, "consistent", True), 2: (3, 0.333, "divergent", False), 3: (0, 0.0, "none", False)}
    store = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    none = spark.createDataFrame([], "query_id int")
    assert {r["status"] for r in vectors.answer_status(own, none, store).collect()} == {"no_documents"}


def test_pluggable_embedding(spark):
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if not s else [float(len(s)), 1.0])

    chunks = spark.createDataFrame([("abc",), ("",)], "content_text string")
    got = vectors.with_embedding(chunks, embed).select(vectors.unit_length(F.col("embedding")).alias("e")).collect()
    assert len(got) == 1 and abs(sum(v * v for v in got[0]["e"]) - 1) < 1e-6


def test_quantiles_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1.0, 1.0, 1.0, rng.random() * 100]), rng.randrange(7) if rng.random() < 0.8 else None) for _ in range(1500)]
    df = spark.createDataFrame(rows, "a double, b int").repartition(6)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in profile.exact_quantiles(df, ["a", "b"], probabilities).collect()}
    for name, values in (("a", [r[0] for r in rows]), ("b", [r[1] for r in rows if r[1] is not None])):
        for p in probabilities:
            assert abs(got[name, p] - pd.Series(values).quantile(p)) < 1e-9


def test_outliers_and_box_without_the_driver(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "v double")
    assert [r["v"] for r in profile.outliers(df, "v").collect()] == [100.0]
    assert tuple(profile.box(df, "v").first()) == (1.0, 2.0, 3.0, 4.0, 100.0, 1.0, 4.0, 1)
    assert {(r["column"], r["n_outliers"]) for r in profile.outlier_counts(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"]).collect()} == {("v", 1), ("w", 0)}


def test_profile_small(spark):
    df = spark.createDataFrame([(float(v), w) for v, w in zip([1, 2, 3, 4, 100], ["x", "x", None, None, None])], "v double, w string")
    assert [r["v"] for r in profile.outliers(df, "v").collect()] == [100.0]
    assert {(r["column"], r["flagged"]) for r in profile.missing_shares(df).collect()} == {("v", False), ("w", True)}
    assert profile.overview(df, ["v"]).first()["potential_issues"] == 2
    assert sum(r["n"] for r in profile.histogram(df, "v", 4).collect()) == 5
    b = profile.box(df, "v").first()
    assert (b["q1"], b["median"], b["upper_whisker"], b["n_outliers"]) == (2.0, 3.0, 4.0, 1)


def test_context_window_reads_the_oldest_fifty(spark):
    rows = [(1, i, i, "user" if i % 2 else "assistant", f" m{i} ") for i in range(80)]
    df = spark.createDataFrame(rows, "session_id int, message_id int, created_at int, message_type string, content string")
    r = conversations.context_window(df).first()
    assert r["n_shown"] == 10 and r["context"].split("\n")[0] == "[Assistente]: m40" and r["context"].endswith("[Usuário]: m49")


def test_records(spark):
    df = spark.createDataFrame([(1, None, '{"raw_text":"olá","a":"b"}'), (2, "tem", '{"raw_text":"x"}'), (3, None, '{"a":"b"}')], "id int, raw_text string, d string")
    got = [(r["raw_text"], r["d"]) for r in records.backfilled(df, "raw_text", "d", "raw_text").orderBy("id").collect()]
    assert got == [("olá", '{"a":"b"}'), ("tem", '{"raw_text":"x"}'), (None, '{"a":"b"}')]
    vec = spark.createDataFrame([("[1.0,2.0]",), ("[1.0]",), ("x",), (None,)], "t string")
    assert list(records.vector_audit(vec, "t", 2).first()) == [4, 3, 1, 2]


def test_assembled_text_and_status(spark):
    df = spark.createDataFrame([(1, "NFe", None, "abc")], "id int, t string, n string, b string")
    assert df.select(chunking.assembled_text(F.col("t"), F.col("n"), F.lit("9"), [("k", F.lit(5))], F.col("b"))).first()[0] == "Tipo: NFe CNPJ Emissor: 9 k: 5 abc"
    many = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    chunks = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False)], "id int, e boolean")
    got = {r["id"]: r["embedding_status"] for r in chunking.embedding_status(many, chunks, "id", F.col("e")).collect()}
    assert got == {1: "completed", 2: "processing", 3: "failed"}


def test_exports_and_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ação; x", 1234.5), (2, None, None)], "id int, t string, v double").coalesce(1)
    exports.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿id;t;v\n") and '1;"Ação; x";1234,50' in text
    exports.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    (tmp_path / "store.json").write_text('{"documents": [{"id": "a", "total": 1.5},\n {"id": "b", "total": 2}], "next_id": 3}')
    assert sorted(r["id"] for r in files.json_store(spark, str(tmp_path / "store.json")).collect()) == ["a", "b"]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2\n3,y\n")
    assert files.csv_table(spark, str(tmp_path / "t.csv"), "a int, b string").count() == 2
    assert dict(files.csv_table(spark, str(tmp_path / "t.csv")).dtypes)["a"] == "int"


def test_xml_ingest_stream_survives_replay(spark, tmp_path):
    inbox, table, bad, ckpt, links = (str(tmp_path / n) for n in ("inbox", "table", "bad", "ckpt", "links"))
    (tmp_path / "inbox").mkdir()
    note = "<NFe>\n<infNFe><ide><nNF>{}</nNF></ide></infNFe></NFe>"
    (tmp_path / "inbox" / "a.xml").write_text(note.format(1))
    (tmp_path / "inbox" / "b.xml").write_text("<NFe>")
    jobs.ingest_xml(jobs.xml_stream(spark, inbox), table, bad, ckpt, links)
    (tmp_path / "inbox" / "c.xml").write_text(note.format(3))
    jobs.ingest_xml(jobs.xml_stream(spark, inbox), table, bad, ckpt, links)
    jobs.ingest_xml(jobs.xml_stream(spark, inbox), table, bad, ckpt, links)
    assert {(r["file_name"], r["numero"]) for r in jobs.current_documents(spark, table).collect()} == {("a.xml", "1"), ("c.xml", "3")}
    assert [r["file_name"] for r in spark.read.parquet(bad).collect()] == ["b.xml"]
    current = jobs.current_documents(spark, table)
    assert current.count() == 2 and "Window" not in current._jdf.queryExecution().executedPlan().toString()


def test_xml_ingest_parses_once_and_caches_no_parse_tree(spark, tmp_path, monkeypatch):
    inbox, table, bad, links, ckpt = (str(tmp_path / n) for n in ("inbox", "table", "bad", "links", "ckpt"))
    (tmp_path / "inbox").mkdir()
    for name, text in (("a.xml", "<NFe><infNFe><ide><nNF>1</nNF></ide></infNFe></NFe>"), ("b.xml", "<NFe>"), ("c.xml", "<pedido/>"), ("d.xml", "no xml")):
        (tmp_path / "inbox" / name).write_text(text)
    calls, parse = [], jobs.extract_xml.parsed
    monkeypatch.setattr(jobs.extract_xml, "parsed", lambda df: calls.append(df) or parse(df))
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *_: pytest.fail("cached"))
    jobs.ingest_xml(jobs.xml_stream(spark, inbox), table, bad, ckpt, links)
    assert len(calls) == 1 and [r["file_name"] for r in jobs.current_documents(spark, table).collect()] == ["a.xml"]
    rejects = {r["file_name"]: (r["error"], r["raw_text"]) for r in spark.read.parquet(bad).collect()}
    assert rejects == {"b.xml": ("xml_parse_error", "<NFe>"), "c.xml": ("unknown_document_type", "<pedido/>"), "d.xml": ("invalid_xml", "no xml")}
    assert spark.read.parquet(links).count() == 0


def test_xml_ingest_keeps_what_manifests_carry(spark, tmp_path):
    inbox, table, bad, links, ckpt = (str(tmp_path / n) for n in ("inbox", "table", "bad", "links", "ckpt"))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "m.xml").write_text(
        "<MDFe><infMDFe><infDoc><infMunDescarga><infCTe><chCTe>77</chCTe></infCTe></infMunDescarga></infDoc><tot><vCarga>5.50</vCarga><qCarga>2</qCarga></tot></infMDFe></MDFe>"
    )
    jobs.ingest_xml(jobs.xml_stream(spark, inbox), table, bad, ckpt, links)
    assert [(r["file_name"], r["tipo"], r["chave"]) for r in spark.read.parquet(links).collect()] == [("m.xml", "CTe", "77")]
    assert jobs.current_documents(spark, table).first()["carga"]["qCarga"] == "2"


@pytest.mark.parametrize("days,want", [(1, [1, 2, 3, 5]), (7, [1, 3, 5]), (30, [1, 5])])
@pytest.mark.parametrize("per_batch", [1, 100])
def test_expiring_entries_whatever_the_batches(spark, tmp_path, days, want, per_batch):
    start = datetime(2024, 1, 1)
    rows = [(1, 0, 10), (2, 3, 10), (3, 19, 10), (4, 19.5, 10), (5, 50, 10)] + [(9, 0.5, 11)]
    for k, (event, day, user) in enumerate(sorted(rows, key=lambda r: r[1])):
        frame = spark.createDataFrame([(event, start + timedelta(days=day), user, "v", 1.0, "{}")], jobs.EVENTS)
        frame.coalesce(1).write.parquet(str(tmp_path / "w" / str(k)))
        part = next((tmp_path / "w" / str(k)).glob("part*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"events{k}.parquet"
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    out = str(tmp_path / "out")
    stream = jobs.event_stream(spark, str(tmp_path / "in"), per_batch)
    jobs.run_to_files(jobs.first_within(stream, "user_id", timedelta(days=days)), out, str(tmp_path / "ckpt"))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).filter("user_id = 10").collect()) == want


@pytest.mark.parametrize("late_days,want", [(None, [1, 2, 3, 4, 7, 8]), (40, [1, 2, 3, 4, 7, 8, 9])])
def test_late_events_keep_their_place(spark, tmp_path, late_days, want):
    start = datetime(2024, 1, 1)
    arriving = [(1, 20, 10), (2, 27, 10), (3, 28, 12), (4, 22, 11), (5, 24, 10), (6, 28.5, 11), (7, 36, 10), (8, 29.5, 13), (9, 10, 10), (10, 15, 10)]
    (tmp_path / "in").mkdir()
    for event, day, user in arriving:
        frame = spark.createDataFrame([(event, start + timedelta(days=day), user, "v", 1.0, "{}")], jobs.EVENTS)
        frame.coalesce(1).write.parquet(str(tmp_path / "w" / str(event)))
        target = tmp_path / "in" / f"events{event}.parquet"
        target.write_bytes(next((tmp_path / "w" / str(event)).glob("part*.parquet")).read_bytes())
        os.utime(target, (1_700_000_000 + event, 1_700_000_000 + event))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), 1)
    lateness = None if late_days is None else timedelta(days=late_days)
    jobs.run_to_files(jobs.first_within(stream, "user_id", timedelta(days=7), lateness), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    with pytest.raises(ValueError, match="lateness"):
        jobs.first_within(stream, "user_id", timedelta(days=7), timedelta(days=6))


def test_csv_lines_with_quoted_commas(spark):
    lines = spark.createDataFrame([('1,"Silva, Ltda"',), ("2,x,y",), ("3",), (" ",), ("4, z ",)], "value string")
    assert [tuple(r) for r in files.csv_text(lines, ["id", "name"]).collect()] == [("1", "Silva, Ltda"), ("4", "z")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class sparkContext:
            master = "spark://head:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Cluster)


def test_clean_text_is_jvm_side(spark):
    plan = spark.range(1).select(clean_wide(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
