"""Vector blocks and cells, posting lists, buckets, and streams in event time."""

import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from notalake.operators import bucket_store, gram_index, search, vector_blocks, vectors
from notalake.streaming import jobs, timed
from test_tables import brute_nearest

FOLDER = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_block_join_against_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"k{i:05d}")
    store = [(name(i), [float(v) for v in rng.integers(-3, 4, 8)]) for i in range(300)]
    store += [(name(1000), None), (name(1001), [1.0, 2.0]), (name(1002), [0.0] * 8)] + [(name(1003 + i), store[5][1]) for i in range(20)] + [(None, store[5][1])]
    queries = [(name(q), [float(v) for v in rng.integers(-3, 4, 8)]) for q in range(60)]
    s = spark.createDataFrame(store, f"vec_id {kind}, embedding array<float>").repartition(5)
    qs = spark.createDataFrame(queries, f"query_id {kind}, vector array<double>").repartition(3)
    monkeypatch.setattr(vector_blocks, "BLOCK", 32)
    monkeypatch.setattr(vector_blocks, "QUERIES_PER_ROW", 25)
    monkeypatch.setattr(vector_blocks, "HELD", 2)
    for k, threshold in ((5, -1.0), (400, 0.3)):
        found = vector_blocks.nearest_blocks(s, qs, k, threshold, 8)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert {q: got.get(q, []) for q, _ in queries} == brute_nearest([r for r in store if r[0] is not None], queries, k, threshold)
    assert "CartesianProduct" not in plan(found) and "BroadcastNestedLoopJoin" not in plan(found) and "WindowGroupLimit" in plan(found)


def test_fifty_thousand_queries(spark):
    """More queries than a closure takes; each finds the copy of itself."""
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(200, 6))
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id bigint, embedding array<double>")
    copies = spark.range(250).select(F.col("id").alias("copy"))
    queries = copies.crossJoin(store).select((F.col("copy") * 1000 + F.col("vec_id")).alias("query_id"), F.col("embedding").alias("vector"))
    found = vectors.nearest(store, queries, 1)
    assert found.count() == 50_000
    assert found.filter(F.col("query_id") % 1000 != F.col("vec_id")).count() == 0


def test_carried_key_comes_along(spark, monkeypatch):
    store = spark.createDataFrame([(1, [1.0, 0.0], 70), (2, [0.0, 1.0], 71), (3, [1.0, 0.1], 72)], "vec_id bigint, embedding array<float>, document_id bigint")
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (10, [0.0, 1.0])], "query_id bigint, vector array<double>")
    docs = spark.createDataFrame([(70, "a"), (72, "b")], "document_id bigint, document_type string")
    for limit in (2048, 1):
        monkeypatch.setattr(vectors, "MAX_CLOSURE_QUERIES", limit)
        found = vectors.search(store, queries, docs, 2, 0.5)
        assert {(r["query_id"], r["vec_id"], r["document_type"]) for r in found.collect()} == {(9, 1, "a"), (9, 3, "b")}


@given
def test_recall_of_the_inverted_file(spark, tmp_path):
    store = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vector_blocks.write_index(store, str(tmp_path), 32, 64)
    asked = store.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.nearest(store, asked, 10).collect()}
    recall = {}
    for probes in (8, 20, 32):
        found = vector_blocks.search_index(spark, str(tmp_path), asked, 10, probes)
        recall[probes] = len(exact & {(r["query_id"], r["vec_id"]) for r in found.collect()}) / len(exact)
    print("recall at 10", recall)
    assert recall[32] == 1.0 and recall[20] >= 0.9 and recall[8] < recall[20]
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == store.count()


def test_recall_of_the_inverted_file_on_clusters(spark, tmp_path):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.15 * rng.normal(size=16)).tolist()) for i in range(4000)]
    store = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    vector_blocks.write_index(store, str(tmp_path), 32, 16)
    asked = store.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.nearest(store, asked, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in vector_blocks.search_index(spark, str(tmp_path), asked, 10, 3).collect()}
    assert len(exact & found) / len(exact) >= 0.95


def test_inverted_file_of_little(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (None, [1.0, 0.0])], "query_id bigint, vector array<double>")
    vector_blocks.write_index(empty, str(tmp_path / "e"), 4, 2)
    assert vector_blocks.search_index(spark, str(tmp_path / "e"), queries, 3, 2).count() == 0
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (None, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    vector_blocks.write_index(store, str(tmp_path / "s"), 4, 2)
    found = vector_blocks.search_index(spark, str(tmp_path / "s"), queries, 3, 4)
    assert [(r["query_id"], r["vec_id"], r["similarity"]) for r in found.orderBy("rank").collect()] == [(1, 1, 1.0), (1, 2, 0.0)]


def test_gram_search_is_contains(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcÇ 1.") for _ in range(rng.randint(0, 12)))
    rows = [(i, word(), None if i % 4 == 0 else word(), "😀é" * (i % 3)) for i in range(300)] + [(900, None, None, None), (901, "", "\n", "A\nb")]
    docs = spark.createDataFrame(rows, "id bigint, a string, b string, key string").repartition(4)
    texts = ["a", "AB", "abc", "ç 1", "ca1b", "zz", "", None, "😀é😀", "\n", "a\nB", ".", "  "]
    searches = spark.createDataFrame(list(enumerate(texts)), "search_id bigint, query string")
    gram_index.build(docs, "id", ["a", "b", "key"], str(tmp_path))
    found = {(r["search_id"], r["id"]) for r in gram_index.search(spark, str(tmp_path), docs, "id", ["a", "b", "key"], searches).collect()}
    want = {(n, r["id"]) for n, t in enumerate(texts) if t for r in search.contains_text(docs, t, "a", "b", "key").collect()}
    assert found == want and len({n for n, _ in want}) >= 9


def test_gram_lists_take_little_room(spark, tmp_path, monkeypatch):
    """Grams that most rows hold have no list, lists are gaps in segments; repeated and missing keys and repeated searches count as in a scan."""
    monkeypatch.setattr(gram_index, "SEGMENT", 700)
    docs = spark.range(4000).select(F.expr("nullif(id % 3900, 17)").alias("id"), F.format_string('{"numero":"%d","emitente":"Loja %d"}', "id", F.col("id") % 97).alias("a")).repartition(3)
    texts = ["numero", "LOJA 96", '"39', "17", "loja", "7", "17", "none"]
    searches = spark.createDataFrame(list(enumerate(texts)) + [(0, "numero")], "search_id bigint, query string")
    gram_index.build(docs, "id", ["a"], str(tmp_path))
    lists = spark.read.parquet(f"{tmp_path}/postings").filter("slot >= 0")
    grams = sum(len({t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}) for t in (r["a"].lower() for r in docs.collect()))
    assert lists.agg(F.sum("n").alias("n")).first()["n"] == grams
    kept = lists.agg(F.count("*").alias("rows"), F.sum(F.size(F.coalesce("gaps", F.array().cast("array<smallint>")))).alias("kept")).first()
    assert 0 < kept["kept"] < grams / 3 and kept["rows"] < grams / 10
    found = gram_index.search(spark, str(tmp_path), docs, "id", ["a"], searches)
    scan = docs.join(searches, F.contains(F.lower("a"), F.lower("query"))).select("search_id", "id")
    assert found.exceptAll(scan).isEmpty() and scan.exceptAll(found).isEmpty() and scan.count() > 8000


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucket_store, "TASK_ROWS", 3_000)
    path = str(tmp_path / "t")
    rows = spark.range(0, 60_000, 1, 6).select("id", F.sha2(F.col("id").cast("string"), 512).alias("note"))
    bucket_store.create(spark, path, rows.schema, ["id"], 2)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500KB")
    try:
        bucket_store.upsert(rows, path, [F.desc("note")], 0)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = bucket_store.current(spark, path).groupBy(F.col("_metadata.file_name")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in files) == 60_000 and len(files) >= 8 and max(r["n"] for r in files) < 12_000


def test_an_upsert_shuffles_a_few_buckets_at_a_time_and_keeps_no_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucket_store, "WAVE_ROWS", 4_000)
    path = str(tmp_path / "t")
    rows = lambda n, v: spark.range(0, n, 1, 4).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), F.lit(v).alias("v"), F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(f"{v}{k}")), 512) for k in range(8)]).alias("note"))
    held = lambda: sum(f.stat().st_size for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data"))
    bucket_store.create(spark, path, rows(0, 1).schema, ["id"], 8)
    for batch, n in ((0, 12_000), (1, 6_000), (1, 6_000)):
        before = held()
        assert bucket_store.upsert(rows(n, batch), path, [F.desc("v")], batch) == list(range(8))
        assert held() - before < 1_000_000  # of some 12 MB of rows; the counts by bucket stay
    got = {r["id"]: (r["v"], r["n"]) for r in bucket_store.current(spark, path).groupBy("id").agg(F.max("v").alias("v"), F.count("*").alias("n")).collect()}
    assert got == {None if i == 7 else i: (int(i < 6_000), 1) for i in range(12_000)}
    assert bucket_store._waves({0: 3_000, 1: 1_000, 2: 9_000, 5: 1}) == [[0, 1], [2], [5]]


def test_an_upsert_sorts_and_shuffles_rows_once(spark, tmp_path, monkeypatch):
    path, plans = str(tmp_path / "t"), []
    rows = spark.range(1000).select("id", F.lit("x").alias("note"))
    bucket_store.create(spark, path, rows.schema, ["id"], 4)
    merge = bucket_store.latest
    monkeypatch.setattr(bucket_store, "latest", lambda *a: plans.append(plan(found := merge(*a))) or found)
    bucket_store.upsert(rows, path, [F.desc("note")], 0)
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 == plans[0].count("Sort [")


def test_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v bigint, note string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    order = [F.desc("v")]
    bucket_store.create(spark, path, rows().schema, ["k"], 8)
    assert bucket_store.current(spark, path).count() == 0
    bucket_store.upsert(rows(*[(f"k{i}", 1, "a") for i in range(40)], (None, 1, "n")), path, order, 0)
    wrote = bucket_store.upsert(rows(("k1", 2, "b"), ("k1", 3, "c"), ("new", 1, "d"), ("k2", 0, "older")), path, order, 1)
    state = lambda: {(r["k"], r["v"], r["note"]) for r in bucket_store.current(spark, path).collect()}
    want = {(f"k{i}", 1, "a") for i in range(40) if i != 1} | {("k1", 3, "c"), ("new", 1, "d"), (None, 1, "n")}
    assert state() == want and 0 < len(wrote) <= 3
    # the same batch once more changes nothing; neither does making the table again
    bucket_store.upsert(rows(("k1", 2, "b"), ("k1", 3, "c"), ("new", 1, "d"), ("k2", 0, "older")), path, order, 1)
    bucket_store.create(spark, path, rows().schema, ["k"], 4)
    assert state() == want
    # a batch that wrote its folders and not its manifest is not seen, and can run again
    rows(("k5", 9, "lost")).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{path}/data/2")
    assert state() == want
    bucket_store.upsert(rows(("k5", 9, "kept")), path, order, 2)
    assert state() == want - {("k5", 1, "a")} | {("k5", 9, "kept")}
    read = plan(bucket_store.current(spark, path))
    assert "Window" not in read and "Exchange" not in read


def land(spark, tmp_path, batch, rows):
    frame = spark.createDataFrame([(event, datetime(2024, 1, 1) + timedelta(days=day), user, "v", 1.0, "{}") for event, day, user in rows], jobs.EVENTS)
    frame.coalesce(1).write.parquet(str(tmp_path / "w" / str(batch)))
    target = tmp_path / "in" / f"events{batch}.parquet"
    target.write_bytes(next((tmp_path / "w" / str(batch)).glob("part*.parquet")).read_bytes())
    os.utime(target, (1_700_000_000 + batch, 1_700_000_000 + batch))


@pytest.mark.parametrize("runs", [1, 2])
def test_events_pass_in_event_time_whatever_their_arrival(spark, tmp_path, runs):
    """Out of order within the lateness, across batches and restarts; what is later is dropped and counted."""
    (tmp_path / "in").mkdir()
    batches = [[(1, 8, 10), (2, 9, 11)], [(3, 3, 10), (4, 10, 12)], [(5, 0, 10), (6, 12, 10)], [(7, 30, 13), (8, 16, 10)], [(9, 11, 14), (10, 28, 10)], [(11, 90, 99)]]
    for part in range(runs):
        for k, rows in enumerate(batches):
            if k % runs == part if runs == 1 else (k < 3) == (part == 0):
                land(spark, tmp_path, k, rows)
        passed = timed.first_in_order(jobs.event_stream(spark, str(tmp_path / "in"), 1), "user_id", timedelta(days=7), timedelta(days=15))
        timed.run_to_files(passed, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = spark.read.schema("user_id bigint, event_id bigint, late boolean").parquet(str(tmp_path / "out")).collect()
    # user 10: 0 opens, 3 no, 8 yes, 12 no, 16 yes, 28 yes; user 14: 11 comes 19 days behind; 99 still waits
    assert [(r["user_id"], r["event_id"]) for r in got if r["late"]] == [(14, 9)]
    assert sorted((r["user_id"], r["event_id"]) for r in got if not r["late"]) == [(10, 1), (10, 5), (10, 8), (10, 10), (11, 2), (12, 4), (13, 7)]
