"""What a row costs: expressions are compiled and computed once, rows of a block do not keep their batch."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notalake import reference_data as ref
from notalake.functions import text as t
from notalake.operators import extract_text as x
from notalake.operators import search, validate as v, vector_blocks
from notalake.operators.stages import computed_once


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_computed_once_is_a_projection(spark):
    df = computed_once(spark.createDataFrame([("ab",), (None,)], "s string"), "n", F.length(F.concat("s", F.rand().cast("string"))) * 0)
    assert df.columns == ["s", "n"]
    assert "Generate explode(_n_held" in plan(df.filter("n > -1"))
    assert plan(df.filter("n > -1")).count("length(") == 1
    assert [r["n"] for r in df.collect()] == [0, None]


def test_rules_run_without_lambdas(spark):
    rules = [v.Rule("a", "error", F.col("n") > 1, F.concat(F.lit("m"), F.col("n").cast("string"))), v.Rule("b", "warning", F.col("n") > 2, F.lit("x"))]
    df = v.issues(spark.createDataFrame([(1, 1), (2, 2), (3, 3), (3, 3), (4, None)], "id int, n int"), rules, "id")
    assert "lambda" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [(2, 0, "a", "error", "m2")] + [(3, 0, "a", "error", "m3")] * 2 + [(3, 1, "b", "warning", "x")] * 2


def _orders(spark, tmp_path):
    rows = "SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, 12.5D AS o_totalprice, timestamp_ntz'1996-01-02 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(60)"
    spark.sql(rows).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_merged_issues_reads_the_documents_once(spark, tmp_path):
    from notalake.plans import validation

    df = validation.merged_issues(spark, _orders(spark, tmp_path))
    assert plan(df).count("Relation [") == 1
    assert df.filter("category = 'Aviso'").count() == 0 and df.count() > 60


def test_reference_match_parses_a_record_once(spark, tmp_path):
    from notalake.plans import catalog, registry

    catalog.load()
    df = registry.QUERIES["reference_match_all"](spark, _orders(spark, tmp_path))
    assert plan(df).count("parse_json") <= 1 and len(re.findall("parseJson|to_json|tojson", plan(df), re.I)) <= 3
    assert "lambda" not in plan(df)
    assert {15, 8} <= {r["id"] for r in df.collect()}


def test_matches_reference_with_nulls(spark):
    df = spark.createDataFrame([("1-2", None), (None, "12"), (None, None), ("x", "1 3")], "a string, b string")
    assert [r[0] for r in df.select(search.matches_reference("12", "a", "b")).collect()] == [True, True, False, False]


def test_item_lines_are_read_in_one_pass(spark):
    text = "ITENS DA NOTA\n10 Porca, M8 2,5 UN 1.000,00 2,00\n11 Chave 3 CX 1,00 3,00\nTotal R$ 9\n88 Depois 1 UN 1,00 1,00"
    df = spark.createDataFrame([(1, text), (2, "nada"), (3, None), (1, text)], "id int, raw_text string")
    found = x.text_items(df, "id")
    assert "lambda" not in plan(found)
    assert plan(found).count("regexp_extract(raw_text") == 1
    rows = [(1, 1, "10", "Porca, M8", 2.5, "UN", 1000.0, 2.0), (1, 2, "11", "Chave", 3.0, "CX", 1.0, 3.0)]
    assert sorted(map(tuple, found.collect())) == sorted(rows * 2)


ODD = [
    "", " ", "  a  b\t\n", "A  B　C", "x\u0000y\x7fz", "NF-E e nfe, CNPJ! cte?", "ıpi pıs İPI icmſ", "Imposto Sobre Produtos Industrializados (IPI)",
    "a\\b^c`d{e}|~#&'\"=+*<>[f]@", "é́ م 中文 😀 ‍_", "nfenf nf mdfe. contribuição para o financiamento da seguridade social", "᠎ x ​", None,
]


def _plain_clean(text, signs):
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return trim, F.regexp_replace(F.regexp_replace(trim(text), r"(?U)\s+", " "), signs, "")


def test_cleaners_as_plain_patterns(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string")
    trim, wide = _plain_clean(F.col("s"), r"(?U)[^\w\s\-.,;:()/%R$@+*<>_=\[\]]")
    wide = F.lower(wide)
    for pattern, replacement in ref.CLEAN_TERMS:
        wide = F.regexp_replace(wide, "(?iuU)" + pattern, replacement)
    _, narrow = _plain_clean(F.col("s"), r"(?U)[^\w\s\-.,;:()/%R$]")
    for old, new in ref.CLEAN_REPLACEMENTS:
        narrow = F.replace(narrow, F.lit(old), F.lit(new))
    pairs = {"wide": (t.clean_wide(F.col("s")), trim(wide)), "narrow": (t.clean_narrow(F.col("s")), trim(narrow)), "trim": (t.trim_space(F.col("s")), trim(F.col("s")))}
    for name, (ours, plain) in pairs.items():
        assert [tuple(r) for r in df.select(ours, plain).collect() if r[0] != r[1]] == [], name


@pytest.mark.parametrize("pattern,letters", [("CNPJ", "C"), ("(?:I[.]|Ab)(c|d)", "IA"), (r"\b(nf|x)\b", "nx"), ("(?:a|b)?c", None), ("a*b", None), ("[0-9]", None), ("a|(?=b)c", None), ("a|b", "ab")])
def test_first_letters(pattern, letters):
    assert t.first_letters(pattern) == letters


def test_labels_as_plain_patterns(spark):
    texts = ["cnpj: 12.3 CPF 1 ı.e. 77 SÉRIE 4", "ſerie 9ſérie: 8", "Nota Nº 12 CT-e N° 5", "NOME DO DESTINATÁRIO: Zé\nuf fim rj", None, ""]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for pattern in ref.LABEL_PATTERNS.values():
        both = df.select(F.regexp_extract("s", t.started(pattern), 1).alias("a"), F.regexp_extract("s", "(?iuU)" + pattern, 1).alias("b"))
        assert [r for r in both.collect() if r["a"] != r["b"]] == [], pattern


def test_held_rows_do_not_keep_their_batches():
    width, rng = 8, np.random.default_rng(0)
    run, _ = vector_blocks._ranked(width, 2, -1.0, ("bigint", "bigint"))
    most = []

    def batches():
        for b in range(32):
            q, s = rng.normal(size=(16, width)), rng.normal(size=(16, width))
            filler = bytes(1 << 20)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([list(range(b * 16, b * 16 + 16))], pa.list_(pa.int64())),
                    pa.array([q.tobytes()], pa.binary()),
                    pa.array([list(range(16))], pa.list_(pa.int64())),
                    pa.array([s.tobytes()], pa.binary()),
                    pa.array([filler], pa.binary()),
                ],
                ["q_keys", "q_matrix", "keys", "matrix", "filler"],
            )

    def sent():
        # as from a worker's socket: all columns of a batch lie in one buffer
        for batch in batches():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.ipc.open_stream(sink.getvalue()).read_next_batch()
            del batch, sink, writer
            most.append(pa.total_allocated_bytes())

    found = [r for out in run(sent()) for r in out.column("query_id").to_pylist()]
    assert sorted(set(found)) == list(range(512)) and len(found) == 1024
    assert most[-1] - most[0] < 8 << 20
