"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as p
from ..sources.tables import table
from .registry import register

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WORDS = ["l_returnflag", "l_linestatus"]


def _num(c: str, table_name: str = "lineitem") -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(sum({c}), 2) AS sum FROM {table_name}"""


def _tops(k: int) -> str:
    each = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM lineitem GROUP BY 2""" for c in WORDS)
    return f"""SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM ({each}) QUALIFY rank <= {k}"""


@register("numeric_stats", "EDA7", sql=" UNION ALL ".join(_num(c) for c in NUMERIC))
def numeric_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = p.numeric_stats(table(spark, folder, "lineitem"), NUMERIC)
    return s.select("column", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", F.round("sum", 2).alias("sum"))


@register(
    "column_medians", "EDA7", "EDA4",
    sql=" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({x} AS DOUBLE) AS p, round(quantile_cont({c}, {x}), 6) AS value FROM lineitem""" for c in NUMERIC for x in (0.25, 0.5, 0.75)),
)
def column_medians(spark: SparkSession, folder: str) -> DataFrame:
    return p.exact_quantiles(table(spark, folder, "lineitem"), NUMERIC, [0.25, 0.5, 0.75]).withColumn("value", F.round("value", 6))


@register(
    "ranked_quantiles", "EDA1", "EDA4",
    sql=" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({x} AS DOUBLE) AS p, round(quantile_cont({c}, {x}), 6) AS value FROM orders""" for c in ("o_totalprice", "o_custkey") for x in (0.1, 0.25, 0.5, 0.75, 0.99)),
)
def ranked_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """The path for columns with very many distinct values, forced."""
    found = p.exact_quantiles(table(spark, folder, "orders"), ["o_totalprice", "o_custkey"], [0.1, 0.25, 0.5, 0.75, 0.99])
    return found.withColumn("value", F.round("value", 6))


@register(
    "describe_table", "EDA1",
    sql=" UNION ALL ".join(
        [f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM lineitem""" for c in NUMERIC]
        + [f"""SELECT '{c}', sum(n)::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), min_by(v, (-n, v)), max(n) FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1)""" for c in WORDS]
    ),
)
def describe_table(spark: SparkSession, folder: str) -> DataFrame:
    d = p.describe(table(spark, folder, "lineitem"), NUMERIC, WORDS)
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@register(
    "iqr_outliers", "EDA2",
    sql="""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
)
def iqr_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return p.outliers(table(spark, folder, "events").select("event_id", "value"), "value")


@register(
    "outlier_counts", "EDA2", "EDA10",
    sql=" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS n_outliers FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem)""" for c in NUMERIC),
)
def outlier_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p.outlier_counts(table(spark, folder, "lineitem").select(*NUMERIC), NUMERIC)


@register(
    "histogram40", "EDA3",
    sql="""WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 40 AS w FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / w), 39) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1""",
)
def histogram40(spark: SparkSession, folder: str) -> DataFrame:
    return p.histogram(table(spark, folder, "orders").select("o_totalprice"), "o_totalprice")


@register(
    "box_plot", "EDA4",
    sql="""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events)
SELECT min(value) AS min, round(any_value(a), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q3, max(value) AS max, min(value) FILTER (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS lower_whisker,
  max(value) FILTER (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS upper_whisker, count(*) FILTER (NOT value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS n_outliers FROM events, q""",
)
def box_plot(spark: SparkSession, folder: str) -> DataFrame:
    b = p.box(table(spark, folder, "events").select("value"), "value")
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@register(
    "composition", "EDA5",
    sql="SELECT event_type AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1",
)
def composition(spark: SparkSession, folder: str) -> DataFrame:
    return p.composition(table(spark, folder, "events"), "event_type")


@register(
    "daily_series_filled", "EDA6",
    sql="""WITH s AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase' AND value > 40 GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(t, 0) AS total FROM (SELECT unnest(generate_series((SELECT min(day) FROM s), (SELECT max(day) FROM s), INTERVAL 1 DAY)) AS d) LEFT JOIN s ON s.day = CAST(d AS DATE)""",
)
def daily_series_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Large purchases: sparse enough to have days without any."""
    some = table(spark, folder, "events").filter("event_type = 'purchase' AND value > 40")
    return p.daily_series(some, "ts", F.round(F.col("value") * 100).cast("bigint")).withColumn("day", F.col("day").cast("string"))


@register(
    "daily_order_value", "EDA6",
    sql="""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS t FROM orders GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(t, 0) AS total FROM (SELECT unnest(generate_series((SELECT min(day) FROM s), (SELECT max(day) FROM s), INTERVAL 1 DAY)) AS d) LEFT JOIN s ON s.day = CAST(d AS DATE)""",
)
def daily_order_value(spark: SparkSession, folder: str) -> DataFrame:
    s = p.daily_series(table(spark, folder, "orders"), "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return s.withColumn("day", F.col("day").cast("string"))


@register("top5_categories", "EDA8", sql=_tops(5))
def top5_categories(spark: SparkSession, folder: str) -> DataFrame:
    return p.top_values(table(spark, folder, "lineitem"), WORDS, 5).withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "missing_share", "EDA9",
    sql=""" WITH d AS (SELECT d.doc_id, quality, CASE WHEN toxic = 1 THEN 1 END AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
""" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 100.0::DOUBLE ELSE 0.0 END), 6) AS missing_percent, avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0.0 END) > 50 AS flagged FROM d""" for c in ("doc_id", "quality", "toxic")),
)
def missing_share(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, 1).alias("toxic"))
    joined = table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")
    return p.missing_shares(joined).withColumn("missing_percent", F.round("missing_percent", 6))


@register(
    "table_overview", "EDA10",
    sql="""WITH o AS (""" + " UNION ALL ".join(f"""SELECT count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS n FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem)""" for c in NUMERIC) + """)
SELECT (SELECT count(*) FROM lineitem) AS total_rows, CAST(6 AS BIGINT) AS total_columns, CAST(4 AS BIGINT) AS numeric_columns, count(*) FILTER (n > 0) AS potential_issues FROM o""",
)
def table_overview(spark: SparkSession, folder: str) -> DataFrame:
    return p.overview(table(spark, folder, "lineitem").select(*NUMERIC, *WORDS), NUMERIC)


@register(
    "profile_sentences", "EDA11",
    sql=" UNION ALL ".join(
        [f"""SELECT '{c}' AS "column", '  - {c}: média=' || printf('%.2f', avg({c})) || ', min=' || printf('%.2f', min({c})) || ', max=' || printf('%.2f', max({c})) || ', total=' || printf('%.2f', sum({c})) AS line FROM lineitem""" for c in ("l_quantity", "l_tax")]
        + [f"""SELECT '{c}', '  - {c}: ' || count(*) || ' valores únicos, mais comum: ' || min_by(v, (-n, v)) || ' (' || max(n) || ' ocorrências)' FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1)""" for c in WORDS]
    ),
)
def profile_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return p.insight_lines(table(spark, folder, "lineitem"), ["l_quantity", "l_tax"], WORDS)
