"""Profiling of arbitrary tables: statistics, exact quantiles, outliers, distributions, gaps.

Results are long tables, one row per column (or per column and value), so a table with any number of
columns has one result schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze

def long_values(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column, value) with NULLs kept."""
    return df.select(*[F.col(c).cast(kind).alias(c) for c in columns]).unpivot([], columns, "column", "value")


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std, min, max, sum. One pass over the table, one row per task is shuffled."""
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
            F.sum(F.col(c).cast("double")).alias("sum"),
        )
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """column, p, value: exact quantiles with linear interpolation, by global rank.

    Values are counted and range-partitioned, and only partitions that hold a wanted rank are looked
    into: no task sees more than a range of distinct values, whatever the table.
    """
    values = long_values(df, columns, "double").filter("value IS NOT NULL")
    counts = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    # Range boundaries are sampled, so the partitioning is written down before it is used twice.
    ranged = freeze(counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("column", "part").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    starts = sizes.select(
        "column", "part", "size", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("total")
    )
    wanted = starts.select("*", F.explode(F.array(*[F.lit(p) for p in probabilities])).alias("p")).withColumn(
        "position", F.col("p") * (F.col("total") - 1)
    )
    ranks = wanted.select("*", F.explode(F.array(F.floor("position"), F.ceil("position"))).alias("rank"))
    here = ranks.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size"))).distinct()
    # At most two ranks per column and probability.
    marks = here.select("column", "part", "before", "p", "position", "rank")
    touched = ranged.join(F.broadcast(marks.select("column", "part", "before").distinct()), ["column", "part"])
    running = Window.partitionBy("column", "part").orderBy("value")
    placed = touched.withColumn("upto", F.col("before") + F.sum("n").over(running))
    hit = placed.join(F.broadcast(marks.drop("before")), ["column", "part"]).filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    )
    ends = hit.groupBy("column", "p").agg(
        F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high"), F.max("position").alias("position")
    )
    share = F.col("position") - F.floor("position")
    return ends.select("column", "p", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("value"))


def _quartiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """One row a column: column, q25, q50, q75 as far as asked for."""
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"q{round(p * 100)}")
    return exact_quantiles(df, columns, probabilities).groupBy("column").agg(*[at(p) for p in probabilities])


def _fences(low: Column, high: Column, factor: float = 1.5) -> tuple[Column, Column]:
    return low - factor * (high - low), high + factor * (high - low)


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows outside 1.5 interquartile ranges; the bounds are scalar subqueries, so nothing meets in the driver."""
    bounds = _quartiles(df, [column], [0.25, 0.75])
    low, high = _fences(bounds.select("q25").scalar(), bounds.select("q75").scalar())
    return df.filter((F.col(column) < low) | (F.col(column) > high))


def box(df: DataFrame, column: str) -> DataFrame:
    """Five numbers, whiskers and the number of points outside, in one row."""
    marks = _quartiles(df, [column], [0.25, 0.5, 0.75])
    low, mid, high = (marks.select(q).scalar() for q in ("q25", "q50", "q75"))
    bottom, top = _fences(low, high)
    inside = F.col(column).between(bottom, top)
    marked = df.select(F.col(column).alias("v"), inside.alias("inside"))
    sums = marked.agg(
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.min(F.when(F.col("inside"), F.col("v"))).alias("lower_whisker"),
        F.max(F.when(F.col("inside"), F.col("v"))).alias("upper_whisker"),
        F.count_if(F.col("v").isNotNull() & ~F.col("inside")).alias("n_outliers"),
    )
    return sums.select("min", low.alias("q1"), mid.alias("median"), high.alias("q3"), "max", "lower_whisker", "upper_whisker", "n_outliers")


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls into the last bin."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin bigint, n bigint")
    width = (ends["hi"] - ends["lo"]) / bins or 1.0
    place = F.least(F.floor((F.col(column) - ends["lo"]) / width), F.lit(bins - 1)).cast("bigint")
    return df.filter(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def composition(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    # A scalar subquery: the values may be many, so they are not brought into one window.
    everything = df.agg(F.count("*").alias("n")).scalar()
    return counts.select("value", "n", F.round(F.col("n") * 100.0 / everything, 6).alias("percent"))


def daily_series(df: DataFrame, day: str, value: Column) -> DataFrame:
    """Sum per day; days without rows count 0. The calendar comes from the first and the last day."""
    sums = df.filter(F.col(day).isNotNull()).groupBy(F.col(day).cast("date").alias("day")).agg(F.sum(value).alias("total"))
    span = df.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b")).filter("a IS NOT NULL")
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return calendar.join(sums, "day", "left").select("day", F.coalesce("total", F.lit(0)).alias("total"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_values(df, columns, "string").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of every column; equal counts go by value."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def categorical_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, unique, top, freq. The number of distinct values is that of the grouped rows."""
    counted = value_counts(df, columns)
    best = F.struct(F.col("n").alias("n"))
    totals = counted.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.max(best)["n"].alias("freq"))
    top = top_values(df, columns, 1).select("column", F.col("value").alias("top"))
    return totals.join(top, "column").select("column", "count", "unique", "top", "freq")


def describe(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row per column with what applies to its kind; the rest is NULL."""
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    at = lambda p, name: F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
    wide = quartiles.groupBy("column").agg(at(0.25, "p25"), at(0.5, "p50"), at(0.75, "p75"))
    numbers = numeric_stats(df, numeric).drop("sum").join(wide, "column")
    return numbers.unionByName(categorical_stats(df, categorical), allowMissingColumns=True)


def missing_shares(df: DataFrame) -> DataFrame:
    """column, share of NULLs in percent, and whether it is above half."""
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_percent")) for c in df.columns])
    return row.select(F.explode(pairs).alias("m")).select("m.*").withColumn("flagged", F.col("missing_percent") > 50)


def outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, number of values outside the fences. Any number of columns: values and quartiles meet by column name.

    The quartiles are one row a column, no more than the plan itself has columns, and are broadcast.
    """
    low, high = _fences(F.col("q25"), F.col("q75"))
    values = long_values(df, columns, "double")
    joined = values.join(F.broadcast(_quartiles(df, columns, [0.25, 0.75])), "column", "left")
    outside = (F.col("value") < low) | (F.col("value") > high)
    return joined.groupBy("column").agg(F.count_if(F.coalesce(outside, F.lit(False))).alias("n_outliers"))


def overview(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Rows, columns, numeric columns and the number of issues (gaps above half, outliers)."""
    gaps = missing_shares(df).filter("flagged").select(F.lit(1).alias("issue"))
    spikes = outlier_counts(df, numeric).filter("n_outliers > 0").select(F.lit(1).alias("issue"))
    marked = df.select(F.lit(0).alias("issue")).groupBy("issue").count()
    issues = gaps.union(spikes).groupBy("issue").count()
    both = marked.union(issues)
    pick = lambda i: F.coalesce(F.max(F.when(F.col("issue") == i, F.col("count"))), F.lit(0))
    return both.agg(
        pick(0).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(len(numeric)).cast("bigint").alias("numeric_columns"),
        pick(1).alias("potential_issues"),
    )


def preview(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first rows under `order`, as position, column, value (text): a top-k of each task."""
    first = df.orderBy(*order).limit(n).select(F.row_number().over(Window.orderBy(*order)).alias("position"), *df.columns)  # n rows by now
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])
    return first.select("position", F.explode(pairs).alias("p")).select("position", "p.*")


def insight_lines(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Sentences about every column."""
    two = lambda c: F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))
    numbers = numeric_stats(df, numeric).select(
        "column",
        F.concat(
            F.lit("  - "), "column", F.lit(": média="), two("mean"), F.lit(", min="), two("min"), F.lit(", max="), two("max"), F.lit(", total="), two("sum")
        ).alias("line"),
    )
    words = categorical_stats(df, categorical).select(
        "column",
        F.concat(
            F.lit("  - "), "column", F.lit(": "), F.col("unique").cast("string"), F.lit(" valores únicos, mais comum: "), "top", F.lit(" ("),
            F.col("freq").cast("string"), F.lit(" ocorrências)"),
        ).alias("line"),
    )
    return numbers.union(words)
