"""Joins between documents and what hangs on them, and the upkeep of such tables.

No side is broadcast by hand unless its size is fixed by definition: Spark broadcasts what is small
by its statistics, and AQE splits skewed partitions of the rest. Latest-row choices use a ranked
window of limit 1, which Spark cuts down before the shuffle, so copies of a hot key never meet in
one task in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key under `order`."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """Last write wins; among equal versions the larger tie value."""
    return latest(current.unionByName(changes), keys, F.desc(version), F.desc(tie))


def keep_known(children: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(children whose parent exists, children in quarantine)."""
    ids = parents.select(key)
    return children.join(ids, key, "left_semi"), children.join(ids, key, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def cascade_delete_all(children: dict[str, tuple[DataFrame, str]], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every child table, given with its name for the key, without the rows of deleted parents."""
    gone = deleted.select(key).distinct()
    return {name: df.join(gone.withColumnRenamed(key, column), column, "left_anti") for name, (df, column) in children.items()}


def cascade_levels(levels: list[tuple[str, DataFrame, str, str]], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables below one another without what hangs on deleted rows, at any depth.

    levels, from the top: (name, table, its own key, its key to the level above). Only keys go from level
    to level; the plan has one anti-join a table.
    """
    gone, left = deleted.select(F.col(key).alias("_gone")).distinct(), {}
    for name, df, own, above in levels:
        left[name] = df.join(gone, F.col(above) == F.col("_gone"), "left_anti")
        gone = df.join(gone, F.col(above) == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone")).distinct()
    return left


def left_join_split(left: DataFrame, right: DataFrame, key: str, apart: list[str], least: int = 1_000_000) -> DataFrame:
    """`left` LEFT JOIN `right` on `key`, with the right rows of a heavy key split over many tasks.

    AQE can split a hot key only on the side that is kept, so here the heavy keys are found first: more
    than `least` rows and more than a ten-thousandth of all, so there are never more than ten thousand
    of them. Their right rows are dealt by `apart`, columns that tell rows apart, their left rows are repeated
    once a part; a heavy key always has a match, so that join is an inner one. All other keys join as usual.
    """
    counts = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    least = max(least, right.count() // 10_000)
    heavy = F.broadcast(counts.filter(F.col("_n") > least).select(key, F.ceil(F.col("_n") / least).cast("int").alias("_ways")))
    usual = left.join(heavy, key, "left_anti").join(right.join(heavy, key, "left_anti"), key, "left")
    repeated = left.join(heavy, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways")
    dealt = right.join(heavy, key).withColumn("_part", F.pmod(F.xxhash64(*apart), F.col("_ways")).cast("int")).drop("_ways")
    return usual.unionByName(repeated.join(dealt, [key, "_part"]).drop("_part"))


def append(df: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Adds rows to the table at `path`, and gives the whole table.

    A write that fails leaves no rows behind. With a `batch` name the rows have a folder of their own, and
    an append that is repeated under the same name, after a failure of what comes later, adds nothing twice.
    """
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewritten(df: DataFrame, keep: Column, path: str) -> DataFrame:
    """A new version of the table with only the rows to keep; the old one stays until its readers are done."""
    df.filter(F.coalesce(keep, F.lit(False))).write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_cached(candidates: DataFrame, cached: DataFrame, digest: str, *results: str) -> DataFrame:
    """Each digest of the candidates once, with `cached` saying whether a stored result serves, and the results themselves.

    Where the cache has several rows of a digest, the results are those of one row, the least.
    """
    if results:
        known = cached.groupBy(digest).agg(F.min(F.struct(*results)).alias("_r"), F.lit(True).alias("cached")).select(digest, "cached", "_r.*")
    else:
        known = cached.select(digest).distinct().withColumn("cached", F.lit(True))
    return candidates.select(digest).distinct().join(known, digest, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def unseen(candidates: DataFrame, cached: DataFrame, digest: str) -> DataFrame:
    """Only what the cache has no result for, each digest once."""
    return candidates.join(cached.select(digest), digest, "left_anti").dropDuplicates([digest])


def update_status(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    new = changes.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "seq") -> DataFrame:
    """Running number per key under `order`, without ever holding one key's rows in one task.

    `bucket` must not decrease along `order` (a day, an hour). Rows are numbered inside
    (key, bucket); the offset of a bucket is the number of rows of the same key in earlier buckets,
    summed over the bucket counts, which are one row per key and bucket.
    """
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = b.withColumn("_local", F.row_number().over(inner))
    # Null-safe, so rows without a key or a bucket keep their place as well.
    matched = [*keys, "_bucket"]
    other = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in matched], "_offset")
    joined = local.join(other, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in matched])
    numbered_rows = joined.withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
    return numbered_rows.drop("_bucket", "_local", "_offset", *[f"_o_{c}" for c in matched])


def first_source_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of match lists; a key found by several keeps the row of the first list."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    merged = tagged[0]
    for s in tagged[1:]:
        merged = merged.unionByName(s)
    return latest(merged, [key], F.asc("_source")).drop("_source")


def clamped_confidence(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).cast("decimal(3,2)")
