"""Session helpers: settings the jobs rely on, and where lineage may be cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("notalake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# HotSpot does not compile methods above this many bytes of bytecode; a wide rule set fused into one
# method would run interpreted. Past the limit Spark splits the expressions into small methods instead.
JIT_METHOD_LIMIT = "8000"
SPARK_METHOD_LIMIT = "65535"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the jobs want, unless the caller chose their own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == SPARK_METHOD_LIMIT:
        spark.conf.set(key, JIT_METHOD_LIMIT)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster. A local session may do without and gets a scratch folder; elsewhere it is an error."""
    configured = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="notalake-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared location."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of the executors that made them."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """Rows of `df` if there are at most `limit`, else None. The only way data reaches the driver."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
