"""Chat histories as tables: one row per message, one row per document a message cites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_space
from .relate import latest


def first_messages(messages: DataFrame, n: int) -> DataFrame:
    """The n oldest messages of every session; Spark limits each session before the shuffle."""
    order = Window.partitionBy("session_id").orderBy("created_at", "message_id")
    return messages.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def context_window(messages: DataFrame, read: int = 50, shown: int = 10) -> DataFrame:
    """Text of the last `shown` among the first `read` messages; at most `shown` rows meet per session."""
    head = first_messages(messages, read)
    last = Window.partitionBy("session_id").orderBy(F.desc("position"))
    tail = head.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= shown)
    speaker = F.when(F.col("message_type") == "user", "Usuário").otherwise("Assistente")
    line = F.concat(F.lit("["), speaker, F.lit("]: "), trim_space(F.coalesce("content", F.lit(""))))
    gathered = tail.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("m"))
    return gathered.select(
        "session_id", F.size("m").cast("bigint").alias("n_shown"), F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("context")
    )


def newest_first(messages: DataFrame, n: int = 10) -> DataFrame:
    """The n newest messages of every session, newest first; Spark limits each session before the shuffle."""
    order = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    return messages.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def mentions(cited: DataFrame) -> DataFrame:
    """Distinct suppliers, registrations and types per session, in long form: a session may cite any number."""
    kinds = F.array(
        F.struct(F.lit("supplier").alias("kind"), F.col("issuer_name").alias("value")),
        F.struct(F.lit("cnpj").alias("kind"), F.col("issuer_cnpj").alias("value")),
        F.struct(F.lit("type").alias("kind"), F.col("document_type").alias("value")),
    )
    long = cited.select("session_id", F.explode(kinds).alias("k")).select("session_id", "k.*")
    return long.filter("value IS NOT NULL AND value <> ''").distinct()


def session_facts(cited: DataFrame, messages: DataFrame, topics: int = 3, width: int = 80) -> DataFrame:
    """Error count and last topics per session."""
    errors = cited.groupBy("session_id").agg(F.count_if(F.col("validation_status") == "error").alias("n_errors"))
    last = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    tail = messages.filter("content <> ''").withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= topics)
    heads = tail.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.left("content", F.lit(width)).alias("t")))).alias("m")
    )
    text = F.array_join(F.transform("m", lambda x: x["t"]), ", ")
    joined = heads.join(errors, "session_id", "left")
    return joined.select("session_id", F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("n_errors"), text.alias("topics"))


def recurring_errors(cited: DataFrame) -> DataFrame:
    """Issuers with more than one failed document in the same session."""
    failed = cited.filter("validation_status = 'error' AND issuer_cnpj IS NOT NULL")
    return failed.groupBy("session_id", "issuer_cnpj").agg(F.count("*").alias("n_errors")).filter("n_errors > 1")


def last_cited(cited: DataFrame) -> DataFrame:
    """Documents of the most recent assistant message that cites any."""
    answers = cited.filter("message_type = 'assistant'")
    newest = latest(answers.select("session_id", "message_id", "created_at"), ["session_id"], F.desc("created_at"), F.desc("message_id"))
    return answers.join(newest.select("session_id", "message_id"), ["session_id", "message_id"], "left_semi")


def with_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max("created_at").alias("last_at"))
    return sessions.join(counts, "session_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("bigint"))
