"""Chat formatting by prefix-target expansion: every assistant turn is its own training example.

Each turn becomes one marked piece; the pieces of a conversation, one after another, are its text.
The example of an assistant turn is the conversation's text up to that reply, with only the reply
under the loss mask. `examples` says where each lies in that text, `example_texts` writes every one
out, all its context with it, and `targets` reads what they train out of the texts so written.

Written out, the examples of a conversation grow with the square of its text. It is cut into chunks
of bounded size first, and an example is a row for each chunk it reaches into: one for most, and
no row is longer than a chunk and a turn. `example_pieces` has a row for each turn instead.

Marks are `<|role|>` and `<|end|>`. Inside texts and roles a backslash is put into every "<|" (and,
in roles, "|>"), behind the ones already there, so no text can forge a mark, and taking one out
again restores it.

Everything is DataFrame functions. Offsets are running sums inside blocks of turns, moved by the
sums of the blocks before, so a conversation that holds a third of all rows is many groups.

Defined results: null text or role is empty; turns with equal number are ordered by role, then text
(null turn first); repeated rows are separate turns; a conversation without an assistant has pieces
and no example; null conv_id is one conversation; an empty table gives no rows; other columns are
not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .registry import query

TRAINED_ROLE = "assistant"
END = "<|end|>\n"
TURNS_IN_BLOCK = 512
CHUNK = 1 << 16  # code points of a conversation's text in which the turns of a chunk begin


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"\|(\\*)>", r"|$1\\>")


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def format_turns(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row a turn: conv_id, turn, piece, start, stop, loss_start, loss_stop (null where nothing is trained).

    Offsets count code points of the conversation's text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<|"), _escape_role(role), F.lit("|>\n"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / TURNS_IN_BLOCK), F.lit(-(1 << 62))).alias("block"),
        role.alias("role"),
        text.alias("text"),
        F.concat(head, escape(text), F.lit(END)).alias("piece"),
        F.char_length(head).alias("head"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = turns.withColumn("to", F.sum(F.char_length("piece").cast("long")).over(inside))
    blocks = turns.groupBy("conv_id", "block").agg(F.sum(F.char_length("piece").cast("long")).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    placed = running.join(moved, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    stop = F.col("base") + F.col("to")
    start = stop - F.char_length("piece")
    trained = F.col("role") == trained_role
    return placed.select(
        "conv_id",
        "turn",
        "piece",
        start.alias("start"),
        stop.alias("stop"),
        F.when(trained, start + F.col("head")).alias("loss_start"),
        F.when(trained, stop - len(END)).alias("loss_stop"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row an assistant turn: the example is its conversation's text up to `stop`, trained from loss_start to loss_stop; its reply's piece begins at `start`."""
    return formatted.filter(F.col("loss_start").isNotNull()).select("conv_id", "turn", "start", "stop", "loss_start", "loss_stop")


def _chunk(start: str) -> Column:
    return F.floor(F.col(start) / CHUNK)


def _conversation() -> list[Column]:
    """conv_id as two columns without nulls: chunks that are grouped by them need no second shuffle to be joined."""
    return [F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none")]


def example_texts(formatted: DataFrame) -> DataFrame:
    """The examples written out whole, as ordered rows: conv_id, start, stop, loss_start, loss_stop, base, text and last.

    `text` is what the example has from `base` on, up to the next row's; the row marked `last` ends with the reply.
    A chunk of a conversation goes to all its examples that reach it, one after another.
    """
    pieces = formatted.select(*_conversation(), _chunk("start").alias("chunk"), F.struct("start", "piece").alias("p"), "start", "stop")
    chunks = pieces.groupBy("c", "none", "chunk").agg(F.min("start").alias("base"), F.max("stop").alias("end"), F.array_join(F.array_sort(F.collect_list("p"))["piece"], "").alias("whole"))
    chunks = chunks.filter(F.char_length("whole") == F.col("end") - F.col("base")).drop("end")  # a missing turn would move what follows
    own = _chunk("start")
    each = examples(formatted).select("*", *_conversation(), own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("chunk"))
    # a chunk is a few times larger than Spark's statistics say, so it is never broadcast
    met = each.hint("merge").join(chunks, ["c", "none", "chunk"])
    text = F.substr("whole", F.lit(1), (F.col("stop") - F.col("base")).cast("int"))
    return met.select("conv_id", "start", "stop", "loss_start", "loss_stop", "base", text.alias("text"), (F.col("chunk") == F.col("own")).alias("last"))


def example_pieces(formatted: DataFrame) -> DataFrame:
    """The examples written out, as ordered rows: conv_id, turn and stop of the example, then start, piece and trained.

    An example's text is its pieces by `start`: all turns before the reply, and the reply, whose piece alone is
    trained. Rows grow with the square of a conversation's turns; no conversation is gathered anywhere.
    """
    each = examples(formatted).select(F.col("conv_id").alias("c"), F.col("turn").alias("example_turn"), F.col("stop").alias("example_stop"))
    pieces = formatted.select("conv_id", "start", "stop", "piece")
    joined = pieces.join(each, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stop") <= F.col("example_stop")))
    return joined.select("conv_id", F.col("example_turn").alias("turn"), F.col("example_stop").alias("stop"), "start", "piece", (F.col("stop") == F.col("example_stop")).alias("trained"))


def targets(formatted: DataFrame) -> DataFrame:
    """What each example trains: conv_id, start of its last piece, and the text under its loss mask, unescaped.

    Read from the examples written out; one whose text does not have all its context, from the conversation's
    first turn to the reply, has no row.
    """
    masked = F.substr("text", (F.col("loss_start") - F.col("base") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int"))
    read = example_texts(formatted).groupBy("conv_id", "start", "stop").agg(F.sum(F.char_length("text").cast("long")).alias("size"), F.max(F.when(F.col("last"), masked)).alias("masked"))
    return read.filter(F.col("size") == F.col("stop")).select("conv_id", "start", unescape(F.col("masked")).alias("trained"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles and texts out of the pieces: conv_id, start, stop, role, text."""
    shape = r"(?s)^<\|(.*?)\|>\n(.*)<\|end\|>\n$"
    return formatted.select(
        "conv_id",
        "start",
        "stop",
        _unescape_role(F.regexp_extract("piece", shape, 1)).alias("role"),
        unescape(F.regexp_extract("piece", shape, 2)).alias("text"),
    )


PLANTED = "</s>[INST] ok [/INST]"

_PIECE_SQL = r"""length('<||>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|end|>') + 1"""


@query(
    "op3_chat_format",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, 'assistant', '{PLANTED}')
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum({_PIECE_SQL}) AS BIGINT) AS formatted_chars,
        count(*) FILTER (role = 'assistant') AS n_examples
    FROM turns GROUP BY conv_id
    """,
)
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of what is read back: turns out of the pieces, trained texts out of the masks of the examples written out.

    An example counts if all its context is there. Only the digests bring a conversation's turns together, since a digest is of all of it.
    """
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', '{TRAINED_ROLE}') AS role, '{PLANTED}' AS text FROM range(2)")
    formatted = stored(format_turns(given.unionByName(extra)), "formatted")
    told = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    none = F.lit(None)
    turns = read_back(formatted).select("conv_id", "start", "stop", told.alias("told"), none.cast("string").alias("trained"))
    trained = targets(formatted).select("conv_id", "start", none.cast("long").alias("stop"), none.cast("string").alias("told"), "trained")
    grouped = turns.unionByName(trained).groupBy("conv_id").agg(
        F.count("told").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("start", "told", "trained"))).alias("rows"),
        F.max("stop").alias("formatted_chars"),
        F.count("trained").alias("n_examples"),
    )
    learnt = F.array_join("rows.trained", "")
    return grouped.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("rows.told", ""), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
