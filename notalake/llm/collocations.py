"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree.

1. Words are counted exactly per language. A word below the least count is in no candidate, so it
   cuts the text as a piece mark does.
2. Vertical partitioning. Prefixes are packed into groups whose occurrences fit a memory budget; a
   prefix above the budget is extended by the next word, and again where that is above it too.
3. Each group builds its part of the suffix tree by itself: its windows of at most `longest` words,
   sorted, are the leaves in order; a node is a run of leaves with the same prefix and its count the
   sum of their totals. Windows are combined in the tasks that read the texts, so a passage that is
   repeated a million times is one leaf a buffer.
4. Cuts, scores, containment and ranks are joins and aggregates over the nodes that are frequent enough.

Counts are exact up to the digests' 64 bits: words above the least count with equal digests end the job.

Defined results: null text is empty and gives nothing; null lang is `und`; repeated rows count each;
ties in the lowest-scoring cut go to the smallest first part, ties in rank to the phrase; fewer
candidates than asked for are all returned; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import Words, mix, slices
from .common import stored, table
from .registry import query
from .word_codes import CODED_WORDS, Codes, blobs, by_group, codes, numbered

MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?\n\x0b\x0c\r")] = True
SEPARATORS = MARKS.copy()
SEPARATORS[[0x20, 0x09]] = True
KEYS = ["k1", "k2", "k3", "k4"]


@dataclass(frozen=True)
class Mining:
    least: int = 30  # occurrences of a candidate
    longest: int = 4  # words
    contained: int = 80  # percent of a candidate's occurrences inside a longer one that drop it
    top: int = 2000  # a language
    budget: int = 1 << 20  # occurrences in one group
    buffer: int = 1 << 20  # windows a task combines at a time
    coded: int = CODED_WORDS


def _tags(part: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(part.column("lang").cast(pa.string()), "und")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, digest, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, tags = Words(part.column("text"), lower=True, separators=SEPARATORS), _tags(part)
            if len(words.starts):
                number, first, digests, spelled = numbered(words, tags)
                count = np.bincount(number, minlength=len(digests))
                yield pa.RecordBatch.from_arrays(
                    [tags.take(pa.array(first)), pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(digests.view(np.int64)), pa.array(count)], ["lang", "word", "digest", "n"]
                )

    each = docs.select("lang", "text").mapInArrow(run, "lang string, word string, digest long, n long")
    return each.groupBy("lang", "word", "digest").agg(F.sum("n").alias("n"))


def _leaves(table_of, how: Mining):
    """Windows of the texts as (group, blob) rows: the words' values and how often."""

    def flush(parts: list[list[np.ndarray]], known: Codes) -> pa.RecordBatch:
        keys = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        heads = np.flatnonzero(new)
        keys = [k[heads] for k in keys]
        # a prefix above the budget is dealt by its second word, and by the next where that is above it too
        deal = mix(keys[-1])
        for k in range(len(keys) - 2, 0, -1):
            deal = mix(keys[k] + np.where(known.split(keys[k]), deal, np.uint64(0)))
        return blobs(known.group(keys[0], deal), [*keys, np.diff(np.append(heads, len(order))).astype(np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Codes = table_of.value
        parts, held = [], 0
        for part in slices(batches, "text"):
            words = Words(part.column("text"), lower=True, separators=SEPARATORS)
            n = len(words.starts)
            if n < 2:
                continue
            number, _, digests, _ = numbered(words, _tags(part))
            value = known.values(digests)[number]
            marks = np.concatenate(([0], np.cumsum(MARKS[words.data])))
            go = np.zeros(n, bool)  # the next word belongs to the same phrase
            go[:-1] = (words.doc[1:] == words.doc[:-1]) & (marks[words.starts[1:]] == marks[words.ends[:-1]]) & (value[1:] > 0) & (value[:-1] > 0)
            columns, going = [value], np.ones(n, bool)
            for k in range(1, how.longest):
                going = going & np.append(go, np.zeros(k - 1, bool))[k - 1 :]
                columns.append(np.where(going, np.append(value, np.zeros(k, np.uint64))[k:], np.uint64(0)))
            keep = np.flatnonzero(columns[1])
            parts.append([c[keep] for c in columns])
            held += len(keep)
            if held >= how.buffer:
                yield flush(parts, known)
                parts, held = [], 0
        if held:
            yield flush(parts, known)

    return run


def _subtrees(table_of, how: Mining):
    """The nodes of each group's part of the tree that are frequent enough, or whose windows lie in several groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Codes = table_of.value
        for _, (*keys, count) in by_group(batches, how.longest + 1):
            order = np.lexsort(keys[::-1])
            keys, count = [k[order] for k in keys], count[order]
            new = np.ones(len(order), bool)
            new[1:] = keys[0][1:] != keys[0][:-1]
            spread = known.split(keys[0])
            for depth in range(1, how.longest):
                new[1:] |= keys[depth][1:] != keys[depth][:-1]
                spread &= known.split(keys[depth])
                heads = np.flatnonzero(new)
                total = np.add.reduceat(count, heads).astype(np.int64)
                keep = (keys[depth][heads] > 0) & ((total >= how.least) | (spread[heads] if depth + 1 < how.longest else False))
                at = heads[keep]
                columns = [(k[at] if d <= depth else np.zeros(len(at), np.uint64)).view(np.int64) for d, k in enumerate(keys)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(total[keep])], [*KEYS[: how.longest], "a"])

    return run


def phrases(docs: DataFrame, how: Mining) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (k1.. values of their words, 0 after the last; a), words (value, lang, word, a), and n by lang."""
    spark = docs.sparkSession
    counted = stored(word_counts(docs), "word-counts")
    frequent = counted.filter(F.col("n") >= how.least)
    if not frequent.groupBy("digest").count().filter("count > 1").isEmpty():
        raise ValueError("two frequent words have the same 64-bit digest")
    known = codes(frequent.select("digest", "n"), budget=how.budget, least=how.least, limit=how.coded, drop_rare=True)
    table_of = spark.sparkContext.broadcast(known)
    dealt = docs.select("lang", "text").mapInArrow(_leaves(table_of, how), "grp long, blob binary")
    names = KEYS[: how.longest]
    nodes = dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_subtrees(table_of, how), ", ".join(f"{k} long" for k in [*names, "a"]))
    found = nodes.groupBy(*names).agg(F.sum("a").alias("a")).filter(F.col("a") >= how.least)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = table_of.value.values(batch.column("digest").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column("lang"), batch.column("word"), batch.column("n")], ["value", "lang", "word", "a"])

    words = frequent.select("digest", "lang", "word", "n").mapInArrow(valued, "value long, lang string, word string, a long")
    return stored(found, "phrases"), stored(words, "words"), counted.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(names: list[str], first: int, last: int) -> list[Column]:
    """The values of words first..last-1, shifted to the front."""
    part = [F.col(n) for n in names[first:last]]
    return [*part, *[F.lit(0).cast("long")] * (len(names) - len(part))]


def collocations(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    names = KEYS[: how.longest]
    found, words, totals = phrases(docs, how)
    size = sum((F.when(F.col(k) != 0, 1).otherwise(0) for k in names), F.lit(0))
    candidates = found.withColumn("size", size)
    one = words.select(F.col("value").alias("k1"), *[F.lit(0).cast("long").alias(k) for k in names[1:]], "a")
    counts = found.unionByName(one)

    def side(name: str, count: str) -> DataFrame:
        return counts.select(F.struct(*names).alias(name), F.col("a").alias(count))

    def struct(columns: list[Column]) -> Column:
        return F.struct(*[c.alias(k) for c, k in zip(columns, names)])

    cuts = [
        F.when(F.col("size") > k, F.struct(F.lit(k).alias("cut"), struct(_part(names, 0, k)).alias("x"), struct(_part(names, k, how.longest)).alias("y"))) for k in range(1, how.longest)
    ]
    each = candidates.select(*names, "a", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select(*names, "a", "c.*")
    # products may pass 64 bits
    share = F.expr("(CAST(2000000 AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(20, 0))) div CAST(l + r AS DECIMAL(20, 0))")
    joined = each.join(side("x", "l"), "x").join(side("y", "r"), "y").withColumn("score", share)
    scored = joined.groupBy(*names, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = [
        F.when((F.col("size") >= last) & (F.col("size") > last - first), struct(_part(names, first, last)))
        for first in range(how.longest)
        for last in range(first + 2, how.longest + 1)
        if last - first < how.longest
    ]
    if inner:
        parts = candidates.filter("size > 2").select("a", F.explode(F.array_compact(F.array(*inner))).alias("p")).select("a", "p.*")
        longer = parts.groupBy(*names).agg(F.max("a").alias("longer"))
        scored = scored.join(longer, names, "left").filter(~F.coalesce(100 * F.col("longer") >= how.contained * F.col("a"), F.lit(False)))
    of_lang = scored.join(words.select(F.col("value").alias("k1"), "lang", F.col("word").alias("w1")), "k1").select("*", "best.score")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = of_lang.withColumn("at", F.rank().over(first)).filter(F.col("at") <= how.top)
    for k in names[1:]:
        near = near.join(words.select(F.col("value").alias(k), F.col("word").alias(f"w{k[1:]}")), k, "left")
    spelled = near.withColumn("phrase", F.concat_ws(" ", *[f"w{k[1:]}" for k in names]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= how.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
lists AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM lists),
windows AS (SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
grams AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a FROM windows GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM windows WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM windows WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM windows WHERE w4 IS NOT NULL GROUP BY ALL
),
totals AS (SELECT lang, sum(a) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM grams WHERE k >= 2 AND a >= 30),
places AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
cuts AS MATERIALIZED (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y FROM places),
scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, gx.a AS l, gy.a AS r, (2000000::HUGEINT * c.a) // (gx.a + gy.a) AS score
  FROM cuts c JOIN grams gx ON gx.lang = c.lang AND gx.phrase = c.x JOIN grams gy ON gy.lang = c.lang AND gy.phrase = c.y
),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
starts AS (SELECT lang, k, w, a, unnest(range(1, k)) AS i FROM candidates),
inner_parts AS (SELECT lang, w, a, i, unnest(range(2, k)) AS m, k FROM starts),
longer AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a FROM inner_parts WHERE i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
