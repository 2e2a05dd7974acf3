"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Each document gets text statistics (one pass of numpy over Arrow slices, no shuffle). From labelled
documents a list of rules is learned: grow a conjunction of thresholds on two thirds of the rows by
information gain, prune its last conditions on the other third, keep it if it is precise there, take
the covered rows away, and go on. The list becomes one ordered Spark CASE expression.

Defined results: null or empty text has no words, so the base check fails it; repeated rows are
judged alike, each on its own; an empty table gives an empty table; without usable labels the list
is empty and everything that passes the base check is kept; clashing column names are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import IS_SPACE, Words, slices
from .common import free_name, table
from .registry import query

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words"]
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
REPEAT_WINDOW = 8


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SYMBOLS = _mask(b"#*$%&|<>")
UPPER = _mask(bytes(range(65, 91)))
DIGITS = _mask(b"0123456789")
MARKS = _mask(b".,;:!?")
CONTINUES = _mask(bytes(range(0x80, 0xC0)))
NEWLINE = _mask(b"\n")


def _repeated(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text: words that lie in windows found twice or more, the first one included."""
    at, value = words.windows(hashes, REPEAT_WINDOW)
    found = np.zeros(words.n, np.int64)
    doc = words.doc[at]
    edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))) if len(doc) else np.zeros(1, np.int64)
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        ordered = np.sort(value[a:b])
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(value[a:b], twice))
            change = np.zeros(b - a + REPEAT_WINDOW + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + REPEAT_WINDOW, -1)
            found[doc[a]] = np.count_nonzero(np.cumsum(change) > 0)
    return found


def _distinct(doc: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    if not len(doc):
        return np.zeros(n, np.int64)
    pairs = np.unique(doc * (int(number.max()) + 1) + number)
    return np.bincount(pairs // (int(number.max()) + 1), minlength=n).astype(np.int64)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of one slice."""
    words = Words(column)
    data = words.data
    word_bytes = ~IS_SPACE[data]
    starts, ends, doc = words.pieces(NEWLINE[data])
    total = np.concatenate(([0], np.cumsum(word_bytes)))
    worded = total[ends] > total[starts]
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    lines = np.bincount(doc, minlength=words.n).astype(np.int64)
    numbers = words.spans(starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = words.hashes()
    short = hashes >> np.uint64(24)  # 40 bits leave room for the text's number
    return {
        "n_words": words.counts,
        "word_chars": words.sums(word_bytes & ~CONTINUES[data]),
        "n_symbols": words.sums(SYMBOLS[data]),
        "n_dup_lines": lines - _distinct(doc, numbers, words.n),
        "n_repeat_words": _repeated(words, hashes),
        "n_lines": lines,
        "n_upper": words.sums(UPPER[data]),
        "n_digits": words.sums(DIGITS[data]),
        "n_marks": words.sums(MARKS[data]),
        "n_distinct_words": np.bincount(np.unique((words.doc.astype(np.uint64) << np.uint64(40)) | short) >> np.uint64(40), minlength=words.n).astype(np.int64),
    }


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """Adds a struct of counts; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            counts = statistics(part.column(text))
            struct = pa.StructArray.from_arrays([pa.array(counts[c]) for c in COUNTS], COUNTS)
            yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, STATS)]))


def base_failed(stats: str) -> Column:
    return (F.col(f"{stats}.n_words") < 20) | (100 * F.col(f"{stats}.n_repeat_words") > 30 * F.col(f"{stats}.n_words"))


def features(stats: str) -> dict[str, Column]:
    """What conditions may be put on: ratios, so that a rule means the same at any length."""
    of = {c: F.col(f"{stats}.{c}").cast("double") for c in COUNTS}
    per_word, per_char, per_line = F.greatest(of["n_words"], F.lit(1.0)), F.greatest(of["word_chars"], F.lit(1.0)), F.greatest(of["n_lines"], F.lit(1.0))
    return {
        "words": of["n_words"],
        "word_length": of["word_chars"] / per_word,
        "symbols_per_word": of["n_symbols"] / per_word,
        "dup_line_share": of["n_dup_lines"] / per_line,
        "repeat_share": of["n_repeat_words"] / per_word,
        "words_per_line": of["n_words"] / per_line,
        "upper_share": of["n_upper"] / per_char,
        "digit_share": of["n_digits"] / per_char,
        "marks_per_word": of["n_marks"] / per_word,
        "distinct_share": of["n_distinct_words"] / per_word,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return columns[self.feature] > self.threshold if self.above else columns[self.feature] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > F.lit(self.threshold) if self.above else of[self.feature] <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covered(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(columns)
    return out


def _best_condition(columns: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest information gain for the bad rows it keeps."""
    p, n = int(bad.sum()), len(bad)
    before = np.log2(p / n)
    best, choice = 0.0, None
    for name in columns:
        order = np.argsort(columns[name], kind="stable")
        value, is_bad = columns[name][order], bad[order]
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        low_bad, low = np.cumsum(is_bad)[cut], cut + 1
        for above, got, size in ((False, low_bad, low), (True, p - low_bad, n - low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(got > 0, got * (np.log2(got / size) - before), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, choice = float(gain[k]), Condition(name, above, float((value[cut[k]] + value[cut[k] + 1]) / 2))
    return best, choice


def learn(columns: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 3) -> list[Rule]:
    """Sequential covering with pruning. Every third row, in the order given, is for pruning."""
    rules: list[Rule] = []
    alive = np.ones(len(bad), bool)
    pruning = np.arange(len(bad)) % 3 == 2
    while len(rules) < max_rules:
        grow = np.flatnonzero(alive & ~pruning)
        rule: list[Condition] = []
        inside = grow
        while len(rule) < max_conditions and 0 < bad[inside].sum() < len(inside):
            gain, condition = _best_condition({k: v[inside] for k, v in columns.items()}, bad[inside])
            if condition is None:
                break
            rule.append(condition)
            inside = inside[condition.holds({k: v[inside] for k, v in columns.items()})]
        if not rule:
            break
        check = np.flatnonzero(alive & pruning)
        held = {k: v[check] for k, v in columns.items()}

        def worth(length: int) -> tuple[float, int]:
            hit = covered(tuple(rule[:length]), held, len(check))
            got, size = int(bad[check][hit].sum()), int(hit.sum())
            return ((2 * got - size) / size if size else -1.0), -length

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        hit = covered(tuple(rule), columns, len(bad)) & alive
        for rows in (hit & pruning, hit):  # precise on rows it was not grown on, and over all
            if rows.sum() and bad[rows].mean() < min_precision:
                return rules
        if (hit & bad).sum() < min_covered:
            break
        rules.append(tuple(rule))
        alive &= ~hit
        if not bad[alive].any():
            break
    return rules


def decision(rules: list[Rule], stats: str) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    of = features(stats)
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        conjunction = F.lit(True)
        for condition in rules[number - 1]:
            conjunction = conjunction & condition.column(of)
        out = F.when(conjunction, F.lit(number)).otherwise(out)
    return out


MAX_LABELLED = 20_000


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learns from at most `max_labelled` labelled documents, those whose ids hash lowest.

    The bound holds for what reaches the driver: ten numbers a row. Rows that fail the base check
    are left out, since no rule is needed for them.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = with_statistics(joined).filter(~base_failed("stats"))
    of = features("stats")
    rows = counted.select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *[c.alias(k) for k, c in of.items()]).orderBy("h", "doc_id").limit(max_labelled).toPandas()
    if not len(rows):
        return []
    return learn({k: rows[k].to_numpy(float) for k in of}, rows["quality"].to_numpy() == 0, **options)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> tuple[DataFrame, str]:
    """`docs` with a struct column of counts, `base_failed`, `rule` and `kept`; and that column's name."""
    name = free_name(docs, "quality_stats")
    counted = with_statistics(docs, text, name)
    failed, rule = base_failed(name), decision(rules, name)
    verdict = F.struct(f"{name}.*", failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept"))
    return counted.withColumn(name, verdict), name


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: what the base check or a learned rule rejects goes."""
    rules = fit(docs, table(spark, folder, "labels"))
    judged, name = judge(docs, rules)
    return judged.filter(F.col(f"{name}.kept")).drop(name)


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged, name = judge(docs, fit(docs, table(spark, folder, "labels")))
    return judged.select("doc_id", *[F.col(f"{name}.{c}").alias(c) for c in COUNTS[:5]], F.col(f"{name}.base_failed").alias("base_failed"), F.col(f"{name}.rule").alias("rule"), F.col(f"{name}.kept").alias("kept"))
