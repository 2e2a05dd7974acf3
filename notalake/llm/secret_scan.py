"""Secret scans: known shapes, and strings too random to be text.

Known shapes are three patterns (`assign`, `access`, `hex`), leftmost and not overlapping per kind.

Beyond them every run of 20 or more letters, digits and coding signs is a candidate. Its encoding is
inferred (hex, base32, base64, base64url), and its characters, as places in that alphabet, take four
tests: chi-squared uniformity over the alphabet, runs above and below the middle, correlation of
neighbours, and runs of one kind of character (small, capital, digit, sign). The last three must agree
with randomness: words joined by capitals or signs, as in identifiers and paths, are even enough but keep
one kind for long. The chi-squared value is turned into the chance that ordinary text of that length is as
even, and over all candidates of a length band the chances of those that agree are cut by false-discovery
control (Benjamini-Hochberg, on a fine histogram of their logs), so short strings, where the tests see
little, must be more even than long ones. UUIDs are names and no candidates.

All of it is DataFrame functions. Texts are read twice: once for the histogram, which has a bounded
number of rows, and once for the spans.

Defined results: null text is empty; repeated rows are scanned each on its own; a text of any length
is scanned whole; an empty table gives an empty table; clashing column names are left alone. Offsets
count code points, the end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import computed_once
from .common import free_name, table
from .registry import query

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of one class is matched whole or not at all, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encoding, what its strings look like, alphabet, and by how much ordinary text of that look is less
#: even than chance: alphabet size times the sum of squared frequencies, less 1 (letters 0.066, digits 0.1).
ENCODINGS: list[tuple[str, str, str, float]] = [
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef", 0.6),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.6),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", 1.1),
    ("base64", r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/", 3.2),
    ("base64url", r".", UPPER + LOWER + DIGITS + "-_", 3.2),
]
BANDS = [20, 32, 64, 128]
ALPHA = 0.05  # false discoveries among what is flagged
AGREES, AGREES_LOW = 3.290527, 3.090232  # largest deviation of the other tests, of p 0.001: both ways, and one way
UUID = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
SIGNS = "+/-_"
BIN, BINS = 0.05, 800  # of -log10 p


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """Sums of the array's values before each place; in chunks, so that the work is not square in its length."""
    size = 256
    n = F.size(lengths)
    places = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(places, lambda c: F.slice(lengths, c * size + 1, F.lit(size)))

    def placed(parts: Column, sums: Column) -> Column:
        inside: Callable[[Column, Column], Column] = lambda part, base: F.transform(part, lambda x, j: base + total(F.slice(part, F.lit(1), j)))
        return F.flatten(F.transform(parts, lambda part, c: let(total(F.slice(sums, F.lit(1), c)), lambda base: inside(part, base))))

    return let(chunks, lambda parts: let(F.transform(parts, total), lambda sums: placed(parts, sums)))


MATCH = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"


def matches(text: Column, pattern: str, kind: str, group: int = 0, hint: Column | None = None) -> Column:
    """Leftmost matches that do not overlap: start, kind, stop, and the wanted group's text.

    Positions follow from the lengths of the matches and of the texts between them. `hint` is a cheap
    condition without which there is no match.
    """
    size: Callable[[Column], Column] = lambda array: F.transform(array, lambda x: F.char_length(x).cast("long"))
    extract: Callable[[int], Column] = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def rows(gaps: Column, found: Column) -> Column:
        zipped = F.arrays_zip(gaps.alias("gap"), running(gaps).alias("gaps"), found.alias("own"), running(found).alias("owns"), extract(group).alias("value"))
        inner = F.filter(zipped, lambda z: z["own"].isNotNull())  # one gap more than matches
        return F.transform(
            inner,
            lambda z: F.struct(
                (z["gaps"] + z["gap"] + z["owns"]).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (z["gaps"] + z["gap"] + z["owns"] + z["own"]).alias("stop"),
                z["value"].alias("value"),
            ),
        )

    all_rows = let(size(F.split(text, pattern, -1)), lambda gaps: let(size(extract(0)), lambda found: rows(gaps, found)))
    present = F.regexp_like(text, F.lit(pattern))
    return F.when(present if hint is None else hint & present, all_rows.cast(MATCH)).otherwise(F.array().cast(MATCH))


def base_spans(text: Column) -> Column:
    signs = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    assign = F.filter(matches(text, ASSIGN, "assign", 2, signs), lambda m: F.char_length(m["value"]) >= 6)
    return F.array_sort(F.concat(assign, matches(text, ACCESS, "access", 0, F.contains(text, F.lit("AKIA"))), matches(text, HEX, "hex")))


#: Chebyshev fit of the logarithm of erfc(x) * exp(x * x) * (1 + x / 2) for x >= 0, by powers of 1 / (1 + x / 2).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def rarity(z: Column) -> Column:
    """-log10 of the normal distribution's lower tail, within 1e-6; taken in logs, so it is finite for every z."""

    def power(t: Column) -> Column:
        out = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            out = c + t * out
        return out

    tail = let(1 / (1 + F.abs(z) / (2 * math.sqrt(2))), lambda t: F.ln(t) + power(t) - z * z / 2 - math.log(2))
    return let(tail, lambda logs: F.when(z <= 0, -logs).otherwise(-F.log1p(-F.exp(logs))) / math.log(10))


def _by_encoding(value: Column, of: Callable[[str, float], Column]) -> Column:
    out = None
    for _, look, alphabet, excess in reversed(ENCODINGS):
        result = of(alphabet, excess)
        out = result if out is None else F.when(F.regexp_like(value, F.lit(look)), result).otherwise(out)
    return out


def _evenness(body: Column, alphabet: str, excess: float) -> Column:
    """How far the chi-squared value lies from that of ordinary text, in its standard deviations."""
    k, length = len(alphabet), F.char_length(body).cast("double")
    squares = F.aggregate(F.split(F.lit(alphabet), ""), F.lit(0.0), lambda a, c: a + F.pow(F.char_length(body) - F.char_length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
    return (squares * k / length - length - (k - 1) - length * excess) / F.sqrt(2 * (k - 1) + 4 * length * excess)


def _few_changes(body: Column, alphabet: str) -> Column:
    """By how many standard deviations the kind of character changes less often than it would by chance; scaled to the two-sided limit."""
    shares = [sum(c in kind for c in alphabet) / len(alphabet) for kind in (LOWER, UPPER, DIGITS, SIGNS)]
    p, q = 1 - sum(x * x for x in shares), sum(x * (1 - x) ** 2 for x in shares)
    kinds = F.translate(body, LOWER + UPPER + DIGITS + SIGNS, "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4)
    changes = F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    pairs = F.char_length(body).cast("double") - 1
    spread = F.sqrt(pairs * (p - p * p) + 2 * (pairs - 1) * (q - p * p))
    return (pairs * p - changes) / spread * (AGREES / AGREES_LOW)


def _disagreement(v: Column) -> Column:
    """Larger deviation of the runs test and the test of neighbours' correlation, of numbers around zero."""

    def tests(n: Column, high: Column, centre: Column, pairs: Column) -> Column:
        low = n - high
        mean = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        changes = F.size(F.filter(pairs, lambda p: (p["a"] > 0) != (p["b"] > 0))).cast("double")
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre))
        joint = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - centre) * (p["b"] - centre))
        return F.greatest(F.abs((changes + 1 - mean) / spread), F.when(square > 0, F.abs(joint / square * F.sqrt(n))).otherwise(F.lit(99.0)))

    pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = F.size(F.filter(v, lambda x: x > 0)).cast("double")
    centre = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return let(pairs, lambda p: let(high, lambda h: let(centre, lambda c: tests(F.size(v).cast("double"), h, c, p))))


def battery(value: Column) -> Column:
    """Of a candidate: its length without padding, -log10 of the chance that text is as even, and the largest deviation of the other tests."""

    def of(body: Column) -> Column:
        places = _by_encoding(value, lambda alphabet, _: F.transform(F.split(body, ""), lambda c: (F.instr(F.lit(alphabet), c) - (len(alphabet) + 1) / 2).cast("double")))
        even = let(_by_encoding(value, lambda alphabet, excess: _evenness(body, alphabet, excess)), rarity)
        few = _by_encoding(value, lambda alphabet, _: _few_changes(body, alphabet))
        return F.struct(F.char_length(body).alias("length"), even.alias("even"), F.greatest(let(places, _disagreement), few).alias("off"))

    return let(F.regexp_replace(value, "=+$", ""), of)


def band(length: Column) -> Column:
    out = F.lit(BANDS[0])
    for edge in BANDS[1:]:
        out = F.when(length >= edge, F.lit(edge)).otherwise(out)
    return out


TESTED = "array<struct<start:bigint,kind:int,stop:bigint,value:string,test:struct<length:int,even:double,off:double>>>"


def candidates(text: Column) -> Column:
    named = F.filter(matches(text, CANDIDATE, "random"), lambda m: ~F.regexp_like(m["value"], F.lit(UUID)))
    return F.transform(named, lambda m: F.struct(m["start"], m["kind"], m["stop"], m["value"], battery(m["value"]).alias("test"))).cast(TESTED)


def thresholds(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> dict[int, float]:
    """Per length band, the least -log10 p that is a discovery: Benjamini-Hochberg over all candidates of the table.

    A candidate that the other tests reject counts with a p of 1.

    What comes to the driver is a histogram of at most BINS rows a band.
    """
    each = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("c"))
    binned = each.groupBy(band(F.col("c.test.length")).alias("band"), F.when(F.col("c.test.off") <= AGREES, F.least(F.floor(F.col("c.test.even") / BIN), F.lit(BINS))).otherwise(0).alias("bin")).count().collect()
    out = {}
    for edge in BANDS:
        counts = {r["bin"]: r["count"] for r in binned if r["band"] == edge}
        total, above, least = sum(counts.values()), 0, float("inf")
        for number in sorted(counts, reverse=True):
            above += counts[number]
            if 10 ** (-number * BIN) <= alpha * above / total:
                least = number * BIN
        out[edge] = least
    return out


def all_spans(text: Column, least: dict[int, float]) -> Column:
    """Struct of the known shapes' spans and of all spans, each by start, then kind."""
    base = base_spans(text)

    def wanted(length: Column) -> Column:
        out = F.lit(least[BANDS[0]])
        for edge in BANDS[1:]:
            out = F.when(length >= edge, F.lit(least[edge])).otherwise(out)
        return out

    random = F.filter(candidates(text), lambda c: (c["test"]["even"] >= wanted(c["test"]["length"])) & (c["test"]["off"] <= AGREES))
    plain: Callable[[Column], Column] = lambda a: F.transform(a, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["stop"].alias("stop")))
    return F.struct(plain(base).alias("base"), plain(random).alias("random"))


def scan(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> tuple[DataFrame, str]:
    """`docs` with a struct of arrays `base` and `all` of (start, kind, stop); and that column's name.

    A random span that meets a known shape's span is that secret already and not listed again.
    """
    name = free_name(docs, "secrets")
    scanned = computed_once(docs, name, all_spans(F.coalesce(F.col(text), F.lit("")), thresholds(docs, text, alpha)))
    added = F.filter(F.col(f"{name}.random"), lambda r: ~F.exists(F.col(f"{name}.base"), lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
    return scanned.withColumn(name, F.struct(F.col(f"{name}.base").alias("base"), F.array_sort(F.concat(F.col(f"{name}.base"), added)).alias("all"))), name


def written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


MASK = "[SECRET]"


def redact(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by one mark."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        new = F.concat(state["out"], F.array(F.concat(kept, F.lit(MASK))))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] >= state["at"], new).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, (s["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: secrets are replaced by a mark; every document stays, n_chars follows its text."""
    found, name = scan(docs)
    hit = F.size(F.col(f"{name}.all")) > 0
    text = F.when(hit, redact(F.col("text"), F.col(f"{name}.all"))).otherwise(F.col("text"))
    masked = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found, name = scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.col(f"{name}.base")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col(f"{name}.all")).alias("spans"))
