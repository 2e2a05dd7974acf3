"""Language-model scores: Katz backoff over n-grams of one and two words.

Counts come from all training texts. Of an n-gram seen r times, r <= 5, Good-Turing keeps the share d(r)
of its count; what that frees, and one further unseen event a context (so that no context is left
without), goes to what was not seen there:

    p(w)     = d(c(w)) c(w) / (N + 1), and the rest is shared evenly by the words never seen
    p(w | v) = d(c(vw)) c(vw) / (c(v) + 1)   where vw was seen
             = alpha(v) p(w)                 where only v was seen
             = p(w)                          else
    alpha(v) = (1 - sum of p(w | v) over the w seen after v) / (1 - sum of p(w) over the same w)

so each distribution sums to one exactly. How many words were never seen is estimated from the words
seen once and twice (n1 n1 / (2 n2), Chao's estimate, one at least). A text is its words and one end;
the end is also what the first word follows.

Work is dealt by context: a token goes with its context to a group of bounded weight (`word_codes`),
which counts the context's bigrams, stores them, and resolves the tokens whose bigram was seen. What
is left falls back recursively: it asks the context table for alpha and the unigram table for p(w).
Contexts above the budget are dealt over several groups by the next word; their sums are added up.
Frequent words travel as codes whose counts every task knows (at most `coded` of them); counts of all
others are joined. Discounts of bigrams are known only at the end, so tasks count tokens by r.

Defined results: null text is empty and has its end only; a null doc_id counts as an empty text for the
split; rows that repeat doc_id and text count each and are scored alike; with too few counts for
Good-Turing at a cutoff a lower one is taken, at last none; without training texts every token has
p(w) = 1; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import Words, mix, slices
from .common import shared_folder, stored, table
from .registry import query
from .word_codes import CODED_WORDS, LOOSE, Codes, blobs, by_group, codes, digest, numbered, pack

CUTOFF = 5  # counts above are kept whole
END = digest(b"")  # words are never empty


@dataclass(frozen=True)
class Model:
    budget: int = 1 << 20  # tokens in one group
    buffer: int = 1 << 20  # tokens a task deals out at a time
    coded: int = CODED_WORDS


def discounts(classes: list[int]) -> list[float]:
    """d(1..CUTOFF) from the number of n-grams seen 1, 2, .. CUTOFF + 1 times (Katz's form of Good-Turing)."""
    for k in range(CUTOFF, 0, -1):
        n = [0, *classes[: k + 1]]
        if min(n[1:]) == 0:
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        kept = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < d <= 1 for d in kept):
            return kept + [1.0] * (CUTOFF - k)
    return [1.0] * CUTOFF


@dataclass
class Unigrams:
    """What all tasks know of single words."""

    codes: Codes
    tokens: int
    types: int
    kept: list[float]

    def p(self, counts: np.ndarray) -> np.ndarray:
        """p(w) of words with these counts, none of them 0."""
        share = np.array([1.0, *self.kept])[np.where(counts <= CUTOFF, counts, 0)]
        return share * counts / (self.tokens + 1)


def unseen_types(classes: list[int]) -> int:
    """Estimated number of words never seen, from the number of words seen once and twice."""
    return max(1, -(-classes[0] ** 2 // (2 * max(classes[1], 1))))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc and key (which tell texts apart; the key's last bit is 1 for held-out texts), text."""
    key = F.xxhash64("doc_id", "text").bitwiseAND((1 << 31) - 1) * 2 + held_out().cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), key.alias("key"), "text")


def unigram_counts(docs: DataFrame) -> DataFrame:
    """digest, n: the training tokens, ends among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"), lower=True)
            index, _, digests, _ = numbered(words)
            count = np.bincount(index, minlength=len(digests))
            out = pa.array(np.append(digests, np.uint64(END)).view(np.int64)), pa.array(np.append(count, part.num_rows))
            yield pa.RecordBatch.from_arrays(list(out), ["digest", "n"])

    return docs.filter(~held_out()).select("text").mapInArrow(run, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n"))


def _tokens(part: pa.RecordBatch, known: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each token and the number of its text, and where the texts begin."""
    words = Words(part.column("text"), lower=True)
    index, _, digests, _ = numbered(words)
    value = np.empty(len(words.starts) + part.num_rows, np.uint64)
    text = np.repeat(np.arange(part.num_rows), words.counts + 1)
    first = np.cumsum(words.counts + 1) - words.counts - 1
    last = np.zeros(len(value), bool)
    last[first + words.counts] = True
    value[last] = known.values(np.array([END], np.uint64))[0]
    if len(index):
        value[~last] = known.values(digests)[index]
    return value, text, first


DOCUMENT = "kind string, doc_id long, doc long, key long, w long, n long, known long, base double"


def _documents(shared):
    """One row a text (tokens; known ones and base score as far as words have codes), and one for each other word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni: Unigrams = shared.value
        for part in slices(batches, "text"):
            value, text, first = _tokens(part, uni.codes)
            count = uni.codes.known(value)
            loose = value >= LOOSE
            base = np.where(loose, 0.0, np.log10((count + 1) / (uni.tokens + uni.types + 1)))
            total = lambda x: pa.array(np.add.reduceat(x, first))
            n, none = part.num_rows, lambda t, k: pa.nulls(k, t)
            columns = [part.column("doc_id"), part.column("doc"), part.column("key"), none(pa.int64(), n), total(np.ones(len(value), np.int64)), total((~loose).astype(np.int64)), total(base)]
            yield pa.RecordBatch.from_arrays([pa.array(["text"] * n), *columns], ["kind", "doc_id", "doc", "key", "w", "n", "known", "base"])
            if loose.any():
                pairs, many = np.unique(np.stack([text[loose].astype(np.uint64), value[loose]]), axis=1, return_counts=True)
                at, k = pa.array(pairs[0].astype(np.int64)), len(many)
                columns = [part.column("doc").take(at), part.column("key").take(at), pa.array(pairs[1].view(np.int64)), pa.array(many), none(pa.int64(), k), none(pa.float64(), k)]
                yield pa.RecordBatch.from_arrays([pa.array(["word"] * k), none(pa.int64(), k), *columns], ["kind", "doc_id", "doc", "key", "w", "n", "known", "base"])

    return run


def _dealt(shared, how: Model):
    """All tokens as (group, blob) rows: context, word, and the two numbers of the text."""

    def flush(parts: list[list[np.ndarray]], known: Codes) -> pa.RecordBatch:
        v, w, doc, key = (np.concatenate(c) for c in zip(*parts))
        # loose words apart, so that the others stay narrow
        order = np.argsort(w >= LOOSE, kind="stable")
        cut = int((w < LOOSE).sum())
        group = known.group(v, mix(w))
        both = [blobs(group[o], [c[o] for c in (v, w, doc, key)]) for o in (order[:cut], order[cut:]) if len(o)]
        return pa.Table.from_batches(both).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Codes = shared.value.codes
        parts, held = [], 0
        for part in slices(batches, "text"):
            value, text, _ = _tokens(part, known)
            before = np.concatenate((known.values(np.array([END], np.uint64)), value[:-1]))
            doc, key = (part.column(c).to_numpy().view(np.uint64)[text] for c in ("doc", "key"))
            parts.append([before, value, doc, key])
            held += len(value)
            if held >= how.buffer:
                yield flush(parts, known)
                parts, held = [], 0
        if held:
            yield flush(parts, known)

    return run


CLASSES = [f"n{r}" for r in range(1, CUTOFF + 2)]
RESOLVED = "kind string, v long, w long, doc long, key long, x double, " + ", ".join(f"{c} long" for c in CLASSES) + ", bigrams binary"


def _resolved(shared):
    """Per group, by kind:

    bigrams   the counts, packed as (context, word, count)
    classes   n1..n6: bigrams seen so often
    scores    a text's resolved tokens: sum of logarithms without discounts, and n1..n5 tokens by r
    asks      a text asks for alpha of context v, n1 times
    unknown   a text asks for p(w) of a word without a code, n1 times
    contexts  of v: x sum of p(w) over the coded words seen, n1..n5 bigrams by r, n6 occurrences of the others, w count of v
    after     w, without a code, was seen after v
    """
    names = ["kind", "v", "w", "doc", "key", "x", *CLASSES, "bigrams"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.float64(), *[pa.int64()] * len(CLASSES), pa.binary()]

    def rows(kind: str, n: int, **given) -> pa.RecordBatch:
        def column(name: str, t: pa.DataType) -> pa.Array:
            if name == "kind":
                return pa.array([kind] * n, t)
            if name not in given:
                return pa.nulls(n, t)
            values = given[name]
            return pa.array(values.view(np.int64) if isinstance(values, np.ndarray) and values.dtype == np.uint64 else values, t)

        return pa.RecordBatch.from_arrays([column(a, t) for a, t in zip(names, kinds)], names)

    def runs(*columns: np.ndarray) -> np.ndarray:
        """Where a row differs from the one before it."""
        new = np.ones(len(columns[0]), bool)
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return new

    def texts_of(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each token's text, and by number the text's doc and key. Tokens of a text lie together, mostly."""
        new = runs(doc, key)
        heads = np.flatnonzero(new)
        d, k = doc[heads], key[heads]
        order = np.lexsort((k, d))
        d, k = d[order], k[order]
        first = runs(d, k)
        number = np.empty(len(heads), np.int32)
        number[order] = np.cumsum(first) - 1
        return np.repeat(number, np.diff(np.append(heads, len(doc)))), d[first], k[first]

    def by_pair(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different (id, text), and how often."""
        order = np.lexsort((text, ids))
        ids, text = ids[order], text[order]
        heads = np.flatnonzero(runs(ids, text))
        return ids[heads], text[heads], np.diff(np.append(heads, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni: Unigrams = shared.value
        for _, columns in by_group(batches, 4):
            text, t_doc, t_key = texts_of(*columns[2:])
            v, w = columns[:2]
            columns.clear()
            order = np.lexsort((w, v))
            v, w, text = v[order], w[order], text[order]
            del order
            train = ((t_key & np.uint64(1)) == 0)[text]
            new_v = runs(v)
            new = new_v | runs(w)
            heads = np.flatnonzero(new)  # of the bigrams
            count = np.add.reduceat(train, heads, dtype=np.int64)
            of = (np.cumsum(new) - 1).astype(np.int32)  # each token's bigram
            v_heads = np.flatnonzero(new_v)
            local = np.add.reduceat(train, v_heads, dtype=np.int64)
            split = uni.codes.split(v[v_heads])
            whole = np.where(split, uni.codes.known(v[v_heads]), local)  # c(v)
            context = np.cumsum(new_v[heads]) - 1  # each bigram's
            bv, bw, seen = v[heads], w[heads], count > 0
            coded = bw < LOOSE
            p = np.zeros(len(heads))
            p[coded] = uni.p(uni.codes.known(bw[coded]))
            del v, w, train, new, new_v

            yield rows("bigrams", 1, bigrams=[pack([bv[seen], bw[seen], count[seen].astype(np.uint64)])])
            yield rows("classes", 1, **{c: [int((count == r).sum())] for r, c in enumerate(CLASSES, 1)})

            # each token: seen after its context, else alpha (where the context was seen) and p(w)
            log = np.where(seen, np.log10(np.maximum(count, 1)) - np.log10(whole[context] + 1), np.where(coded, np.log10(np.where(coded, p, 1)), 0.0))
            by_r = np.where(count <= CUTOFF, count, 0).astype(np.int64)[of]
            by_r += text.astype(np.int64) * (CUTOFF + 1)
            by_r = np.bincount(by_r, minlength=len(t_doc) * (CUTOFF + 1)).reshape(-1, CUTOFF + 1)
            yield rows("scores", len(t_doc), doc=t_doc, key=t_key, x=np.bincount(text, weights=log[of], minlength=len(t_doc)), **{c: by_r[:, r] for r, c in enumerate(CLASSES[:CUTOFF], 1)})
            ask = np.flatnonzero((~seen & (whole[context] > 0))[of])
            if len(ask):
                a, t, n = by_pair(bv[of[ask]], text[ask])
                yield rows("asks", len(a), v=a, doc=t_doc[t], key=t_key[t], n1=n)
            other = np.flatnonzero((~seen & ~coded)[of])
            if len(other):
                a, t, n = by_pair(bw[of[other]], text[other])
                yield rows("unknown", len(a), w=a, doc=t_doc[t], key=t_key[t], n1=n)
            del of, text

            # contexts that are asked for, here or in another group
            first = np.searchsorted(heads, v_heads)
            wanted = (split | np.logical_or.reduceat(~seen, first)) & (whole > 0)
            if wanted.any():
                add = lambda x: np.add.reduceat(np.where(seen, x, 0), first)[wanted]
                by_r = {c: add(count == r) for r, c in enumerate(CLASSES[:CUTOFF], 1)}
                yield rows("contexts", int(wanted.sum()), v=bv[first][wanted], w=whole[wanted], x=add(np.where(coded, p, 0.0)), n6=add(np.where(count > CUTOFF, count, 0)), **by_r)
                after = seen & ~coded & wanted[context]
                if after.any():
                    yield rows("after", int(after.sum()), v=bv[after], w=bw[after])

    return run


def score(docs: DataFrame, how: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a row of `docs`."""
    spark = docs.sparkSession
    unigrams = stored(unigram_counts(docs), "unigrams")
    seen = [F.sum((F.col("n") == r).cast("long")) for r in range(1, CUTOFF + 2)]
    facts = unigrams.agg(F.sum("n"), F.count("*"), *seen).first()
    tokens, types = facts[0] or 0, facts[1]
    once = [x or 0 for x in facts[2:]]
    kept = discounts(once)
    uni = Unigrams(codes(unigrams, budget=how.budget, limit=how.coded), tokens, types, kept)
    shared = spark.sparkContext.broadcast(uni)
    keyed = _keyed(docs)

    path = f"{shared_folder(spark)}/katz-{uuid.uuid4().hex}"
    texts = keyed.mapInArrow(_documents(shared), DOCUMENT)
    texts.write.partitionBy("kind").parquet(f"{path}/texts")
    dealt = keyed.select("doc", "key", "text").mapInArrow(_dealt(shared, how), "grp long, blob binary")
    groups = dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_resolved(shared), RESOLVED)
    groups.write.partitionBy("kind").parquet(f"{path}/groups")
    texts = spark.read.schema(DOCUMENT).parquet(f"{path}/texts")
    groups = spark.read.schema(RESOLVED).parquet(f"{path}/groups")
    of = lambda kind: groups.filter(F.col("kind") == kind)

    classes = of("classes").agg(*[F.sum(c) for c in CLASSES]).first()
    kept2 = discounts([x or 0 for x in classes])
    share = lambda c, kept: F.element_at(F.array(*[F.lit(float(d)) for d in kept]), c.cast("int"))
    # p(w) of words without a code, by their count; what is left is for words never seen
    taken = F.when(F.col("n") <= CUTOFF, share(F.col("n"), kept)).otherwise(1.0) * F.col("n")
    p_unseen = (1 - float(unigrams.agg(F.sum(taken)).first()[0] or 0.0) / (tokens + 1)) / unseen_types(once)
    singles = unigrams.select(F.col("digest").alias("w"), F.col("n").alias("c"), (taken / (tokens + 1)).alias("p"))

    # alpha of each context that is asked for
    rest = of("after").select("v", "w").join(singles, "w").groupBy("v").agg(F.sum("p").alias("p"))
    parts = of("contexts").select("v", "w", "x", *CLASSES).groupBy("v").agg(F.max("w").alias("c"), F.sum("x").alias("x"), *[F.sum(c).alias(c) for c in CLASSES])
    mass = sum((float(d) * r * F.col(c) for r, (d, c) in enumerate(zip(kept2, CLASSES), 1)), F.col("n6").cast("double"))
    alphas = parts.join(rest, "v", "left").select("v", F.log10((1 - mass / (F.col("c") + 1)) / (1 - F.col("x") - F.coalesce("p", F.lit(0.0)))).alias("alpha"))
    alphas = stored(alphas, "alphas")
    asks = of("asks").select("v", "doc", "key", "n1")
    coded, loose = F.col("v") > 0, F.col("v") < 0  # at most `coded` contexts have a code
    alpha = asks.filter(coded).join(F.broadcast(alphas.filter(coded)), "v").unionByName(asks.filter(loose).join(alphas.filter(loose), "v"))

    zero = lambda t: F.lit(0).cast(t)
    row = lambda df, **given: df.select(
        "doc",
        "key",
        *[given.get(c, F.lit(None).cast("long")).alias(c) for c in ("doc_id", "rows", "n")],
        *[given.get(c, zero("long")).alias(c) for c in ("known", *CLASSES[:CUTOFF])],
        *[given.get(c, zero("double")).alias(c) for c in ("base", "log")],
    )
    words = texts.filter("kind = 'word'").select("doc", "key", "w", "n").join(singles, "w", "left")
    base = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(tokens + types + 1)))
    unknown = of("unknown").select("doc", "key", "w", "n1").join(singles, "w", "left")
    partial = [
        row(texts.filter("kind = 'text'"), doc_id=F.col("doc_id"), rows=F.lit(1).cast("long"), n=F.col("n"), known=F.col("known"), base=F.col("base")),
        row(words, known=F.when(F.col("c") > 0, F.col("n")).otherwise(0), base=base),
        row(of("scores"), log=F.col("x"), **{c: F.col(c) for c in CLASSES[:CUTOFF]}),
        row(alpha, log=F.col("n1") * F.col("alpha")),
        row(unknown, log=F.col("n1") * F.log10(F.coalesce("p", F.lit(p_unseen)))),
    ]
    every = partial[0]
    for p in partial[1:]:
        every = every.unionByName(p)
    added = every.groupBy("doc", "key").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("rows", "n", "known", *CLASSES[:CUTOFF], "base", "log")])
    logs = sum((F.col(c) * float(np.log10(d)) for c, d in zip(CLASSES, kept2)), F.col("log"))
    each = added.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    whole = lambda c: (F.col(c) / F.col("rows")).cast("long")
    return each.select(
        "doc_id",
        (F.col("key") % 2 == 1).alias("held_out"),
        whole("n").alias("n_tokens"),
        whole("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (logs / F.col("rows")).alias("score"),
    )


@query("op13_katz_scores")
def op13_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"))
