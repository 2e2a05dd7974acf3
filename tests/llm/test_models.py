"""Collocations, hard negatives and Katz scores against plain Python versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notalake.llm import collocations, hard_negatives, katz, word_codes

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, value int"
ODD = [None, "", " \n\t", "one", "É été ß 中文 😀 é", "a\x0bb\x0cc\r\nd", "x" * 5000, "the end. " * 40, "same line of eight words goes in here\n" * 5]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "s", 1, "k", 2) for i, t, lang in rows], DOCS).repartition(parts)


def prose(seed, n, words=30, length=(5, 60)):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["{}", "{}", "{}", "{}.", "{},", "{}\n"]).format(rng.choice("aBc") + str(int(rng.random() ** 2 * words))) for _ in range(rng.randint(*length))) for _ in range(n)]


def plain_collocations(rows, how):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, how.longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= how.least}
        longer = collections.defaultdict(int)
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] >= how.contained * a and longer[p]:
                continue
            cuts = [(2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[: how.top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("how", [dict(), dict(coded=0), dict(coded=9, budget=40, buffer=50), dict(budget=25, buffer=100), dict(longest=3, contained=50), dict(longest=2)], ids=str)
def test_collocations(spark, how):
    rows = [(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(ODD + prose(5, 120) + ["A a a a a a a a a a a a. of the new york city of the new york city"] * 8)]
    how = collocations.Mining(least=5, top=40, **how)
    got = collocations.collocations(frame(spark, rows), how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain_collocations(rows, how)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [(1, None, None)]).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (None, "", "en"), (2, "one two", None)])).count() == 0


def test_packed_columns_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, 1 << b, n, dtype=np.uint64) for b in (1, 8, 9, 33, 63)] + [np.full(n, (1 << 64) - 1, np.uint64)]
        assert all((a == b).all() for a, b in zip(columns, word_codes.unpack([word_codes.pack([c[: n // 3] for c in columns]), word_codes.pack([c[n // 3 :] for c in columns])], 6)))


def test_codes_have_a_bound_and_groups_a_budget(spark):
    words = spark.createDataFrame([(-1000 + i, 1 + 2000 // (i + 1)) for i in range(500)], "digest long, n long")
    known = word_codes.codes(words, budget=300, limit=50)
    assert 0 < len(known.digests) <= 50 and not known.complete
    values = known.values(np.array([-1000, -999, -600], np.int64).view(np.uint64))
    assert values[0] == 1 and values[1] == 2 and values[2] >= word_codes.LOOSE
    assert known.split(values).tolist() == [True, True, False]
    weight = collections.Counter()
    for code in range(1, len(known.digests) + 1):
        v = np.full(1000, code, np.uint64)
        for g in known.group(v, np.arange(1000, dtype=np.uint64)).tolist():
            weight[g] += known.counts[code] / 1000
    assert max(weight.values()) <= 1.25 * 300


VECTORS = "vec_id long, embedding array<double>, label int, rid string, cell int"


def plain_negatives(rows, how):
    clean = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in clean), default=0)
    clean = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in clean]
    out = collections.Counter()
    for k, (a, v, lab) in enumerate(clean):
        if a % how.every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u)), j, m != lab) for n, (j, u, m) in enumerate(clean) if n != k)
        for p, j, _ in [s for s in scored if not s[2]][: how.positives]:
            window = [(s, n) for s, n, other in scored if other and how.percent * -p <= 100 * -s <= 100 * -p]
            for rank, (s, n) in enumerate(window[: how.negatives], 1):
                out[(a, j, rank, n, -p, -s)] += 1
    return out


@pytest.mark.parametrize("how", [dict(first=64, block=16, queries=3), dict(first=10**6), dict(first=1, block=7, sample=20), dict(first=32, positives=2, negatives=3, percent=95)], ids=str)
def test_hard_negatives(spark, how):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 10))
    rows = []
    for i in range(400):
        c = centres[i % 6] + rng.normal(size=10) * (0.05 if i % 3 else 0.6)
        rows.append((i, [float(x) for x in c], int(rng.integers(0, 3))))
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(60)]  # copies: ties
    rows += [(None, rows[0][1], 1), (2001, None, 1), (2002, rows[1][1], None), (2003, [1.0, None], 1), (2004, [float("nan")] * 10, 1), (2005, [float("inf")] * 10, 1), (2006, [], 1), (2010, [0.5, -0.5], 2)]
    how = hard_negatives.Mining(every=10, **how)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(4)
    got = hard_negatives.mine(hard_negatives.clean(table), how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_negatives(rows, how)


def test_hard_negatives_send_no_anchors_through_the_driver(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(0, 3))) for i in range(300)]
    how = hard_negatives.Mining(every=10, first=16, block=8, queries=3, held=300, part=2)
    got = hard_negatives.mine(hard_negatives.clean(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(4)), how)
    assert "Broadcast" not in got._jdf.queryExecution().toString()  # once, all that anchors ask for was broadcast
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_negatives(rows, how)


def test_anchors_go_to_a_part_once_whatever_the_cells_they_visit():
    index = hard_negatives.Index(64, (np.zeros((4, 32)), np.zeros((4, 32))), (), None, np.array([0, 30_000]))
    parts, groups = hard_negatives._grid(10_000_000, index, 8, hard_negatives.Mining())
    assert parts == 235 and 10_000_000 / groups * (2 * 64 + 56) <= hard_negatives.Mining().held


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(hard_negatives.clean(empty)).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0], 3, "x", 1)], VECTORS)
    assert hard_negatives.mine(hard_negatives.clean(alone)).count() == 0


def test_heap_visits_by_falling_bound_that_holds_for_all_rows():
    rng = np.random.default_rng(0)
    rows = rng.integers(-50, 50, (300, 6)).astype(float)
    books = rng.normal(size=(5, 3)) * 30, rng.normal(size=(4, 3)) * 30
    (i, d1), (j, d2) = (hard_negatives._nearest(rows[:, h], b) for h, b in zip((slice(0, 3), slice(3, 6)), books))
    radii = tuple(np.array([d[k == c].max(initial=0) for c in range(len(b))]) for k, d, b in zip((i, j), (d1, d2), books))
    cells = i * 4 + j
    index = hard_negatives.Index(6, books, radii, np.bincount(cells, minlength=20), None)
    query = rows[0]
    visits = list(index.visits(query))
    assert [b for b, _ in visits] == sorted((b for b, _ in visits), reverse=True)
    assert sorted(c for _, c in visits) == sorted(set(cells.tolist()))
    for bound, cell in visits:
        assert (rows[cells == cell] @ query).max() <= bound


def plain_katz(rows):
    """(doc_id, held_out, tokens, known, N, base, score) of each row, and the model as a function of (v, w)."""
    texts = [(i, [w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))] + [None], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t, _ in rows]
    one, two = collections.Counter(), collections.Counter()
    for _, w, out in texts:
        if not out:
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    context = collections.Counter()
    for (a, _), c in two.items():
        context[a] += c
    kept = [katz.discounts([sum(c == r for c in counts.values()) for r in range(1, 7)]) for counts in (one, two)]
    d = lambda level, c: kept[level][c - 1] if c <= 5 else 1.0
    p1 = {w: d(0, c) * c / (n + 1) for w, c in one.items()}
    unknown = (1 - sum(p1.values())) / katz.unseen_types([sum(c == r for c in one.values()) for r in (1, 2)])
    follow = collections.defaultdict(dict)
    for (a, w), c in two.items():
        follow[a][w] = d(1, c) * c / (context[a] + 1)
    alpha = {a: (1 - sum(f.values())) / (1 - sum(p1[w] for w in f)) for a, f in follow.items()}

    def p(a, w):
        if a in follow:
            return follow[a].get(w) or alpha[a] * p1.get(w, unknown)
        return p1.get(w, unknown)

    out = []
    for i, w, held in texts:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, held, len(w), sum(one[x] > 0 for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip([None, *w], w))))
    return out, p, one


@pytest.mark.parametrize("how", [dict(), dict(coded=0), dict(coded=12, budget=30, buffer=40), dict(budget=20, buffer=64)], ids=str)
def test_katz_scores(spark, how):
    texts = ODD + prose(8, 150, words=40) + ["never seen words here", "a1 a1 unseen a1"] * 12
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, "one", "en"), (None, "a1 b2", "en"), (None, "a1 b2", "en"), (4, "another text of a known id", "en")]
    got = katz.score(frame(spark, rows), katz.Model(**how))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    want, _, _ = plain_katz(rows)
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(want) and any(r[1] for r in want)
    for a, b in zip(sorted(have, key=order), sorted(want, key=order)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_katz_is_normalised():
    rows = [(i, t, "en") for i, t in enumerate(prose(8, 80, words=40))]
    _, p, one = plain_katz(rows)
    unseen = katz.unseen_types([sum(c == r for c in one.values()) for r in (1, 2)])
    for context in [None, *list(one)[:20], "nowhere"]:
        assert sum(p(context, w) for w in one) + unseen * p(context, "no word of it") == pytest.approx(1, abs=1e-9)


def test_katz_of_nothing(spark):
    assert katz.score(frame(spark, [(1, "x", "en")]).limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = katz.score(frame(spark, [(held, "only held out", "en")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["score"]) == (4, 0, 0, 0.0)


def test_discounts_fall_back_to_lower_cutoffs():
    assert katz.discounts([0] * 6) == [1.0] * 5
    full = katz.discounts([1000, 400, 200, 120, 80, 60])
    assert all(0 < a < 1 for a in full)
    part = katz.discounts([1000, 400, 200, 0, 0, 0])
    assert part[2:] == [1.0] * 3 and 0 < part[0] < 1


def test_katz_tells_prose_from_noise(spark):
    rows = [(i, t, "en") for i, t in enumerate(prose(8, 300, words=40))]
    rng = random.Random(1)
    noise = [(1000 + i, " ".join(rng.choice("aBc") + str(rng.randrange(40, 4000)) for _ in range(40)), "en") for i in range(30)]
    scored = katz.score(frame(spark, rows + noise)).filter("held_out").withColumn("each", F.col("score") / F.col("n_tokens"))
    mean = {r["noise"]: r["m"] for r in scored.groupBy((F.col("doc_id") >= 1000).alias("noise")).agg(F.avg("each").alias("m")).collect()}
    assert mean[False] > mean[True]
