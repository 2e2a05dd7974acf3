"""Words as numbers: digests, short codes for the frequent ones, and groups of prefixes of bounded weight.

Codes are what tasks send each other instead of words. At most `limit` words get one, chosen by a
threshold on their counts, so what is broadcast has a fixed bound; all other words travel as 64-bit
digests and mean the same. Groups are dealt by the same table: light words share a group up to its
budget of occurrences, a word above the budget has several groups and its windows are dealt among
them by the words that follow. A word above a quarter of it has a group of its own, so shared groups
hold at most a quarter more than the budget.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, mix

LOOSE = np.uint64(1 << 63)  # set in the values of words without a code
CODED_WORDS = 1 << 20
EXACT_CLASSES = 4096  # counts below are told apart when the threshold is chosen, others by their power of two


def digest(word: bytes, tag: bytes = b"") -> int:
    return xxhash.xxh3_64_intdigest(tag + b"\0" + word) | 1 << 63


def numbered(words: Words, tags: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The different words of a slice, apart by the tag of their text where there are tags.

    Returns the number of each occurrence; by number its tag's place in `tags` (else 0), its digest, and its bytes.
    """
    index, distinct = words.encoded()
    if tags is None:
        return index, np.zeros(len(distinct), np.int64), np.array([digest(w) for w in distinct], np.uint64), distinct
    coded = tags.dictionary_encode()
    names = [t.encode() for t in coded.dictionary.to_pylist()]
    of_text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    present, number = np.unique(of_text[words.doc] * max(len(distinct), 1) + index, return_inverse=True)
    which, word = np.divmod(present, max(len(distinct), 1))
    spelled = [distinct[k] for k in word.tolist()]
    digests = np.array([digest(w, names[t]) for w, t in zip(spelled, which.tolist())], np.uint64)
    first = np.zeros(len(names), np.int64)
    first[of_text[::-1]] = np.arange(len(of_text))[::-1]
    return number, first[which], digests, spelled


@dataclass
class Codes:
    """Codes 1.. of the words with most occurrences, and the groups of all words."""

    digests: np.ndarray  # of the coded words, ascending
    code: np.ndarray  # by place in `digests`
    counts: np.ndarray  # by code; 0 has none
    base: np.ndarray  # first group, by code
    ways: np.ndarray  # number of groups, by code
    groups: int  # of the coded words
    loose: int  # groups of all other words
    complete: bool  # every word that counts has a code

    def values(self, digests: np.ndarray) -> np.ndarray:
        """The code, or the digest itself; 0 for words that do not count."""
        other = np.zeros(len(digests), np.uint64) if self.complete else digests
        if not len(self.digests):
            return other
        at = np.minimum(np.searchsorted(self.digests, digests), len(self.digests) - 1)
        return np.where(self.digests[at] == digests, self.code[at], other)

    def _place(self, values: np.ndarray) -> np.ndarray:
        """Codes as places in the tables; 0 where there is none."""
        return np.where(values < LOOSE, values, np.uint64(0)).astype(np.int64)

    def split(self, values: np.ndarray) -> np.ndarray:
        """Whether a word has several groups."""
        return self.ways[self._place(values)] > 1

    def known(self, values: np.ndarray) -> np.ndarray:
        """Count of the words that have a code, else 0."""
        return self.counts[self._place(values)]

    def group(self, values: np.ndarray, deal: np.ndarray) -> np.ndarray:
        place = self._place(values)
        coded = self.base[place] + (deal % self.ways[place].astype(np.uint64)).astype(np.int64)
        return np.where(place > 0, coded, self.groups + (mix(values) % np.uint64(self.loose)).astype(np.int64))


def codes(words: DataFrame, *, budget: int, least: int = 1, limit: int = CODED_WORDS, drop_rare: bool = False) -> Codes:
    """From `words` (digest long, n long, one row a word). With `drop_rare`, words of fewer than `least` occurrences do not count."""
    exact = F.when(F.col("n") < EXACT_CLASSES, F.col("n"))
    classes = exact.otherwise(F.expr("shiftleft(1L, length(bin(n)) - 1)")).alias("low")
    rows = words.filter(F.col("n") >= least).groupBy(classes).agg(F.count("*").alias("k"), F.sum("n").alias("n")).orderBy(F.desc("low")).collect()
    threshold, taken, covered = None, 0, 0
    for r in rows:
        if taken + r["k"] > limit:
            break
        threshold, taken, covered = r["low"], taken + r["k"], covered + r["n"]
    total = sum(r["n"] for r in rows) if drop_rare else words.agg(F.sum("n")).first()[0] or 0
    if taken:
        # at most `limit` rows, by the threshold
        top = words.filter(F.col("n") >= threshold).select("digest", "n").toArrow()
        digests, counts = top["digest"].to_numpy().view(np.uint64), top["n"].to_numpy()
    else:
        digests, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((digests, -counts))
    digests, counts = digests[order], counts[order]
    ways = np.maximum(-(-counts // budget), 1)
    light = counts <= budget // 4
    before = np.cumsum(np.where(light, counts, 0)) - np.where(light, counts, 0)
    shared = before // budget
    n_shared = int(shared[light].max(initial=-1)) + 1
    own = np.cumsum(np.where(light, 0, ways)) - np.where(light, 0, ways)
    base = np.where(light, shared, n_shared + own)
    groups = n_shared + int(ways[~light].sum())
    by_digest = np.argsort(digests)
    head = lambda a, first: np.concatenate(([first], a)).astype(np.int64)
    return Codes(
        digests[by_digest],
        (by_digest + 1).astype(np.uint64),
        head(counts, 0),
        head(base, 0),
        head(ways, 1),
        groups,
        max(-(-int(total - covered) // budget), 1),
        drop_rare and covered == total,
    )


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of uint64 as planes of bytes, without those that are zero throughout."""
    out = [np.array([len(columns[0])], np.uint64).tobytes()]
    for c in columns:
        width = max((int(c.max(initial=0)).bit_length() + 7) // 8, 1)
        out += [bytes([width]), np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpack(packed: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of blobs, one after the other."""
    sizes = [int(np.frombuffer(blob, np.uint64, 1)[0]) for blob in packed]
    out = [np.zeros(sum(sizes), np.uint64) for _ in range(columns)]
    first = 0
    for blob, n in zip(packed, sizes):
        at = 8
        for column in out:
            width = blob[at]
            column[first : first + n].view(np.uint8).reshape(-1, 8)[:, :width] = np.frombuffer(blob, np.uint8, width * n, at + 1).reshape(width, n).T
            at += 1 + width * n
        first += n
    return out


def blobs(group: np.ndarray, columns: list[np.ndarray], most: int = 1 << 16) -> pa.RecordBatch:
    """(group, blob) rows of columns whose rows belong to groups, at most `most` rows a blob; order inside a group stays."""
    order = np.argsort(group, kind="stable")
    group, columns = group[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, np.int64)
    spans = [(a, min(a + most, e)) for s, e in zip(edges.tolist(), edges[1:].tolist()) for a in range(s, e, most)]
    packed = [pack([c[a:b] for c in columns]) for a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array(group[[a for a, _ in spans]].astype(np.int64)), pa.array(packed, pa.binary())], ["grp", "blob"])


def by_group(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of (grp, blob) rows in the order of their groups, each group's columns; one group is held at a time, packed until it is whole."""
    held, parts = None, []
    for batch in batches:
        for g, blob in zip(batch.column("grp").to_pylist(), batch.column("blob")):
            if g != held and parts:
                whole, parts = unpack(parts, columns), []
                yield held, whole
                del whole
            held = g
            parts.append(blob.as_buffer().to_pybytes())
    if parts:
        whole, parts = unpack(parts, columns), []
        yield held, whole
