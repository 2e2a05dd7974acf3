"""License scans: text compared with licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised to words between white space and ASCII marks, A-Z folded. A text is
compared in stretches: the words around those bigrams that some template has, split where a gap
between them is wider than the longest template. A stretch with h bigrams of a template of T bigrams
has a Dice coefficient of at most 2 h / (h + T), so a template too large for what was hit is pruned
before any window is tried. Windows then begin and end at hits; the best one counts, if its
coefficient reaches `least`.

Templates are a fixed, small list, sent with the function. One pass, no shuffle.

Defined results: null or empty text holds no licence; of overlapping finds the one with the larger
coefficient stays, at equal ones the longer, then the first by name; repeated rows are scanned each; an
empty table gives no rows; other columns are not used. Offsets count code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import IS_SPACE, Words, slices
from .common import table
from .license_templates import TEMPLATES
from .registry import query

SEPARATORS = IS_SPACE.copy()
SEPARATORS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
LEAST = 0.8


def dice(shared: int, a: int, b: int) -> float:
    return 2 * shared / (a + b) if a + b else 0.0


class Templates:
    """Bigrams of the templates; counted as multisets, so a window's size is its number of bigrams."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        words = Words(pa.array([texts[n] for n in self.names]), lower=True, separators=SEPARATORS)
        at, value = words.windows(words.hashes(), 2)
        doc = words.doc[at]
        self.bigrams = [value[doc == k] for k in range(len(self.names))]
        self.sizes = np.array([len(b) for b in self.bigrams])
        self.all = np.unique(value)
        self.has = np.array([np.isin(self.all, b) for b in self.bigrams])
        self.counts = []
        for b in self.bigrams:
            known, times = np.unique(b, return_counts=True)
            self.counts.append(dict(zip(known.tolist(), times.tolist())))

    def window(self, k: int, bigrams: np.ndarray, hits: np.ndarray, least: float) -> tuple[float, int, int] | None:
        """Best window of one stretch for template k: coefficient, first and last bigram."""
        size = int(self.sizes[k])
        longest = int(size * (2 - least) / least)  # beyond it no window can reach `least`
        best = None
        for i, start in enumerate(hits.tolist()):
            left, shared = dict(self.counts[k]), 0
            for j in range(i, len(hits)):
                end = int(hits[j])
                if end - start + 1 > longest:
                    break
                value = int(bigrams[end])
                if left.get(value, 0):
                    left[value] -= 1
                    shared += 1
                score = dice(shared, end - start + 1, size)
                if score >= least and (best is None or (score, end - start) > (best[0], best[2] - best[1])):
                    best = (score, start, end)
            if best is not None and best[0] == 1.0:
                break
        return best


@lru_cache(maxsize=4)
def _templates(items: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(dict(items))


def scan_slice(texts: pa.Array, templates: Templates, least: float = LEAST) -> Iterator[tuple[int, str, float, int, int]]:
    """(row, licence, coefficient, start, stop) of every find in one slice, in the order of the text."""
    words = Words(texts, lower=True, separators=SEPARATORS)
    at, value = words.windows(words.hashes(), 2)
    place = np.minimum(np.searchsorted(templates.all, value), max(len(templates.all) - 1, 0))
    hit = np.flatnonzero(templates.all[place] == value) if len(templates.all) else np.zeros(0, np.int64)
    if not len(hit):
        return
    doc = words.doc[at[hit]]
    gap = int(templates.sizes.max() * (2 - least) / least)
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (hit[1:] - hit[:-1] > gap), [True])))
    found: dict[int, list[tuple[float, int, int, str]]] = {}
    for a, b in zip(cut.tolist(), cut[1:].tolist()):
        inside = hit[a:b]
        of = templates.has[:, place[inside]]
        hits = of.sum(axis=1)
        for k in np.flatnonzero(2 * hits >= least * (hits + templates.sizes)).tolist():
            own = inside[of[k]]
            # a template's window is never longer than `longest`, so hits further apart are separate stretches
            longest = int(templates.sizes[k] * (2 - least) / least)
            for part in np.split(own, np.flatnonzero(np.diff(own) > longest) + 1):
                if 2 * len(part) < least * (len(part) + templates.sizes[k]):
                    continue
                rest = [part]
                while rest:
                    some = rest.pop()
                    best = templates.window(k, value, some, least) if len(some) else None
                    if best is not None:
                        found.setdefault(int(doc[a]), []).append((best[0], best[1], best[2], templates.names[k]))
                        rest += [some[some < best[1]], some[some > best[2]]]
    for row in sorted(found):
        kept: list[tuple[float, int, int, str]] = []
        for score, x, y, name in sorted(found[row], key=lambda f: (-f[0], f[1] - f[2], f[3], f[1])):
            if all(y < p or x > q for _, p, q, _ in kept):
                kept.append((score, x, y, name))
        for score, x, y, name in sorted(kept, key=lambda f: f[1]):
            edge = np.array([words.starts[at[x]], words.ends[at[y] + 1]])
            span = words.code_points(edge, np.array([row, row]))
            yield row, name, score, int(span[0]), int(span[1])


FINDS = "doc_id long, n_licenses long, license string, dice double, start int, stop int, finds array<struct<license:string,dice:double,start:int,stop:int>>"


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row a document: its best find (null without one), and all finds in the order of the text."""
    items = tuple(sorted((templates or TEMPLATES).items()))
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(items)
        for part in slices(batches, "text"):
            finds: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for row, name, score, start, stop in scan_slice(part.column("text"), known, least):
                finds[row].append({"license": name, "dice": score, "start": start, "stop": stop})
            best = [max(f, key=lambda x: (x["dice"], x["stop"] - x["start"], -x["start"])) if f else {} for f in finds]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(f) for f in finds], pa.int64()),
                    pa.array([b.get("license") for b in best], pa.string()),
                    pa.array([b.get("dice") for b in best], pa.float64()),
                    pa.array([b.get("start") for b in best], pa.int32()),
                    pa.array([b.get("stop") for b in best], pa.int32()),
                    pa.array(finds, kind),
                ],
                ["doc_id", "n_licenses", "license", "dice", "start", "stop", "finds"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, FINDS)


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses(table(spark, folder, "documents"))
    each = F.transform("finds", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["stop"].cast("string")))
    return found.select("doc_id", "n_licenses", "license", F.round("dice", 6).alias("dice"), "start", "stop", F.array_join(each, ",").alias("finds"))
