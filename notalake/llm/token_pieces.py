"""Exact tokenization of Arrow text slices by pieces, each distinct piece encoded once.

A text is cut only where no token can cross, so the ids of its pieces, one after another, are the
ids of the whole text. Distinct pieces go to the tokenizers library in one batch and stay in a
bounded per-process memory; everything else is numpy. New pieces are handed over as one sequence of
separate words, which gives the same ids as one call for each and costs half.

Cuts for a tokenizer that drops white space: every ASCII white space. Cuts for byte-level BPE with
its usual pattern: before a single space or line end between two characters that are surely not white
space, where a match always ends and the next one starts, and behind such a line end. For both, before
a mark that follows a letter.
"""

from __future__ import annotations

import ctypes
import gc
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .arrow_text import IS_SPACE, LOWER, Texts, byte_strings

REMEMBERED = 500_000
IDS_A_PIECE = 8
TOGETHER = 1000
SLICE_BYTES = 4 << 20  # larger than for other work: the more text, the fewer of its pieces are new

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LEADS = np.zeros(256, bool)  # first bytes of characters that are never white space
_LEADS[0xC3:0xE1] = True
_LEADS[0xE4:0xF5] = True
_TWO_BYTE = np.zeros(256, bool)
_TWO_BYTE[0xC3:0xE0] = True
_SINGLE = np.zeros(256, bool)
_SINGLE[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ACCENTED = np.zeros(256, bool)  # second bytes of the letters from U+00C0 to U+00FF
_ACCENTED[0x80:0xC0] = True
_ACCENTED[[0x97, 0xB7]] = False
_MARK = np.zeros(256, bool)  # ASCII marks but the apostrophe, with which contractions begin
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True


def _before_marks(data: np.ndarray) -> np.ndarray:
    """Places of marks right after a letter: a match of letters ends there. Needs two bytes of text before."""
    letter = _LETTER[data[1:-1]]
    letter |= _ACCENTED[data[1:-1]] & (data[:-2] == 0xC3)
    return np.flatnonzero(letter & _MARK[data[2:]]) + 2


def _may_hold_special(data: np.ndarray) -> bool:
    """Special tokens, written "<|...|>", are taken out before anything else and may hold such places."""
    return b"<|" in data.tobytes()


def word_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = texts.pieces(IS_SPACE[texts.data])
    if len(texts.data) < 3 or _may_hold_special(texts.data):
        return starts, ends, doc
    more = _before_marks(texts.data)
    more = more[~np.isin(more, texts.offsets)]
    starts, ends = np.sort(np.concatenate((starts, more))), np.sort(np.concatenate((ends, more)))
    return starts, ends, np.searchsorted(texts.offsets, starts, "right") - 1


def spaced_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = texts.data
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before = _PLAIN[data[:-2]]
        before[1:] |= (data[1:-2] >= 0x80) & _TWO_BYTE[data[:-3]]
        cut[1:-2] = _SINGLE[data[1:-1]] & before & (_PLAIN[data[2:]] | _LEADS[data[2:]])
        # neighbours in another text don't count: no cut at a text's first or last byte
        cut[texts.offsets[1:-1]] = False
        cut[np.maximum(texts.offsets[1:-1] - 1, 0)] = False
        lines = np.flatnonzero(cut[:-1] & (data == 0x0A))
        cut[lines + 1] = True
        if not _may_hold_special(data):
            cut[_before_marks(data)] = True
    full = texts.offsets[:-1] < texts.offsets[1:]
    cut[texts.offsets[:-1][full]] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(texts.offsets, starts, "right") - 1


CUTS = {"words": word_pieces, "spaces": spaced_pieces}


def _lowers(tokenizer) -> bool:
    """Whether the tokenizer lower-cases by itself: then A-Z may be folded before."""
    return tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"


class PieceEncoder:
    def __init__(self, path: str, cuts: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.cuts = CUTS[cuts]
        self.folds = cuts == "words" and _lowers(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, distinct: list[bytes]) -> np.ndarray:
        """Number of each piece in the memory, after adding those that are new."""
        new = [p for p in distinct if p not in self.known]
        if new:
            if len(self.known) + len(new) > self.remembered or len(self.ids) > IDS_A_PIECE * self.remembered:
                self._forget()
                new = distinct
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            lengths, ids = [self.lengths], [self.ids]
            for at in range(0, len(new), TOGETHER):
                part = [p.decode() for p in new[at : at + TOGETHER]]
                coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(coded.ids, np.uint32))
                lengths.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part)))
            self.lengths, self.ids = np.concatenate(lengths), np.concatenate(ids)
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def __call__(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice, and how many each text has; `end` is put after each text."""
        texts = Texts(column)
        if self.folds and not _may_hold_special(texts.data):
            texts.data = LOWER[texts.data]
        starts, ends, doc = self.cuts(texts)
        coded = texts.spans(starts, ends).dictionary_encode()
        place = self._encode(byte_strings(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
        heads = np.cumsum(self.lengths) - self.lengths
        lengths = self.lengths[place]
        before = np.cumsum(lengths) - lengths
        counts = np.bincount(doc, weights=lengths, minlength=texts.n).astype(np.int64)
        ids = self.ids[np.repeat(heads[place] - before, lengths) + np.arange(lengths.sum())]
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), end)
            counts += 1
        return ids, counts


@lru_cache(maxsize=2)
def encoder(path: str, cuts: str, remembered: int = REMEMBERED) -> PieceEncoder:
    """One per worker process."""
    return PieceEncoder(path, cuts, remembered)


def release() -> None:
    """Gives up the encoders and hands free memory back, where other work follows in the same worker process."""
    encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
