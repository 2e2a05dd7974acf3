"""Simple-8b: word-aligned coding of integers, whole blocks at a time with numpy.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of payload; the selector says how
many values of how many bits it packs, lowest bits first. A value of 60 bits or more is an escape:
selector 0, then the value itself in the next word. Values are cut into blocks of BLOCK; a block
starts a new word, and the word at which each block starts is kept, so that all blocks are coded and
decoded side by side, and any block alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
#: (values in a word, bits of each) by selector, from 1; 0 is the escape.
SHAPES = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([1] + [c for c, _ in SHAPES], np.int64)
ESCAPE = 0


def _bits(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), np.uint8)
    for _, bits in SHAPES:
        out[values >= np.uint64(1) << np.uint64(bits)] = bits + 1
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block followed by the number of words."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # widest value among the next c ones, cut at the block's end, by doubling
    need = np.zeros((blocks, BLOCK), np.uint8)
    need.reshape(-1)[:n] = _bits(values)
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    widest, reach = need.copy(), 1
    windows = {1: need}
    for count in sorted({c for c, _ in SHAPES} - {1}):
        while reach * 2 <= count:
            widest[:, : BLOCK - reach] = np.maximum(widest[:, : BLOCK - reach], widest[:, reach:])
            reach *= 2
        over = widest.copy()
        if count > reach:
            over[:, : BLOCK - (count - reach)] = np.maximum(over[:, : BLOCK - (count - reach)], widest[:, count - reach :])
        windows[count] = over
    for selector in range(len(SHAPES), 0, -1):
        count, bits = SHAPES[selector - 1]
        choice[windows[count] <= bits] = selector
    flat = choice.reshape(-1)
    # follow all blocks' chains of words at once
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    stop = np.minimum(at + BLOCK, n)
    heads, owner, alive = [], [], np.arange(blocks)
    here = at
    while len(alive):
        heads.append(here)
        owner.append(alive)
        here = here + COUNT[flat[here]]
        keep = here < stop[alive]
        here, alive = here[keep], alive[keep]
    heads = np.concatenate(heads)
    order = np.argsort(heads)
    heads, owner = heads[order], np.concatenate(owner)[order]
    selector = flat[heads].astype(np.int64)
    size = 1 + (selector == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate((values, np.zeros(max(COUNT), np.uint64)))
    for k, (count, bits) in enumerate(SHAPES, 1):
        own = np.flatnonzero(selector == k)
        if len(own):
            left = np.minimum(count, stop[owner[own]] - heads[own])
            out = np.full(len(own), np.uint64(k) << np.uint64(60))
            for j in range(count):
                value = padded[heads[own] + j]
                out |= np.where(j < left, value, np.uint64(0)) << np.uint64(j * bits)
            words[place[own]] = out
    own = np.flatnonzero(selector == ESCAPE)
    words[place[own] + 1] = values[heads[own]]
    starts = np.zeros(blocks + 1, np.int64)
    np.add.at(starts[1:], owner, size)
    return words, np.cumsum(starts)


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The values again, from all words; `starts` as encode() gave them, `n` the number of values."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape holds a value; words are read from the left, so runs of zero selectors alternate
    zero = selector == ESCAPE
    raw = np.zeros(len(words), bool)
    if zero.any():
        for k in np.flatnonzero(zero).tolist():
            if not raw[k]:
                raw[k + 1] = True
    head = np.flatnonzero(~raw)
    block = np.searchsorted(starts, head, "right") - 1
    count = COUNT[np.minimum(selector[head], len(SHAPES))]
    before = np.cumsum(count) - count
    first = before[np.searchsorted(head, starts[:-1])]
    at = block * BLOCK + before - first[block]
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for k, (count_k, bits) in enumerate(SHAPES, 1):
        own = np.flatnonzero(selector[head] == k)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count_k if len(own) else 0):
            target = at[own] + j
            inside = target < stop[own]
            out[target[inside]] = (words[head[own[inside]]] >> np.uint64(j * bits)) & mask
    own = np.flatnonzero(selector[head] == ESCAPE)
    out[at[own]] = words[head[own] + 1]
    return out
