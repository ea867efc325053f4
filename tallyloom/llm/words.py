"""Words and word windows of a text as 64-bit hashes, with numpy.

Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. A text is taken in
blocks that end between words, so memory is bounded by the block and the longest
word, not by the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import held

BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64; at least ``n`` of each.

    A process keeps one table, long enough for a block; a longer word has one made for itself.
    """
    base = 0x9E3779B97F4A7C15

    def make(size: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, base, np.uint64))
            down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))
        return up, down

    kept = BLOCK + (BLOCK >> 4)
    return held("powers", lambda: make(kept)) if n <= kept else make(n)


def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word."""
    inside = ~held("space", _space)[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _block_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    raw = np.frombuffer(block, np.uint8)
    first, end = spans(raw)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    total[1:] = raw
    total[1:] += np.uint64(1)
    total[1:] *= up[: len(raw)]
    np.cumsum(total[1:], out=total[1:])
    value = (total[end] - total[first]) * down[first]
    return mix(value + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word, in order."""
    parts, at = [], 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            gap = re.compile(rb"[\x20\x09-\x0D]").search(text, end)
            end = gap.start() if gap else len(text)
        parts.append(_block_hashes(text[at:end])[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of ``n`` words; the whole sequence as one window if it is shorter."""
    if not len(hashes):
        return hashes
    n_here = min(n, len(hashes))
    size = len(hashes) - n_here + 1
    out = mix(hashes[:size] + np.uint64(n_here))
    for k in range(1, n_here):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + hashes[k : k + size])
    return out


def window_lists(texts: Sequence[bytes], n: int) -> Iterator[np.ndarray]:
    """The windows of each text; short texts are hashed together, which saves most of the numpy calls."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) < BLOCK:
            size += len(texts[end]) + 1
            end += 1
        if end == at:  # a long text on its own
            yield windows(word_hashes(texts[at]), n)
            at += 1
            continue
        hashes, first = _block_hashes(b" ".join(texts[at:end]))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
        borders = np.searchsorted(first, starts).tolist()
        whole = windows(hashes, n) if len(hashes) >= n else None
        for a, b in zip(borders[:-1], borders[1:]):
            yield whole[a : b - n + 1] if b - a >= n else windows(hashes[a:b], n)
        at = end


by_value(__name__)
