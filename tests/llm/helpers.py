"""Small fixtures and brute-force versions."""

from __future__ import annotations

import collections
import random
import zlib

SYLLABLES = ["ra", "to", "mi", "len", "sor", "ka", "pu", "vin", "del", "os"]


def prose(seed: int, words: int, syllables=SYLLABLES) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(words))


def fold(doc_id, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def shingle_set(text: str | None, n: int) -> frozenset:
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def jaccard_components(rows, n: int, num: int, den: int) -> dict:
    """``doc_id -> (set size, smallest linked id)`` by comparing all pairs."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and den * shared >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def best_fit_decreasing(lengths: list[int], size: int) -> list[int]:
    """Remaining room of each sequence, packing one piece after the other."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


def repeated_words(words: list[str], window: int) -> int:
    found = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    often = collections.Counter(found)
    covered = {k for i, w in enumerate(found) if often[w] > 1 for k in range(i, i + window)}
    return len(covered)
