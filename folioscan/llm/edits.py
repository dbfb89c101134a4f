"""Edit distances over arrays of strings, and a BK-tree that is searched by many strings at once."""

from __future__ import annotations

import numpy as np


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as columns of code points (one row per place, padded with 0), and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=0))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), width), np.uint32)
    out[np.arange(width) < sizes[:, None]] = flat
    return np.ascontiguousarray(out.T), sizes


def levenshtein_to(pattern: str, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Levenshtein distance of ``pattern`` to each of ``texts`` (as by :func:`codes`).

    Bit-parallel (the published recurrence of Myers and Hyyrö), one 64-bit word per 64
    characters of the pattern, all texts together.
    """
    m, n = len(pattern), texts.shape[1]
    if not m or not n:
        return sizes.copy()
    words = -(-m // 64)
    signs, text_signs = np.unique(texts[: int(sizes.max(initial=0))], return_inverse=True)
    text_signs = text_signs.reshape(-1, n)
    masks = np.zeros((words, len(signs)), np.uint64)
    place = {int(c): i for i, c in enumerate(signs)}
    for i, c in enumerate(pattern):
        if (at := place.get(ord(c))) is not None:
            masks[i // 64, at] |= np.uint64(1 << (i % 64))
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    up = [np.full(n, full) for _ in range(words)]
    down = [np.zeros(n, np.uint64) for _ in range(words)]
    score = np.full(n, m, np.int64)
    out = score.copy()
    top = np.uint64((m - 1) % 64)
    ends = [np.flatnonzero(sizes == j) for j in range(len(text_signs) + 1)]
    for j in range(len(text_signs)):
        carry_up, carry_down = one, np.uint64(0)
        for w in range(words):
            vp, vn = up[w], down[w]
            own = masks[w][text_signs[j]]
            eq = own | carry_down
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = vn | ~(d0 | vp), vp & d0
            bit = top if w == words - 1 else np.uint64(63)
            out_up, out_down = (hp >> bit) & one, (hn >> bit) & one
            hp, hn = (hp << one) | carry_up, (hn << one) | carry_down
            d0 = own | vn | d0
            up[w], down[w] = hn | ~(d0 | hp), hp & d0
            carry_up, carry_down = out_up, out_down
        score += carry_up.astype(np.int64)
        score -= carry_down.astype(np.int64)
        if len(ends[j + 1]):
            out[ends[j + 1]] = score[ends[j + 1]]
    return out


def typos(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting as one (no place edited twice); most + 1 if more.

    Only a band of the table about its diagonal is filled.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    # what both begin or end with costs nothing
    low, high, other = 0, len(a), len(b)
    while low < high and low < other and a[low] == b[low]:
        low += 1
    while high > low and other > low and a[high - 1] == b[other - 1]:
        high, other = high - 1, other - 1
    a, b = a[low:high], b[low:other]
    if not a or not b:
        return max(len(a), len(b))
    if most == 1:
        return 1 if len(a) == len(b) == 1 or len(a) == len(b) == 2 and a[0] == b[1] and a[1] == b[0] else 2
    far = most + 1
    before2: list[int] = []
    before = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        now = [far] * (len(b) + 1)
        if i <= most:
            now[0] = i
        best = now[0]
        for j in range(low, high + 1):
            y = b[j - 1]
            d = min(before[j - 1] + (x != y), before[j] + 1, now[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before2[j - 2] + 1 < d:
                d = before2[j - 2] + 1
            now[j] = d if d < far else far
            if d < best:
                best = d
        if best > most and min(before[max(0, low - 1) : high + 1]) > most:
            return far
        before2, before = before, now
    return before[len(b)]


def _letters(words: list[str]) -> np.ndarray:
    """Counts of the characters of each word in 32 classes."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(row * 32 + flat % 32, minlength=32 * len(words)).reshape(-1, 32).astype(np.int16)


class BKTree:
    """Words under the Levenshtein metric; children are held by their distance to the parent."""

    def __init__(self, words: list[str]):
        self.words = list(dict.fromkeys(words))
        self.children: list[dict[int, int]] = []
        if not self.words:
            return
        # words are let down the tree level by level, all of a node's words at once
        self.children = [{} for _ in self.words]
        self.letters = _letters(self.words)
        table, sizes = codes(self.words)
        waiting = [(0, np.arange(1, len(self.words)))]
        while waiting:
            node, below = waiting.pop()
            if not len(below):
                continue
            d = levenshtein_to(self.words[node], table[:, below], sizes[below])
            for x in np.unique(d).tolist():
                members = below[d == x]
                self.children[node][x] = int(members[0])
                waiting.append((int(members[0]), members[1:]))

    def within(self, asked: list[str], radius: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in ``asked``, place in ``words``, distance) of every word within each asked word's radius.

        A node's distance is only worked out for asked words that may be near it or one of
        its children: each edit changes the length by one at most, and the counts of letters by two.
        """
        out: list[tuple[int, int, int]] = []
        if not self.words or not asked:
            return out
        table, sizes = codes(asked)
        letters = _letters(asked)
        waiting = [(0, np.arange(len(asked)))]
        while waiting:
            node, those = waiting.pop()
            farthest = max(self.children[node], default=0)
            least = np.maximum(np.abs(sizes[those] - len(self.words[node])), (np.abs(letters[those] - self.letters[node]).sum(axis=1) + 1) // 2)
            those = those[least <= farthest + radius[those]]
            if not len(those):
                continue
            d = levenshtein_to(self.words[node], table[:, those], sizes[those])
            r = radius[those]
            out.extend((int(i), node, int(x)) for i, x in zip(those[d <= r], d[d <= r]))
            for x, child in self.children[node].items():
                reach = np.abs(d - x) <= r  # the triangle inequality
                if reach.any():
                    waiting.append((child, those[reach]))
        return out
