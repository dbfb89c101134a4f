"""Byte-level BPE encoding by speculation and verification.

A text is cut into words by vectorised character-class rules, words are told
apart by 64-bit hashes, and only words not met before are encoded.  Those are
*speculated*: a greedy longest match over the vocabulary proposes tokens.  A
proposal is the true encoding exactly if every adjacent pair of tokens is
*compatible*, that is if encoding the two tokens' joined bytes gives the two
tokens back; all distinct pairs of a batch are tested together with array
operations.  Only words with an incompatible pair undergo exact merging.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Words whose encodings a worker keeps; beyond it the store starts anew (results don't change).
WORD_STORE = 1_000_000

LETTER, NUMBER, SPACE, OTHER, EDGE = 0, 1, 2, 3, 4
#: What may follow an apostrophe as a word of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point under the public pattern's \\p{L}, \\p{N} and \\s."""
    import regex

    out = np.full(0x110000 + 1, OTHER, np.uint8)
    out[0x110000] = EDGE
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a : b + 1] = kind
            else:  # a run across the surrogates
                out[[ord(c) for c in m[0]]] = kind
    return out


def _byte_chars() -> dict[str, int]:
    """The public byte-to-character table of byte-level vocabularies, by its rule:
    printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and splits of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = _byte_chars()
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.rank_of = {(a, b): i for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist()))}
        self.result = np.array([ids[a + b] for a, b in pairs], np.int64)
        # in the compatibility test a token counts by its place in the order of merges: single bytes first
        size = max(ids.values()) + 1
        self.order = np.full(size, -1, np.int64)
        merged = set(self.result.tolist())
        singles = [i for t, i in ids.items() if i not in merged and len(t) == 1 and t in chars]
        self.order[singles] = np.arange(len(singles))
        self.base = len(singles)
        self.order[self.result] = self.base + np.arange(len(pairs))
        known = {bytes(chars[c] for c in t): i for t, i in ids.items() if self.order[i] >= 0}
        self.tokens: dict[bytes, int] = known
        self.byte = np.array([known[bytes([b])] for b in range(256)], np.int64)
        # every beginning of a token: the token, or -1 for a mere beginning
        self.beginnings: dict[bytes, int] = {t[:i]: -1 for t in known for i in range(1, len(t))} | known
        # by order: the two parts a token is made of (a single byte: itself)
        n = self.base + len(pairs)
        self.part_a, self.part_b = np.arange(n), np.arange(n)
        self.part_a[self.base :], self.part_b[self.base :] = self.order[self.left], self.order[self.right]
        key = self.order[self.left] << 32 | self.order[self.right]
        by = np.argsort(key)
        self.pair_key, self.pair_order = key[by], self.base + by

    # ---- speculation ----

    def longest_match(self, word: bytes) -> list[int]:
        beginnings, out, i, n = self.beginnings, [], 0, len(word)
        while i < n:
            end = i + 1
            token, stop = beginnings[word[i:end]], end
            while end < n and (t := beginnings.get(word[i : end + 1])) is not None:
                end += 1
                if t >= 0:
                    token, stop = t, end
            out.append(token)
            i = stop
        return out

    # ---- verification ----

    def compatible(self, a: np.ndarray, b: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """For each pair of token ids whether their joined bytes encode to just these two.

        The pair is compatible unless some merge across their border would have come
        before the merges that made the two.  Both sides are taken apart from the
        latest merge backwards; at each step the two tokens touching the border are
        looked up.  ``within``: only merges of an earlier order than this count.
        """
        x, y = self.order[a].copy(), self.order[b].copy()
        limit = np.full(len(x), np.iinfo(np.int64).max) if within is None else within.copy()
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            u, v, lim = x[live], y[live], limit[live]
            key = u << 32 | v
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            clash = (self.pair_key[at] == key) & (self.pair_order[at] < lim)
            good[live[clash]] = False
            single_u, single_v = self.part_a[u] == u, self.part_a[v] == v
            # the later-made token is taken apart; a single byte can't be
            take_u = ~single_u & ((u > v) | single_v)
            take_v = ~single_v & ~take_u
            # a merge across the border beats the left token's last merge on an earlier rank only,
            # the right token's also on an equal one: the leftmost of equal merges comes first
            x[live] = np.where(take_u, self.part_b[u], u)
            y[live] = np.where(take_v, self.part_a[v], v)
            limit[live] = np.where(take_u, u, np.where(take_v, v + 1, lim))
            live = live[~clash & (take_u | take_v)]
        return good

    # ---- exact merging ----

    def merge(self, word: bytes) -> list[int]:
        """The encoding by merging, lowest rank first, leftmost among equals."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, result = self.rank_of, self.result
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(result[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := ranks.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (s := ranks.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Encodings of words, and how many of them needed exact merging."""
        guess = [[t] if (t := self.tokens.get(w)) is not None and not self.unreachable(t) else self.longest_match(w) for w in words]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(guess)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else word
        bad: set[int] = set()
        if len(inner):
            pairs, which = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            bad.update(word[inner[~good[which]]].tolist())
        if self._unreachable is not None and len(self._unreachable):
            bad.update(word[np.isin(flat, self._unreachable)].tolist())
        for i in bad:
            guess[i] = self.merge(words[i])
        return guess, len(bad)

    _unreachable: np.ndarray | None = None

    def unreachable(self, token: int) -> bool:
        """Whether merging a token's own bytes doesn't give the token (none in well-made vocabularies)."""
        if self._unreachable is None:
            made = ~self.compatible(self.left, self.right, self.order[self.result])
            self._unreachable = np.unique(self.result[made])
        return bool(len(self._unreachable)) and token in self._unreachable


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where words begin in code points of which each text ends with one EDGE mark.

    The public pattern as local rules: runs of letters, numbers and other signs are
    words and take a single space before them along; of a run of white space before
    a word its last character stands apart (or goes along, if it is a space);
    apostrophe contractions are words where the apostrophe begins one.
    """
    n = len(points)
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    space, blank = kind == SPACE, points == 32
    word = kind < SPACE
    word |= kind == OTHER
    last = np.zeros(n, bool)  # last of a run of white space, before a word
    last[:-1] = space[:-1] & word[1:]
    begin |= last | (kind == EDGE)
    begin[1:] &= ~(last[:-1] & blank[:-1])
    quote = np.flatnonzero(points[:-1] == 39)
    if len(quote):
        before = points[np.maximum(quote - 1, 0)]
        quote = quote[(quote == 0) | (before != 32) & ((kind[np.maximum(quote - 1, 0)] != OTHER))]
        for c in CONTRACTIONS:
            at = quote[quote + len(c) < n]
            for i, x in enumerate(c):
                at = at[points[at + 1 + i] == ord(x)]
            begin[at] = True
            begin[at + 1] = False
            if len(c) == 2:
                begin[at + 2] = False
            end = at + 1 + len(c)
            end = end[end < n]
            begin[end[kind[end] == LETTER]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes batches of texts, keeping the encodings of the words it has met."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.words = vocabulary(path)
        self.forget()
        self.met = self.exact = 0

    def forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(hashes) > WORD_STORE and len(self.hashes):
            raise MemoryError
        found, exact = self.words.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        self.met += len(words)
        self.exact += exact
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.fromiter((t for f in found for t in f), np.int32, int(size.sum()))])
        hashes = np.concatenate([self.hashes, hashes])
        by = np.argsort(hashes)
        self.hashes = hashes[by]
        self.at, self.size = np.concatenate([self.at, at])[by], np.concatenate([self.size, size])[by]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids of each); null and empty texts have none."""
        kept = [t or "" for t in texts]
        lengths = np.fromiter(map(len, kept), np.int64, len(kept))
        joined = "\x00".join(kept) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        edges = np.cumsum(lengths + 1) - 1
        points[edges] = 0x110000
        kind = _classes()[points]
        starts = word_starts(points, kind)
        edge = points[starts] == 0x110000
        ends = np.append(starts[1:], len(points))
        place = np.arange(len(points), dtype=np.uint64)
        place -= np.repeat(starts.astype(np.uint64), ends - starts)
        hashed = np.add.reduceat(_mix(points.astype(np.uint64) + (place << np.uint64(21)) + np.uint64(0x9E3779B97F4A7C15)), starts) if len(starts) else np.empty(0, np.uint64)
        doc = np.cumsum(edge) - edge  # edge words close their text
        starts, ends, hashed, doc = starts[~edge], ends[~edge], hashed[~edge], doc[~edge]
        distinct, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = where < len(self.hashes)
        new[inside] = self.hashes[where[inside]] != distinct[inside]
        if new.any():
            if len(self.hashes) + new.sum() > WORD_STORE:
                self.forget()
                new[:] = True
            self._learn(distinct[new], [joined[starts[i] : ends[i]] for i in first[new].tolist()])
            where = np.searchsorted(self.hashes, distinct)
        at, size = self.at[where][which], self.size[where][which]
        total = int(size.sum())
        offset = np.cumsum(size) - size
        ids = self.pool[np.arange(total) - np.repeat(offset - at, size)]
        return ids, np.bincount(doc, weights=size, minlength=len(kept)).astype(np.int64)
