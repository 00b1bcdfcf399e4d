"""Encoding with a public byte-level BPE tokenizer.

A segment tree over the ranks of adjacent pairs gives, at its root, the
leftmost pair of the lowest rank; merging it changes three leaves and their
paths to the root. The trees of many words are kept side by side in arrays, so
one step merges in all of them. Words that occur again are looked up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelmill.operators.grouped import spread

#: The vocabulary is read on the driver and broadcast (under 1 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this vocabulary's tokenizer cuts text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
#: Words kept for look-up in a worker; the store is emptied beyond it.
KEPT = 400_000
#: Words longer than this (bytes) are merged one at a time.
LONG = 1024


class Encoder:
    """``encode(words)`` for a vocabulary of lines ``base64 rank``."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import regex

        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.split = regex.compile(pattern).findall
        self.first = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = []
        for word, rank in self.rank.items():
            for cut in range(1, len(word)):
                left, right = self.rank.get(word[:cut]), self.rank.get(word[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 20 | right, rank))
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.merged = np.array([r for _, r in pairs], np.int64)
        self.table = dict(pairs)
        self.known: dict[str, list[int]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], -1)

    def _merge(self, words: list[bytes], size: int) -> list[list[int]]:
        """Words of at most ``size`` bytes, a power of two, all at once."""
        n, bits = len(words), size.bit_length() - 1
        length = np.array([len(w) for w in words])
        inside = np.arange(size) < length[:, None]
        tok = np.zeros((n, size + 1), np.int64)
        tok[:, :size][inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        alive = inside.copy()
        after = np.minimum(np.arange(1, size + 1), length[:, None])  # the position that follows; ``length`` is the end
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), NONE)
        w, p = np.nonzero(inside[:, 1:])
        rank = self._ranks(tok[w, p], tok[w, p + 1])
        ok = rank >= 0
        tree[w[ok], size + p[ok]] = rank[ok] << bits | p[ok]
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        w = np.flatnonzero(tree[:, 1] < NONE)
        while len(w):
            root = tree[w, 1]
            p = root & (size - 1)
            gone = after[w, p]
            nxt = after[w, np.minimum(gone, size - 1)]
            nxt = np.where(gone < size, nxt, size)
            tok[w, p] = root >> bits
            alive[w, gone] = False
            after[w, p] = nxt
            before[w, nxt] = p
            prev = before[w, p]
            at_end, at_start = nxt >= length[w], prev < 0
            r = self._ranks(tok[w, p], tok[w, nxt])
            here = np.where((r < 0) | at_end, NONE, r << bits | p)
            prev = np.maximum(prev, 0)
            r = self._ranks(tok[w, prev], tok[w, p])
            left = np.where(r < 0, NONE, r << bits | prev)
            tree[w, size + gone] = NONE
            tree[w, size + p] = here
            inner = ~at_start
            tree[w[inner], size + prev[inner]] = left[inner]
            up = (size + gone, size + p, size + prev)
            for _ in range(bits):
                up = tuple(u >> 1 for u in up)
                for u in up:
                    tree[w, u] = np.minimum(tree[w, 2 * u], tree[w, 2 * u + 1])
            w = w[tree[w, 1] < NONE]
        flat = tok[:, :size][alive].tolist()
        ends = np.cumsum(alive.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _merge_long(self, word: bytes) -> list[int]:
        """One word of any length; its tree holds keys in a list."""
        n = len(word)
        bits = max(1, (n - 1).bit_length())
        size, mask = 1 << bits, (1 << bits) - 1
        tok = self.first[np.frombuffer(word, np.uint8)]
        rank = self._ranks(tok[:-1], tok[1:])
        leaves = np.full(size, NONE)
        leaves[: n - 1] = np.where(rank < 0, NONE, rank << bits | np.arange(n - 1))
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
        tree = [NONE]
        for level in reversed(levels):
            tree.extend(level.tolist())
        tok, after, before, table, none = tok.tolist(), list(range(1, n + 1)), list(range(-1, n)), self.table, int(NONE)

        def put(p: int, key: int) -> None:
            u = size + p
            tree[u] = key
            u >>= 1
            while u:
                a, b = tree[2 * u], tree[2 * u + 1]
                a = a if a < b else b
                if tree[u] == a:
                    break
                tree[u] = a
                u >>= 1

        while (root := tree[1]) < none:
            p = root & mask
            gone = after[p]
            nxt = after[gone]
            tok[p], tok[gone] = root >> bits, -1
            after[p] = nxt
            put(gone, none)
            if nxt < n:
                before[nxt] = p
                r = table.get(tok[p] << 20 | tok[nxt])
                put(p, none if r is None else r << bits | p)
            else:
                put(p, none)
            prev = before[p]
            if prev >= 0:
                r = table.get(tok[prev] << 20 | tok[p])
                put(prev, none if r is None else r << bits | prev)
        return [t for t in tok if t >= 0]

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't known yet."""
        if len(self.known) + len(words) > KEPT:
            self.known.clear()
        classes: dict[int, list[str]] = {}
        for word in words:
            raw = word.encode()
            whole = self.rank.get(raw) if len(raw) == 1 else None
            if whole is not None:
                self.known[word] = [whole]
            elif len(raw) > LONG:
                self.known[word] = self._merge_long(raw)
            else:
                classes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(word)
        for size, own in classes.items():
            step = max(1, 400_000 // size)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                self.known.update(zip(part, self._merge([x.encode() for x in part], size)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(words))
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
        self.learn(new - self.known.keys())
        return [list(chain.from_iterable(map(self.known.__getitem__, w))) for w in words]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def encoder(vocabulary: bytes) -> Encoder:
    """One encoder a worker process, with the words it knows already."""
    return Encoder(vocabulary)


def encode_corpus(df: DataFrame, item: str, text: str, vocabulary: str = VOCABULARY, count: bool = False) -> DataFrame:
    """``item, ids`` of every row; with ``count``, ``item, tokens``, the number of ids.

    Null and empty texts give an empty list (0 tokens). Texts are encoded whole,
    without special tokens; strings that spell a special token are ordinary
    text. No shuffle, unless the scan has fewer partitions than there are cores.
    """
    held = df.sparkSession.sparkContext.broadcast(_read(vocabulary))
    kind = dict(df.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                ids = own.encode(part.column(1).to_pylist())
                if count:
                    out = pa.array([len(x) for x in ids], pa.int64())
                else:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[item, "tokens" if count else "ids"])

    return spread(df.select(item, text)).mapInArrow(run, f"`{item}` {kind}, " + ("tokens long" if count else "ids array<int>"))
