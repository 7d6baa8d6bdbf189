"""Word shingles of whole texts as 64-bit hashes, computed on UTF-8 bytes with numpy."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

CHUNK = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_STEPS = [pow(0xD1B54A32D192ED03, k + 1, 1 << 64) for k in range(64)]
#: Longer words are hashed one by one.
LONG_WORD = 256
_BYTES = np.arange(8)
_MASKS = np.array([0, *[(1 << 8 * k) - 1 for k in range(1, 9)]], dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Hashing:
    """Hashes of words, shingles and sets under a secret ``seed``, so that colliding texts can't be built.

    Every task of one run has the same seed. ``apart`` keeps sets apart whose 64-bit keys are equal: by key
    the second hash of the sets that keep it; other sets with that key get a key of both hashes.
    """

    seed: int = 0
    apart: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def fresh() -> Hashing:
        return Hashing(secrets.randbits(63))

    def words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each word ``raw[start:end]``, taken in steps of eight bytes; ``raw`` has eight more bytes at its end."""
        size = end - start
        h = mix(size.astype(np.uint64) ^ np.uint64(self.seed))
        open_ = np.flatnonzero(size <= LONG_WORD)
        k = 0
        while len(open_):
            left = np.minimum(size[open_] - 8 * k, 8)
            piece = raw[(start[open_] + 8 * k)[:, None] + _BYTES].view(np.uint64)[:, 0] & _MASKS[left]
            h[open_] = mix((h[open_] ^ piece) * np.uint64(_STEPS[1]) + np.uint64(self.seed >> 1 | 1))
            k += 1
            open_ = open_[size[open_] > 8 * k]
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            h[w] = int.from_bytes(hashlib.blake2b(raw[start[w] : end[w]].tobytes(), digest_size=8, key=self.seed.to_bytes(8)).digest())
        return h

    def sets(self, texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
        """Per text its sorted distinct shingles of ``k`` words; fewer words are one shingle, none an empty set."""
        at = 0
        while at < len(texts):
            size, past = 0, at
            while past < len(texts) and (past == at or size + len(texts[past] or b"") <= CHUNK):
                size += len(texts[past] or b"") + 1
                past += 1
            yield from self._chunk([t or b"" for t in texts[at:past]], k)
            at = past

    def _chunk(self, texts: list[bytes], k: int) -> Iterator[np.ndarray]:
        raw = np.frombuffer(b"\n".join([*texts, b""]).translate(_LOWER) + bytes(8), dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        word = ~_SPACE[raw[:-8]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        h = self.words(raw, start, end)
        doc = np.searchsorted(ends, start, side="right")
        n = len(h) - k + 1
        if n > 0:
            s = np.zeros(n, dtype=np.uint64)
            for j in range(k):
                s += h[j : j + n] * np.uint64(_STEPS[j])
            s = mix(s)[doc[:n] == doc[k - 1 :]]
            of = doc[:n][doc[:n] == doc[k - 1 :]]
        else:
            s, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        words = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d in range(len(texts)):
            a, b = words[d], words[d + 1]
            if b - a >= k:
                yield np.unique(s[cut[d] : cut[d + 1]])
            elif b > a:
                steps = np.array([*_STEPS[: b - a], int(b - a)], dtype=np.uint64)
                yield mix((np.append(h[a:b], np.uint64(1)) * steps).sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.zeros(0, dtype=np.uint64)

    def first(self, tokens: np.ndarray) -> int:
        """A hash for a set; equal sets have equal ones."""
        return int(mix(mix(np.append(tokens, np.uint64(len(tokens)))).sum(dtype=np.uint64, keepdims=True))[0])

    def second(self, tokens: np.ndarray) -> int:
        """Another such hash; both together are the identity of a set."""
        return int(mix(mix(tokens * np.uint64(_STEPS[2]) ^ np.uint64(self.seed)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))[0])

    def key(self, tokens: np.ndarray) -> int:
        """One number for a set: :meth:`first`, unless that stands for another set."""
        found = self.first(tokens)
        if found in self.apart and (other := self.second(tokens)) != self.apart[found]:
            return int(mix(np.array([found], dtype=np.uint64) ^ mix(np.array([other], dtype=np.uint64)))[0])
        return found
