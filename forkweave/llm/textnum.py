"""Words of a batch of texts as numpy arrays: one pass over bytes, no loop over words.

Words are runs of anything but space and tab to carriage return; A-Z count as a-z in hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
#: Odd multipliers by place in a shingle.
_PLACE = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_P, _INV)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[k] = np.cumprod(t)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batches(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """First place and UTF-8 of texts, of about `most` bytes together; a longer text stands alone."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def prefix_sums(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums from which Words.span() hashes any span of bytes, as mapped by table."""
    n = len(buf)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((table[buf].astype(np.uint64) + np.uint64(1)) * _tables(n + 1)[0][:n], out=out[1:])
    return out


class Words:
    """Bytes, word bounds and owners of a few texts."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.doc_start = np.cumsum(sizes + 1) - sizes - 1
        self.doc_end = self.doc_start + sizes
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = ~SPACE[self.buf]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)

    def sums(self, table: np.ndarray = LOWER) -> np.ndarray:
        return prefix_sums(self.buf, table)

    @staticmethod
    def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * _tables(len(sums))[1][start])

    def shingles(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Owner and hash of each run of n words; a text with fewer words has them all as one run, one without words none."""
        h = self.span(self.sums(), self.start, self.end) if hashes is None else hashes
        full = max(0, len(h) - n + 1)
        owner = self.doc[:full]
        ok = owner == self.doc[n - 1 : n - 1 + full] if full else np.zeros(0, bool)
        g = np.zeros(full, np.uint64)
        for k in range(n):
            g += h[k : k + full] * _PLACE[k]
        owner, g = owner[ok], mix(g[ok])
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if len(short):
            at = np.searchsorted(self.doc, short)
            s = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                has = self.count[short] > k
                s[has] += h[at[has] + k] * _PLACE[k]
            g = np.concatenate([g, mix(s + self.count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))])
            owner = np.concatenate([owner, short])
        return owner, g

    def shingle_sets(self, n: int) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        owner, g = self.shingles(n)
        order = np.lexsort((g, owner))
        owner, g = owner[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        owner, g = owner[new], g[new]
        at = np.searchsorted(owner, np.arange(self.n + 1))
        return [g[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
