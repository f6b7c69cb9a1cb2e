"""Words and word n-grams of many texts at once, as numpy hashes over UTF-8 bytes.

Texts are taken in blocks of about BLOCK bytes, so that the arrays stay small; one longer text is a block of
its own, whole. Hashes are 64-bit polynomials with wrap-around, mixed at the end: equal words have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(32)

#: Byte classes: 0 separates words. SPACES splits at white space only; FOLDED also at ASCII punctuation, and lowers ASCII letters.
SPACES = np.arange(256, dtype=np.uint64)
SPACES[[9, 10, 12, 13, 32]] = 0
FOLDED = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        FOLDED[_b] = ord(chr(_b).lower()) if _b < 128 else _b
del _b


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown when a longer array asks."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv, self.n = base, np.uint64(_inverse(int(base))), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            up = np.full(self.n, self.base)
            down = np.full(self.n, self.inv)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_GRAM)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _MIX
    return h ^ (h >> _S)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches over the same memory, so that few texts at a time exist as Python objects too."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


class Block:
    """The words of some texts: ``hash``, byte range ``start``/``end`` in its text, and ``doc``, the text's index."""

    def __init__(self, texts: list[bytes], classes: np.ndarray, first: int) -> None:
        self.n = len(texts)
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=self.n)
        self.base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        code = classes[buf]
        inside = np.zeros(len(buf) + 1, dtype=np.int8)
        inside[1:] = code != 0
        edge = np.diff(inside)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _BYTES.upto(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((code + np.uint64(1)) * up[:-1], out=sums[1:])
        self.hash = mixed((sums[end] - sums[begin]) * down[begin])
        self.doc = np.searchsorted(self.base, begin, side="right") - 1
        self.start, self.end = begin - self.base[self.doc], end - self.base[self.doc]
        self.words = np.bincount(self.doc, minlength=self.n)
        self.offset = np.concatenate(([0], np.cumsum(self.words)))
        self.first = first  # index of the first text in its batch
        self.buf = buf

    def sums(self) -> np.ndarray:
        """Prefix sums from which ``between`` takes the hash of any run of words."""
        up, _ = _WORDS.upto(len(self.hash) + 1)
        out = np.zeros(len(self.hash) + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:-1], out=out[1:])
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of each run of ``n`` words inside one text."""
        if len(self.hash) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        if n <= 8:
            h = np.zeros(len(self.hash) - n + 1, dtype=np.uint64)
            for k in range(n):
                h = h * _GRAM + self.hash[k : k + len(h)]
            return at, mixed(h[at])
        return at, between(self.sums(), at, at + n)


def between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words lo..hi-1."""
    _, down = _WORDS.upto(len(sums))
    return mixed((sums[hi] - sums[lo]) * down[lo])


def blocks(texts: list[str], classes: np.ndarray) -> Iterator[Block]:
    """Blocks of consecutive texts. FOLDED lowers whole texts first, so that accented letters fold too."""
    part: list[bytes] = []
    size = first = 0
    for k, t in enumerate(texts):
        b = (t.lower() if classes is FOLDED else t).encode("utf-8", "replace")
        if part and size + len(b) > BLOCK:
            yield Block(part, classes, first)
            part, size, first = [], 0, k
        part.append(b)
        size += len(b) + 1
    if part:
        yield Block(part, classes, first)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` values the index of its least one, the leftmost of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(len(h))
    span = 1
    while span < w:
        step = min(span, w - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        span += step
    return best[:n]
