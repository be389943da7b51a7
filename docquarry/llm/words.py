"""Hashes of words and word windows for a whole batch of texts at once, in numpy.

A word is a maximal run of bytes other than the six ASCII white-space bytes, so
every text is handled as UTF-8 without being cut into Python strings.  Hashes
are polynomials modulo 2**64 over random byte codes, then mixed; they depend on
content only, never on the process or the batch.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BLOCK = 1 << 18
BASE_WORD, BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 12)
            grow = lambda b: np.cumprod(np.concatenate([np.ones(1, U), np.full(m - 1, b, U)]), dtype=U)
            self.up, self.down = grow(U(self.base)), grow(U(self.inverse))
        return self.up, self.down


_POWERS = {b: _Powers(b) for b in (BASE_WORD, BASE_A, BASE_B)}


def _spans_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of codes[start:end] for ascending spans."""
    up, down = _POWERS[base].get(len(codes) + 1)
    total = np.empty(len(codes) + 1, U)
    total[0] = 0
    np.cumsum(codes * up[: len(codes)], dtype=U, out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text, in order; where each text's words begin, with the end appended)."""
    buf = b"\n".join(texts) + b"\n"
    if lower:
        buf = buf.lower()
    a = np.frombuffer(buf, np.uint8)
    blank = _SPACE[a]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):  # in blocks, so that memory does not follow the length of one text
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK)))
        at, to = starts[i], ends[j - 1]
        out[i:j] = _spans_hash(_CODE[a[at:to]], starts[i:j] - at, ends[i:j] - at, BASE_WORD)
        i = j
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return mix(out), offsets


def window_hashes(words: np.ndarray, width: int, base: int = BASE_A) -> np.ndarray:
    """Hash of words[i:i+width] for every i that has so many; texts' borders are the caller's business."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U)
    at = np.arange(n)
    return mix(_spans_hash(words, at, at + width, base))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_B) -> np.ndarray:
    return mix(_spans_hash(words, starts, ends, base))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i that has so many."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:n], out[width - step : width - step + n])


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa

    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]
