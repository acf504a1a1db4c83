"""Words and hashed shingles of a batch of texts, straight from an Arrow buffer.

A word is a run of the characters 0-9, a-z and all beyond ASCII, after A-Z are lower-cased. In UTF-8 every byte of a
character beyond ASCII is 0x80 or more, so one table over bytes decides this exactly. A word's 64-bit hash is a
polynomial over its bytes modulo 2**64, taken from prefix sums and then mixed. Words of more than LONG_WORD bytes, for
which such polynomials have known collisions, are hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_B, _M = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_B_INV = pow(_B, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
_VALUE = LOWER.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA5A5A5A5A5A5A5A5)
_SLICE = 1 << 19
LONG_WORD = 256
_pow: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, _SLICE + 4096)
        up = np.full(size, _B, np.uint64)
        down = np.full(size, _B_INV, np.uint64)
        up[0] = down[0] = 1
        _pow[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _pow[0], _pow[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and for each text the index of its first word (one more at the end)."""
    n = len(raw)
    w = IS_WORD[raw]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = w[cut]
    last[cut - 1] = w[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, base + _SLICE)))
        stop = int(end[j - 1])
        up, down = _powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_VALUE[raw[base:stop]] * up[: stop - base], out=sums[1:])
        a, b = start[i:j] - base, end[i:j] - base
        h[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    h = mix(h + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(LOWER[raw[start[k] : end[k]]].tobytes(), digest_size=8).digest(), "little")
    return start, end, h, np.searchsorted(start, off)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, from every word on; the caller leaves out those that cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[j : n + j]
    return mix(out)


def release() -> None:
    """Give freed memory back to the system; workers live on from task to task beside an executor of bounded memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def text_words(text: str) -> list[str]:
    """The words of one text, plainly; what tests compare with."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
