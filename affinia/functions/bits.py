"""Packed bit vectors as ARRAY<BIGINT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def pack_signs(array: str, bits: int = WORD) -> Column:
    """Bit i of word i // 64 is set if value i of the named array column is positive; an array of words.

    Written out as one SQL expression, so that it is compiled and costs the driver a single call.
    """
    bit = lambda i: f"IF(get(`{array}`, {i}) > 0, {'(-9223372036854775807L - 1L)' if i % WORD == 63 else f'{1 << i % WORD}L'}, 0L)"
    words = [" | ".join(bit(i) for i in range(w, min(w + WORD, bits))) for w in range(0, bits, WORD)]
    return F.expr(f"array({', '.join(words)})")


def popcount(words: Column, n: int = 1) -> Column:
    """Bits set in the first n words; unrolled, so that it stays in generated code."""
    return sum((F.bit_count(F.get(words, F.lit(i))) for i in range(1, n)), F.bit_count(F.get(words, F.lit(0))))


def common(a: Column, b: Column, n: int = 1) -> Column:
    both = lambda i: F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i))))
    return sum((both(i) for i in range(1, n)), both(0))


def tanimoto(a: Column, b: Column, pop_a: Column, pop_b: Column, n: int = 1) -> Column:
    """Shared bits over all bits set in either; 0 where neither has any."""
    shared = common(a, b, n)
    union = pop_a + pop_b - shared
    return F.when(union > 0, shared.cast("double") / union).otherwise(F.lit(0.0))


def band(pop_a: Column, pop_b: Column, least: float) -> Column:
    """What two popcounts must satisfy for a similarity of least or more (Swamidass and Baldi 2007)."""
    return F.lit(True) if least <= 0 else (pop_b >= F.ceil(pop_a * least - 1e-9)) & (pop_b <= F.floor(pop_a / least + 1e-9))
