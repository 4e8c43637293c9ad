"""Bits of hashes kept in BIGINT (two's complement) or, beyond 64 bits, in ARRAY<BIGINT>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two BIGINT hashes."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def hamming_wide(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two ARRAY<BIGINT> hashes of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def pack_bits(bits: Column | str) -> Column:
    """An array of booleans, the first one highest, as a BIGINT (up to 64 of them)."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("bigint")))


def pack_wide(bits: Column | str) -> Column:
    """An array of booleans as ARRAY<BIGINT>, 64 to a word, the first one highest; a short last word is
    filled from the right."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 64).cast("int"))
    return F.when(F.size(bits) > 0, F.transform(words, lambda i: pack_bits(F.slice(bits, i * 64 + 1, 64)))).otherwise(F.array().cast("array<bigint>"))


def sign_bits(vector: Column | str) -> Column:
    """One bit for each component: positive or not."""
    return F.transform(vector, lambda x: x > 0)
