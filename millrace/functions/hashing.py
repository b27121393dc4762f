"""The two 32-bit hashes of routing filters, as expressions on UTF-16 units, and filter arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def utf16_units(text: Column) -> Column:
    """The UTF-16 code units of a text as ARRAY<BIGINT>."""

    def units(i: Column) -> Column:
        code = F.ascii(F.substring(text, i, F.lit(1))).cast("bigint")
        rest = code - 0x10000
        pair = F.array(F.lit(0xD800) + F.shiftright(rest, 10), F.lit(0xDC00) + rest.bitwiseAND(F.lit(1023)))
        return F.when(code < 0x10000, F.array(code)).otherwise(pair.cast("array<bigint>"))

    return F.when(F.length(text) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), units))).otherwise(F.array().cast("array<bigint>"))


def fnv32(text: Column) -> Column:
    """FNV-1a over UTF-16 units, as an unsigned 32-bit number in a BIGINT."""
    return F.aggregate(utf16_units(text), F.lit(0x811C9DC5).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 0x01000193).bitwiseAND(F.lit(_MASK)))


def fnv_quarters(text: Column, prefixes: list[str]) -> list[Column]:
    """The low two bits of ``fnv32`` of each prefix before the text, in one pass over the text: these bits depend on nothing but the low
    two bits of the state, so the pass carries where each of the four states leads."""
    states = F.aggregate(utf16_units(text), F.array(*[F.lit(i).cast("bigint") for i in range(4)]), lambda s, c: F.transform(s, lambda h: (h.bitwiseXOR(c) * 3).bitwiseAND(F.lit(3))))
    out = []
    for prefix in prefixes:
        state = 0x811C9DC5 & 3
        for unit in prefix:
            state = (state ^ ord(unit)) * 3 & 3
        out.append(F.element_at(states, state + 1))
    return out


def mixed32(text: Column) -> Column:
    """The second hash, always odd. The multiplier is applied in halves, as the whole product would overflow a BIGINT."""
    times = 0x85EBCA6B

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        high = (x * (times >> 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
        y = (x * (times & 0xFFFF) + high).bitwiseAND(F.lit(_MASK))
        return y.bitwiseXOR(F.shiftrightunsigned(y, 13))

    return F.aggregate(utf16_units(text), F.lit(0x9E3779B9).cast("bigint"), step).bitwiseOR(F.lit(1).cast("bigint"))


def bloom_size(tokens: Column, least: int, most: int, bits_per_token: int = 10) -> Column:
    """Bits of a filter: ten a token within the bounds, rounded up to a power of two (powers as a ladder, free of rounding)."""
    wanted = F.least(F.greatest(tokens.cast("bigint") * bits_per_token, F.lit(least).cast("bigint")), F.lit(most).cast("bigint"))
    size = F.lit(1 << 40).cast("bigint")
    for power in range(39, -1, -1):
        size = F.when(wanted <= (1 << power), F.lit(1 << power).cast("bigint")).otherwise(size)
    return size


def bloom_positions(a: Column, b: Column, bits: Column, hashes: int = 4) -> Column:
    """The bit positions of a token with hashes ``a`` and ``b`` in a filter of ``bits`` (a power of two)."""
    return F.array(*[(a + b * i).bitwiseAND(bits - 1) for i in range(hashes)])


def digest12(text: Column) -> Column:
    """The first 12 hex digits of the SHA-256: the content address in file names."""
    return F.substring(F.sha2(text, 256), 1, 12)
