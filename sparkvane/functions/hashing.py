"""FNV-1a hashes and shard routing as columns.

Spark has no unsigned 64-bit type, so a 64-bit hash is kept as two unsigned 32-bit
halves in longs; its order is that of (hi, lo).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash functions.
OFFSET_32, PRIME_32 = 2166136261, 16777619
OFFSET_64_HI, OFFSET_64_LO, PRIME_64_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
MASK = 0xFFFFFFFF


def _chars(text: Column) -> Column:
    """The characters of a text; splitting the empty one gives one empty part."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def fnv32(text: Column) -> Column:
    """32-bit hash over UTF-16 code units: a character beyond the basic plane counts as its two surrogates."""

    def unit(h: Column, x: Column) -> Column:
        return (h.bitwiseXOR(x) * F.lit(PRIME_32)).bitwiseAND(F.lit(MASK))

    def step(h: Column, c: Column) -> Column:
        point = F.ascii(c).cast("long")
        above = point - F.lit(0x10000)
        pair = unit(unit(h, F.shiftright(above, 10) + F.lit(0xD800)), above.bitwiseAND(F.lit(0x3FF)) + F.lit(0xDC00))
        return F.when(point < F.lit(0x10000), unit(h, point)).otherwise(pair)

    return F.aggregate(_chars(text), F.lit(OFFSET_32).cast("long"), step)


def fnv64(text: Column) -> Column:
    """64-bit hash of an ASCII text, as struct<hi, lo>."""
    start = F.struct(F.lit(OFFSET_64_HI).cast("long").alias("hi"), F.lit(OFFSET_64_LO).cast("long").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        x = h["lo"].bitwiseXOR(F.ascii(c).cast("long"))
        low = x * F.lit(PRIME_64_LOW)
        # the prime is 2^40 + 0x1b3: its upper part moves x into the high half, 8 bits up
        high = h["hi"] * F.lit(PRIME_64_LOW) + F.shiftrightunsigned(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), low.bitwiseAND(F.lit(MASK)).alias("lo"))

    return F.aggregate(_chars(text), start, step)


def fnv64_modulo(hash_: Column, n: int) -> Column:
    return (((hash_["hi"] % n) * F.lit(2**32 % n) + hash_["lo"] % n) % n).cast("int")


def route_shard(key: Column, shards: int) -> Column:
    """The logical shard of a record id (or any key whose text is ASCII)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    return fnv64_modulo(fnv64(key.cast("string")), shards)
