"""Key hashing of Kafka clients: murmur2 for partitions, Java's string hash for group slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 0x5BD1E995
_SEED = 0x9747B28C
_WORD = 1 << 32


def _mul(x: Column) -> Column:
    return F.pmod(x * F.lit(_M).cast("long"), F.lit(_WORD).cast("long"))


def _byte(hexed: Column, i: Column) -> Column:
    return F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long")


def murmur2(key: Column) -> Column:
    """Signed 32-bit murmur2 of a binary or string key; null for null."""
    hexed = F.hex(key)
    size = (F.length(hexed) / 2).cast("int")
    words = F.floor(size / 4).cast("int")

    def step(h: Column, i: Column) -> Column:
        k = _byte(hexed, i * 4) + F.shiftleft(_byte(hexed, i * 4 + 1), 8) + F.shiftleft(_byte(hexed, i * 4 + 2), 16) + F.shiftleft(_byte(hexed, i * 4 + 3), 24)
        k = _mul(k)
        k = _mul(k.bitwiseXOR(F.shiftright(k, 24)))
        return _mul(h).bitwiseXOR(k)

    start = F.lit(_SEED).cast("long").bitwiseXOR(size.cast("long"))
    body = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(body, start, step)
    at, rest = words * 4, size - words * 4
    tail = F.when(rest >= 3, F.shiftleft(_byte(hexed, at + 2), 16)).otherwise(0) + F.when(rest >= 2, F.shiftleft(_byte(hexed, at + 1), 8)).otherwise(0) + F.when(rest >= 1, _byte(hexed, at)).otherwise(0)
    h = F.when(rest > 0, _mul(h.bitwiseXOR(tail))).otherwise(h)
    h = _mul(h.bitwiseXOR(F.shiftright(h, 13)))
    h = h.bitwiseXOR(F.shiftright(h, 15))
    return F.when(h >= _WORD // 2, h - _WORD).otherwise(h).cast("int")


def partition_for(key: Column, partitions: int | Column) -> Column:
    """Partition of a key among `partitions`; a null key goes to partition 0."""
    n = partitions if isinstance(partitions, Column) else F.lit(partitions)
    return F.coalesce(F.pmod(murmur2(key).bitwiseAND(0x7FFFFFFF), n), F.lit(0)).cast("int")


def java_hash(text: Column) -> Column:
    """Java's String.hashCode for characters of the basic plane."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + F.ascii(c), F.lit(_WORD).cast("long")))
    return F.when(h >= _WORD // 2, h - _WORD).otherwise(h).cast("int")


def group_slot(group_id: Column, slots: int = 50) -> Column:
    """Slot of a group among the offset partitions: abs(hash) % slots, and 0 for the one hash without an absolute value."""
    h = java_hash(group_id)
    return F.when(h == -(1 << 31), 0).otherwise(F.pmod(F.abs(h.cast("long")), F.lit(slots))).cast("int")
