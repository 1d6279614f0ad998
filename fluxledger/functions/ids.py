"""Log positions and packed producer ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lsn_parse(text: Column) -> Column:
    """'16/B374D848' to a long."""
    part = lambda i: F.conv(F.get(F.split(text, "/"), i), 16, 10).cast("long")
    return F.shiftleft(part(0), 32) + part(1)


def lsn_format(lsn: Column) -> Column:
    return F.concat_ws("/", F.hex(F.shiftrightunsigned(lsn, 32)), F.hex(lsn.bitwiseAND(0xFFFFFFFF)))


def lsn_diff(a: Column, b: Column) -> Column:
    return a - b


def pack_producer_id(boot: Column, generation: Column, xid: Column) -> Column:
    """Producer id of an SQL produce: a flag bit, 12 bits of boot, 10 of generation, 40 of transaction."""
    wide = lambda c, n: c.cast("long").bitwiseAND((1 << n) - 1)
    return F.lit(1 << 62).bitwiseOR(F.shiftleft(wide(boot, 12), 50)).bitwiseOR(F.shiftleft(wide(generation, 10), 40)).bitwiseOR(wide(xid, 40))


def unpack_producer_id(pid: Column) -> Column:
    """struct<boot, generation, xid>, null for ids without the flag bit."""
    field = lambda shift, n: F.shiftrightunsigned(pid, shift).bitwiseAND((1 << n) - 1)
    parts = F.struct(field(50, 12).alias("boot"), field(40, 10).alias("generation"), field(0, 40).alias("xid"))
    return F.when(pid.bitwiseAND(1 << 62) != 0, parts)
