"""Sequence, time and epoch arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQUENCES = 1 << 31


def seq_add(sequence: Column, n: Column | int) -> Column:
    """Sequence number n records later; 2^31 - 1 is followed by 0, and an absent (negative) one stays absent."""
    return F.when(sequence >= 0, F.pmod(sequence.cast("long") + n, F.lit(SEQUENCES).cast("long")).cast("int"))


def seq_follows(last: Column, first: Column) -> Column:
    return first == seq_add(last, 1)


def ms_ceil(ts: Column) -> Column:
    """A timestamp bound in epoch milliseconds, rounded up; before the epoch it counts as 0."""
    return F.greatest(F.lit(0).cast("long"), F.ceil(F.unix_micros(ts.cast("timestamp")) / 1000))


def epoch_base(timeline: Column) -> Column:
    """First leader epoch of a timeline."""
    return ((timeline - 1) * 65536).cast("int")
