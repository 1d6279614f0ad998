"""Scalar functions of the log engine as pure Column expressions (no Python workers)."""

from .hashing import group_slot, java_hash, murmur2, partition_for
from .headers import header_exists, header_value
from .ids import lsn_diff, lsn_format, lsn_parse, pack_producer_id, unpack_producer_id
from .numbers import epoch_base, ms_ceil, seq_add, seq_follows
from .text import anchored, quote_ident, sql_literal, valid_topic_name

__all__ = [
    "anchored", "epoch_base", "group_slot", "header_exists", "header_value", "java_hash", "lsn_diff", "lsn_format", "lsn_parse",
    "ms_ceil", "murmur2", "pack_producer_id", "partition_for", "quote_ident", "seq_add", "seq_follows", "sql_literal",
    "unpack_producer_id", "valid_topic_name",
]
