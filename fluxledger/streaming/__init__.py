"""Streams: change mappings drained into topics with a position ledger, and reading a topic as a stream."""

from .drain import ChangeMappings, change_rows, snapshot_changes
from .reader import read_log_stream

__all__ = ["ChangeMappings", "change_rows", "read_log_stream", "snapshot_changes"]
