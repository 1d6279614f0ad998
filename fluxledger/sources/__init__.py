"""Reading and writing logs, and the catalogue of topics."""

from .catalog import Catalog, ProduceError
from .log import fetch_page, find_offsets, last_n, list_offsets, partition_offsets, read_log, resolve_ranges
from .sink import assign_offsets, number_rows, validate_produce, write_log

__all__ = [
    "Catalog", "ProduceError", "assign_offsets", "fetch_page", "find_offsets", "last_n", "list_offsets", "number_rows", "partition_offsets", "read_log",
    "resolve_ranges", "validate_produce", "write_log",
]
