"""Access to record headers kept as parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_value(name: str, keys: str = "header_keys", values: str = "header_values") -> Column:
    """Value of the first header called `name`; null if there is none or its value is null."""
    return F.get(F.col(values), F.nullif(F.array_position(keys, name), F.lit(0).cast("long")).cast("int") - 1)


def header_exists(name: str, keys: str = "header_keys") -> Column:
    return F.array_contains(keys, name)
