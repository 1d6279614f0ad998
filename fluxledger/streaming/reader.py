"""Reading a topic of a catalogue as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import _MARKER, _ROW, Catalog


def read_log_stream(catalog: Catalog, name: str, max_produces_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of partition, first_offset, last_offset, produce: one row per finished produce and partition, in the order they were finished.

    Markers are the stream: a produce arrives when its marker does, so unfinished ones are never seen. `records_of`
    turns a micro-batch of it into records.
    """
    topic = catalog._topic(name)
    reader = catalog.spark.readStream.schema(_MARKER)
    if max_produces_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_produces_per_trigger)
    return reader.json(f"{catalog._folder(topic)}/markers")


def records_of(catalog: Catalog, name: str, markers: DataFrame) -> DataFrame:
    """The records of a micro-batch of read_log_stream: partition, record_offset, timestamp, key, value, header_keys, header_values; other produces are pruned."""
    folder = f"{catalog._folder(catalog._topic(name))}/data"
    data = catalog.spark.read.schema(_ROW).option("basePath", folder).parquet(folder)
    rows = data.join(F.broadcast(markers.select("produce", "partition", "first_offset")), ["produce", "partition"])
    return rows.select("partition", (F.col("first_offset") + F.col("place")).alias("record_offset"), "timestamp", "key", "value", "header_keys", "header_values")
