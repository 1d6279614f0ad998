"""Writing logs: places within a partition, validation, stored logs in offset order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import delete, new_folder


#: Small Parquet pages, so that bounds on offset and time skip pages within a row group too.
PAGES = {"parquet.page.row.count.limit": "2000"}


def number_rows(rows: DataFrame, by: list[str], order: list[str], name: str = "place", ranges: int | None = None) -> tuple[DataFrame, str]:
    """rows with their place (from 0) within `by` in the given order, and the scratch folder they are read from.

    A sorted range of rows per task, stored with the row's number in it, and sums over ranges (a row per range and
    value of `by`): a partition with most of the rows is cut into many, and placed rows need no shuffle of their own.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "numbered")
    cut = rows.repartitionByRange(*([ranges] if ranges else []), *by, *order).sortWithinPartitions(*by, *order)
    cut.withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)  # range in the upper 31 bits, row in the lower 33
    stored = spark.read.parquet(folder).withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = runs.select(*by, "_range", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_shift"))
    return stored.join(F.broadcast(runs), [*by, "_range"]).withColumn(name, F.col("_at") - F.col("_shift")).drop("_at", "_range", "_shift"), folder


def assign_offsets(rows: DataFrame, parts: DataFrame, order: list[str]) -> DataFrame:
    """record_offset for new rows: the partition's next offset plus their place in the order of arrival."""
    next_ = parts.select("topic_id", "partition", F.coalesce("next_offset", F.lit(0).cast("long")).alias("next_offset"))
    placed, _ = number_rows(rows, ["topic_id", "partition"], order)
    return placed.join(next_, ["topic_id", "partition"], "left").withColumn("record_offset", F.coalesce("next_offset", F.lit(0)) + F.col("place")).drop("next_offset", "place")


def record_size(key: Column, value: Column) -> Column:
    return (F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0)) + 61).cast("long")


def fits(size, max_message_bytes: int):
    """Whether a batch of this many bytes (a number or a Column) is within the limit, with 12 bytes of framing."""
    return size + 12 <= max_message_bytes


def validate_produce(batches: DataFrame, max_message_bytes: int = 1048588, compacted: bool = False) -> DataFrame:
    """Adds error to rows of batches (bytes, null_keys): MESSAGE_TOO_LARGE with the 12 bytes of framing over the limit, INVALID_RECORD for a null key on a compacted topic, else null."""
    error = F.when(~fits(F.col("bytes"), max_message_bytes), "MESSAGE_TOO_LARGE")
    if compacted:
        error = error.when(F.col("null_keys") > 0, "INVALID_RECORD")
    return batches.withColumn("error", error)


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Stores a log partitioned by topic and partition, each file in offset order, so bounds prune files and row groups."""
    log.repartitionByRange("topic_id", "partition", "record_offset").sortWithinPartitions("topic_id", "partition", "record_offset").write.mode(mode).options(**PAGES).partitionBy("topic_id", "partition").parquet(path)


__all__ = ["PAGES", "assign_offsets", "delete", "fits", "number_rows", "record_size", "validate_produce", "write_log"]
