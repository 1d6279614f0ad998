"""Reading a log as rows: bounds, isolation, time lookup, partition statistics, pages.

A stored log is a Parquet table partitioned by topic and partition; predicates on partition,
offset and time reach the scan. Small per-partition tables (bounds, statistics) have a row per
partition and join by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ms_ceil
from ..operators.isolation import stable_offsets, visible
from ..schema import ISOLATION, LOG_COLUMNS

_PLACE = ["topic_id", "partition"]


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find_offsets(log: DataFrame, at: Column | str) -> DataFrame:
    """First offset per partition whose timestamp is at or after `at`; every record counts, control and aborted ones too."""
    at = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    return log.where(F.col("timestamp") >= at).groupBy(*_PLACE).agg(F.min("record_offset").alias("found"))


def resolve_ranges(parts: DataFrame, log: DataFrame, from_offset: int | None = None, to_offset: int | None = None, from_time: str | None = None, to_time: str | None = None, bound: str = "next_offset") -> DataFrame:
    """Half-open range [lo, hi) of each partition: all bounds intersect, clamped to what the log holds below `bound`."""
    end = F.coalesce(F.col(bound), F.lit(0).cast("long"))
    out = parts.withColumn("end", end)
    low, high = [F.col("log_start_offset")], [F.col("end")]
    for name, time, into in (("from_found", from_time, low), ("to_found", to_time, high)):
        if time is not None:
            out = out.join(find_offsets(log, time).withColumnRenamed("found", name), _PLACE, "left")
            into.append(F.coalesce(name, F.col("next_offset"), F.lit(0).cast("long")))
    if from_offset is not None:
        low.append(F.lit(from_offset).cast("long"))
    if to_offset is not None:
        high.append(F.lit(to_offset).cast("long"))
    lo = F.greatest(*low) if len(low) > 1 else low[0]
    hi = F.least(*high) if len(high) > 1 else high[0]
    return out.select(*_PLACE, lo.alias("lo"), F.greatest(hi, lo).alias("hi"))


def read_log(log: DataFrame, parts: DataFrame, aborted: DataFrame, open_txns: DataFrame, markers: DataFrame | None = None, partition: int | None = None, from_offset: int | None = None, to_offset: int | None = None,
             from_time: str | None = None, to_time: str | None = None, isolation: str = "read_committed", max_records: int | None = None) -> DataFrame:
    """Records of a topic in LOG_COLUMNS; no partition means all of them.

    Rows inside the range are returned whatever their timestamp. `max_records` keeps the first ones
    by partition and offset, after filtering.
    """
    if isolation not in ISOLATION:
        raise ValueError(f"isolation must be one of {', '.join(ISOLATION)}, not {isolation!r}")
    if max_records is not None and max_records < 0:
        raise ValueError("max_records must not be negative")
    if partition is not None:
        log, parts = log.where(F.col("partition") == partition), parts.where(F.col("partition") == partition)
    bound = "next_offset"
    if isolation == "read_committed":
        parts, bound = stable_offsets(parts, open_txns), "stable_offset"
    ranges = resolve_ranges(parts, log, from_offset, to_offset, from_time, to_time, bound)
    rows = log
    if from_offset is not None:
        rows = rows.where(F.col("record_offset") >= from_offset)  # reaches the scan; the range below is the rule
    if to_offset is not None:
        rows = rows.where(F.col("record_offset") < to_offset)
    # broadcast: a row per partition; a shuffle by partition would put a whole partition into one task
    rows = rows.join(F.broadcast(ranges), _PLACE).where("record_offset >= lo and record_offset < hi").drop("lo", "hi")
    rows = visible(rows, aborted, markers) if isolation == "read_committed" else rows.where("not is_control")
    rows = rows.select(*LOG_COLUMNS)
    return rows if max_records is None else rows.orderBy("partition", "record_offset").limit(max_records)


def last_n(log: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """Records among the last n offsets of each partition: a bounds join, no sort."""
    low = parts.select(*_PLACE, (F.col("next_offset") - n).alias("low"))
    return log.join(F.broadcast(low), _PLACE).where("record_offset >= low").drop("low")


def partition_offsets(parts: DataFrame, log: DataFrame) -> DataFrame:
    """partition, log_start_offset, high_watermark, offset_span, leader_epoch; null marks for a partition never written."""
    marks = log.groupBy(*_PLACE).agg((F.max("last_offset") + 1).alias("high_watermark"))
    return parts.join(marks, _PLACE, "left").select("partition", "log_start_offset", "high_watermark", (F.col("high_watermark") - F.col("log_start_offset")).alias("offset_span"), "leader_epoch")


def max_timestamp_offsets(log: DataFrame) -> DataFrame:
    """Offset of the largest timestamp per partition, the earlier offset on ties."""
    return log.groupBy(*_PLACE).agg(F.max_by("record_offset", F.struct("timestamp", -F.col("record_offset"))).alias("max_timestamp_offset"))


def list_offsets(parts: DataFrame, log: DataFrame, open_txns: DataFrame, isolation: str = "read_uncommitted", at: str | None = None) -> DataFrame:
    """Answers of all sentinels per partition: latest (-1), earliest (-2), max timestamp (-3), local earliest (-4), and of a time.

    Under read_committed latest is the stable offset, and found offsets at or above it are not shown.
    """
    p = stable_offsets(parts, open_txns).join(max_timestamp_offsets(log), _PLACE, "left")
    committed = isolation == "read_committed"
    latest = F.coalesce(F.col("stable_offset" if committed else "next_offset"), F.lit(0).cast("long"))
    hide = lambda c: F.when(c < latest, c) if committed else c
    out = [F.col("partition"), latest.alias("latest"), F.col("log_start_offset").alias("earliest"), hide(F.col("max_timestamp_offset")).alias("max_timestamp"), F.col("log_start_offset").alias("earliest_local")]
    if at is not None:
        p = p.join(find_offsets(log, at), _PLACE, "left")
        out.append(hide(F.col("found")).alias("at_time"))
    return p.select(*out)


def fetch_page(batches: DataFrame, budget: int) -> DataFrame:
    """Batches of each partition up to a byte budget; the first one always comes whole, later ones only if they fit."""
    from pyspark.sql import Window

    w = Window.partitionBy(*_PLACE).orderBy("base_offset")
    upto = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return batches.withColumns({"upto": upto, "n": F.row_number().over(w)}).where((F.col("upto") <= budget) | (F.col("n") == 1)).drop("upto", "n")


def time_bound_ms(ts: Column) -> Column:
    return ms_ceil(ts)
