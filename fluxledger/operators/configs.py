"""Topic settings: defaults, validation, effective values, cleanup policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, default, least and largest value (null for texts), whether it may be changed.
TOPIC_SETTINGS = [
    ("retention.ms", "604800000", -1, 9223372036854775807, True),
    ("retention.bytes", "-1", -1, 9223372036854775807, True),
    ("max.message.bytes", "1048588", 0, 8388608, True),
    ("compression.type", "producer", None, None, False),
    ("min.insync.replicas", "1", 1, 9223372036854775807, False),
    ("message.timestamp.type", "CreateTime", None, None, False),
    ("segment.bytes", "1073741824", 1024, 9223372036854775807, True),
    ("segment.ms", "604800000", 1, 9223372036854775807, True),
    ("min.compaction.lag.ms", "0", 0, 9223372036854775807, True),
    ("delete.retention.ms", "86400000", 0, 9223372036854775807, True),
    ("cleanup.policy", "delete", None, None, True),
]


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPIC_SETTINGS, "name string, default string, low long, high long, writable boolean")


def policies(value: Column) -> Column:
    """The sorted policies that a cleanup.policy names, null if it is no list of compact and delete, each at most once."""
    items = F.transform(F.split(F.trim(value), ","), lambda x: F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""))
    good = F.forall(items, lambda x: x.isin("compact", "delete")) & (F.size(F.array_distinct(items)) == F.size(items))
    return F.when(good, F.array_sort(items))


def setting_error(name: Column, value: Column, default: Column, low: Column, high: Column, writable: Column) -> Column:
    """UNKNOWN_CONFIG, READ_ONLY or BAD_VALUE for a setting of that value, else null; a read-only setting may be set to what it is."""
    number = F.when(value.rlike(r"^\s*[+-]?\d{1,19}\s*$"), F.trim(value).try_cast("long"))
    in_range = F.coalesce(number.between(low, high), F.lit(False))
    good = F.when(low.isNotNull(), in_range).when(name == "cleanup.policy", policies(value).isNotNull()).otherwise(value.isNotNull())
    return F.when(default.isNull(), "UNKNOWN_CONFIG").when(~writable & ~F.coalesce(F.trim(value) == default, F.lit(False)), "READ_ONLY").when(writable & ~F.coalesce(good, F.lit(False)), "BAD_VALUE")


def judge_settings(asked: DataFrame) -> DataFrame:
    """Rows (name, value, ...) with their error; the table of settings has a fixed number of rows."""
    known = settings(asked.sparkSession).withColumnRenamed("name", "_name")
    rows = asked.join(F.broadcast(known), F.col("name") == F.col("_name"), "left")
    return rows.withColumn("error", setting_error(F.col("name"), F.col("value"), F.col("default"), F.col("low"), F.col("high"), F.col("writable"))).drop("_name", "default", "low", "high", "writable")


def check_config(name: str, value: str) -> None:
    """The same rule for one setting on the driver; raises ValueError."""
    row = next((s for s in TOPIC_SETTINGS if s[0] == name), None)
    if row is None:
        raise ValueError(f"unknown setting {name!r}")
    _, default, low, high, writable = row
    if not writable:
        if value.strip() != default:
            raise ValueError(f"{name} is read-only at {default!r}")
    elif name == "cleanup.policy":
        items = [x.strip(" \t\n\x0b\f\r") for x in value.split(",")]
        if not set(items) <= {"compact", "delete"} or len(set(items)) < len(items):
            raise ValueError(f"bad {name}: {value!r}")
    elif low is not None:
        digits = value.strip()
        if not digits.lstrip("+-").isdigit() or not low <= int(digits) <= high:
            raise ValueError(f"bad {name}: {value!r}")


def describe(topics: DataFrame) -> DataFrame:
    """name (topic), setting, value, is_default: every setting of every topic (name, config map)."""
    rows = topics.crossJoin(F.broadcast(settings(topics.sparkSession).withColumnRenamed("name", "setting")))
    own = F.try_element_at("config", F.col("setting"))
    return rows.select("name", "setting", F.coalesce(own, "default").alias("value"), own.isNull().alias("is_default"))


def cleanup(topics: DataFrame) -> DataFrame:
    """name, compacts, retains: compaction takes the place of retention; with both, compaction comes first and retention follows."""
    p = policies(F.coalesce(F.try_element_at("config", F.lit("cleanup.policy")), F.lit("delete")))
    return topics.select("name", F.array_contains(p, "compact").alias("compacts"), F.array_contains(p, "delete").alias("retains"))


# quotas

MAX_THROTTLE_MS = 11_000


def applicable_quotas(clients: DataFrame, quotas: DataFrame) -> DataFrame:
    """Clients (principal, client_id, ...) with the most specific quota of each type: user, user default, client, client default.

    quotas: quota_type, entity_type (user or client-id), entity_name (null: default), value. Each step is an equi-join, so large
    tables of quotas shuffle by entity.
    """
    kinds = (("user", "principal", 0), ("client-id", "client_id", 2))
    found = []
    for entity, column, rank in kinds:
        q = quotas.where(F.col("entity_type") == entity)
        named = clients.join(q.where("entity_name is not null"), F.col(column) == F.col("entity_name")).withColumn("rank", F.lit(rank))
        default = clients.crossJoin(F.broadcast(q.where("entity_name is null").dropDuplicates(["quota_type"]))).withColumn("rank", F.lit(rank + 1))
        found += [x.withColumn("entity", F.concat(F.lit(f"{entity}:"), F.col(column))) for x in (named, default)]
    rows = reduce(DataFrame.unionByName, found)
    best = F.min(F.struct("rank", "entity", "value")).alias("best")
    return rows.groupBy(*clients.columns, "quota_type").agg(best).select(*clients.columns, "quota_type", "best.entity", F.col("best.value").alias("value"))


def throttle_ms(bytes_: Column, quota: Column, elapsed_ms: Column) -> Column:
    """Milliseconds that a client owes: the time its bytes take at its quota, less what has passed; cut to whole ones, at most MAX_THROTTLE_MS."""
    owed = bytes_.cast("double") / quota * 1000.0 - elapsed_ms.cast("double")
    return F.when((quota <= 0) | (bytes_ <= 0) | (owed <= 0), 0).otherwise(F.least(F.floor(owed), F.lit(MAX_THROTTLE_MS))).cast("int")


def throttled(usage: DataFrame) -> DataFrame:
    """Usage (entity, ts, bytes, quota) with the wait of each request in tumbling windows of one second: bytes of the window so far against the quota."""
    from pyspark.sql import Window

    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("entity", second).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min("ts").over(Window.partitionBy("entity", second))
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1000
    return usage.withColumn("throttle_ms", throttle_ms(F.sum("bytes").over(w), F.col("quota"), F.floor(elapsed)))
