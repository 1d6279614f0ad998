"""Queue-style groups: acquisition, expiry, moving the start, adjacent ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from .registry import registry

QUERIES, ORACLES, query = registry()
LOCKS, ATTEMPTS = 200, 5

#: Delivery state by rule: the older quarter is settled, the next quarter in flight, the rest available.
_STATE = """CASE WHEN record_offset < last_offset_of_partition div 4 AND event_id % 97 <> 0 THEN if(event_id % 13 = 0, 'archived', 'acked')
  WHEN record_offset < last_offset_of_partition div 2 THEN 'acquired' ELSE 'available' END"""
_INFLIGHT = """, sh AS (
  SELECT partition, record_offset, event_id, CASE WHEN record_offset < m // 4 AND event_id % 97 <> 0 THEN (CASE WHEN event_id % 13 = 0 THEN 'archived' ELSE 'acked' END) WHEN record_offset < m // 2 THEN 'acquired' ELSE 'available' END AS state,
    CASE WHEN record_offset < m // 2 THEN 1 + event_id % 5 ELSE 0 END AS deliveries, record_offset < m // 2 AND event_id % 4 <> 0 AS locked
  FROM (SELECT *, max(record_offset) OVER (PARTITION BY partition) AS m FROM log)
)"""


def in_flight(log: DataFrame) -> DataFrame:
    """partition, record_offset, state, deliveries, locked for every record."""
    ends = log.groupBy("partition").agg(F.max("record_offset").alias("last_offset_of_partition"))
    rows = log.select("partition", "record_offset", "event_id").join(ends, "partition")
    young = F.expr("record_offset < last_offset_of_partition div 2")
    return rows.select("partition", "record_offset", F.expr(_STATE).alias("state"), F.when(young, 1 + F.col("event_id") % 5).otherwise(0).alias("deliveries"), (young & (F.col("event_id") % 4 != 0)).alias("locked"))


def free(rows: DataFrame) -> DataFrame:
    """Records that can be acquired: available ones, and acquired ones whose lock lapsed."""
    return rows.where("state = 'available' or (state = 'acquired' and not locked)")


@query("share_state", fx.ORACLE_LOG + _INFLIGHT + " SELECT partition, state, count(*) AS records, CAST(max(deliveries) AS BIGINT) AS most_deliveries FROM sh GROUP BY partition, state")
def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_flight(fx.events_log(spark, sf_dir)).groupBy("partition", "state").agg(F.count("*").alias("records"), F.max("deliveries").cast("long").alias("most_deliveries"))


@query("share_head_advance", fx.ORACLE_LOG + _INFLIGHT + " SELECT partition, coalesce(min(record_offset) FILTER (WHERE state IN ('acquired', 'available')), max(record_offset) + 1) AS start_offset FROM sh GROUP BY partition")
def head_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start moves past settled records up to the first that is not; a minimum finds it without a window."""
    unsettled = F.when(F.col("state").isin("acquired", "available"), F.col("record_offset"))
    return in_flight(fx.events_log(spark, sf_dir)).groupBy("partition").agg(F.coalesce(F.min(unsettled), F.max("record_offset") + 1).alias("start_offset"))


@query("share_expire", fx.ORACLE_LOG + _INFLIGHT + " SELECT partition, record_offset, deliveries FROM sh WHERE state = 'acquired' AND NOT locked")
def expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_flight(fx.events_log(spark, sf_dir)).where("state = 'acquired' and not locked").select("partition", "record_offset", "deliveries")


@query("share_acquire", fx.ORACLE_LOG + _INFLIGHT + f", f AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY record_offset) AS n FROM sh WHERE (state = 'available' OR (state = 'acquired' AND NOT locked)) AND deliveries < {ATTEMPTS}) SELECT partition, record_offset, deliveries + 1 AS deliveries FROM f WHERE n <= {LOCKS}")
def acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next records of each partition, at most LOCKS (the group's lock limit); the rank filter keeps a top-k per task."""
    w = Window.partitionBy("partition").orderBy("record_offset")
    rows = free(in_flight(fx.events_log(spark, sf_dir))).where(F.col("deliveries") < ATTEMPTS)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= LOCKS).select("partition", "record_offset", (F.col("deliveries") + 1).alias("deliveries"))


@query("share_archive", fx.ORACLE_LOG + _INFLIGHT + f" SELECT partition, record_offset FROM sh WHERE state = 'acquired' AND NOT locked AND deliveries >= {ATTEMPTS}")
def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that used up their deliveries are archived and not returned."""
    return free(in_flight(fx.events_log(spark, sf_dir))).where(F.col("deliveries") >= ATTEMPTS).select("partition", "record_offset")


@query("share_ranges", fx.ORACLE_LOG + _INFLIGHT + ", g AS (SELECT *, record_offset - row_number() OVER (PARTITION BY partition, deliveries ORDER BY record_offset) AS island FROM sh WHERE state = 'acquired') SELECT partition, deliveries, min(record_offset) AS first_offset, max(record_offset) AS last_offset FROM g GROUP BY partition, deliveries, island")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent acquired offsets of equal delivery count as one range."""
    w = Window.partitionBy("partition").orderBy("record_offset")
    rows = in_flight(fx.events_log(spark, sf_dir)).where("state = 'acquired'")
    goes_on = (F.lag("record_offset").over(w) == F.col("record_offset") - 1) & (F.lag("deliveries").over(w) == F.col("deliveries"))
    rows = rows.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("starts").over(w))
    return rows.groupBy("partition", "island").agg(F.max("deliveries").alias("deliveries"), F.min("record_offset").alias("first_offset"), F.max("record_offset").alias("last_offset")).drop("island")
