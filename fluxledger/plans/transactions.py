"""Transactions and producers: end markers, expiry, listings, producer state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .registry import registry

QUERIES, ORACLES, query = registry()
_PLACE = ["topic_id", "partition"]
_WEEK_MS = 7 * 86_400_000


def transactions(log: DataFrame) -> DataFrame:
    """A row per transaction (one batch each in the fixture): producer, first offset, marker offset, outcome."""
    t = log.where("is_transactional").groupBy(*_PLACE, "producer_id", "base_offset").agg(F.max("last_offset").alias("last"), F.min("append_ts").alias("started"))
    lost = fx.aborted(log).select(*_PLACE, "producer_id", F.col("first_offset").alias("base_offset"), F.lit(True).alias("lost"))
    open_ = fx.open_transactions(log).select(*_PLACE, F.col("first_offset").alias("open_from"))
    t = t.join(lost, [*_PLACE, "producer_id", "base_offset"], "left").join(open_, _PLACE, "left")
    state = F.when(F.col("base_offset") >= F.col("open_from"), "Ongoing").when(F.col("lost"), "CompleteAbort").otherwise("CompleteCommit")
    return t.select(*_PLACE, "producer_id", F.col("base_offset").alias("first_offset"), (F.col("last") + 1).alias("marker_offset"), "started", state.alias("state"))


_TXNS = """, txns AS (
  SELECT l.topic_id, l.partition, l.producer_id, l.base_offset AS first_offset, max(l.last_offset) + 1 AS marker_offset, min(l.append_ts) AS started,
    CASE WHEN l.base_offset >= (SELECT o.first_offset FROM open_txn o WHERE o.partition = l.partition) THEN 'Ongoing' WHEN l.base_offset // 8 % 9 = 1 THEN 'CompleteAbort' ELSE 'CompleteCommit' END AS state
  FROM log l WHERE is_transactional GROUP BY l.topic_id, l.partition, l.producer_id, l.base_offset
)"""


@query("txn_end_markers", fx.ORACLE_ALL + _TXNS + " SELECT partition, producer_id, marker_offset, CASE state WHEN 'CompleteAbort' THEN 'ABORT' ELSE 'COMMIT' END AS marker FROM txns WHERE state <> 'Ongoing'")
def end_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(fx.events_log(spark, sf_dir)).where("state <> 'Ongoing'")
    return t.select("partition", "producer_id", "marker_offset", F.when(F.col("state") == "CompleteAbort", "ABORT").otherwise("COMMIT").alias("marker"))


@query("list_transactions", fx.ORACLE_ALL + _TXNS + " SELECT producer_id, state, count(*) AS transactions FROM txns GROUP BY producer_id, state")
def list_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(fx.events_log(spark, sf_dir)).groupBy("producer_id", "state").agg(F.count("*").alias("transactions"))


@query("describe_transactions", fx.ORACLE_ALL + _TXNS + " SELECT partition, producer_id, first_offset, started, state FROM txns")
def describe_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(fx.events_log(spark, sf_dir)).select("partition", "producer_id", "first_offset", "started", "state")


@query("txn_expire", fx.ORACLE_ALL + _TXNS + f" SELECT partition, producer_id, first_offset FROM txns WHERE state = 'Ongoing' AND (SELECT max(append_ts) FROM log) - started > {_WEEK_MS // 14}")
def expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open transactions past their time limit; they are aborted and their producer fenced."""
    log = fx.events_log(spark, sf_dir)
    now = log.agg(F.max("append_ts")).scalar()
    return transactions(log).where((F.col("state") == "Ongoing") & (now - F.col("started") > _WEEK_MS // 14)).select("partition", "producer_id", "first_offset")


@query("describe_producers", fx.ORACLE_LOG + " SELECT partition, producer_id, arg_max(sequence, record_offset) AS last_sequence, max(producer_epoch) AS epoch, max(append_ts) AS last_at FROM log WHERE producer_id IS NOT NULL GROUP BY partition, producer_id")
def describe_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.events_log(spark, sf_dir).where("producer_id is not null").groupBy("partition", "producer_id")
    return rows.agg(F.max_by("sequence", "record_offset").alias("last_sequence"), F.max("producer_epoch").alias("epoch"), F.max("append_ts").alias("last_at"))


@query("producer_sweep", fx.ORACLE_LOG + f" SELECT partition, producer_id FROM log WHERE producer_id IS NOT NULL GROUP BY partition, producer_id HAVING max(append_ts) < (SELECT max(append_ts) FROM log) - {_WEEK_MS // 70}")
def producer_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers that wrote nothing within the retention time are forgotten."""
    log = fx.events_log(spark, sf_dir)
    last = log.where("producer_id is not null").groupBy("partition", "producer_id").agg(F.max("append_ts").alias("at"))
    return last.where(F.col("at") < log.agg(F.max("append_ts")).scalar() - _WEEK_MS // 70).select("partition", "producer_id")
