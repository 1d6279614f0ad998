"""Consumer groups: committed offsets, lag, stability, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import isolation as iso
from .registry import registry

QUERIES, ORACLES, query = registry()

#: Every event is a commit of one of three groups, event_id being the commit sequence.
_COMMITS = ", commits AS (SELECT 'g' || (event_id % 3) AS group_id, partition, record_offset + 1 AS committed, event_id AS seq FROM log), latest AS (SELECT group_id, partition, arg_max(committed, seq) AS committed_offset FROM commits GROUP BY group_id, partition)"


def latest_commits(log: DataFrame) -> DataFrame:
    """The last commit of each group and partition, by commit sequence and not by offset."""
    commits = log.select(F.concat(F.lit("g"), F.col("event_id") % 3).alias("group_id"), "partition", (F.col("record_offset") + 1).alias("committed"), "event_id")
    return commits.groupBy("group_id", "partition").agg(F.max_by("committed", "event_id").alias("committed_offset"))


def lag(log: DataFrame) -> DataFrame:
    """group_id, partition, committed_offset, stable_offset, lag: records between the commit and the stable offset, at least 0."""
    stable = iso.stable_offsets(fx.partitions(log), fx.open_transactions(log)).select("partition", "stable_offset", "next_offset")
    return latest_commits(log).join(stable, "partition").withColumn("lag", F.greatest(F.lit(0), F.col("stable_offset") - F.col("committed_offset")))


_LAG = _COMMITS + ", lagging AS (SELECT group_id, partition, committed_offset, stable_offset, next_offset, CASE WHEN stable_offset > committed_offset THEN stable_offset - committed_offset ELSE 0 END AS lag FROM latest JOIN lso USING (partition))"


@query("offsets_latest_commit", fx.ORACLE_LOG + _COMMITS + " SELECT group_id, partition, committed_offset FROM latest")
def latest_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_commits(fx.events_log(spark, sf_dir))


@query("consumer_lag", fx.ORACLE_ALL + _LAG + " SELECT group_id, partition, committed_offset, lag FROM lagging")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag(fx.events_log(spark, sf_dir)).select("group_id", "partition", "committed_offset", "lag")


@query("offsets_require_stable", fx.ORACLE_ALL + _LAG + " SELECT group_id, partition, CASE WHEN stable_offset < next_offset THEN 'UNSTABLE_OFFSET_COMMIT' ELSE 'NONE' END AS error FROM lagging")
def require_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that asks for stable offsets is told to wait where a transaction is open."""
    error = F.when(F.col("stable_offset") < F.col("next_offset"), "UNSTABLE_OFFSET_COMMIT").otherwise("NONE")
    return lag(fx.events_log(spark, sf_dir)).select("group_id", "partition", error.alias("error"))


@query("list_groups", fx.ORACLE_ALL + _LAG + " SELECT group_id, count(*) AS partitions, CAST(sum(lag) AS BIGINT) AS lag FROM lagging GROUP BY group_id")
def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag(fx.events_log(spark, sf_dir)).groupBy("group_id").agg(F.count("*").alias("partitions"), F.sum("lag").alias("lag"))
