"""Admin views: configuration folds, access rules, leader epochs, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .registry import registry

QUERIES, ORACLES, query = registry()


@query("log_dir_sizes", fx.ORACLE_LOG + " SELECT partition, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS records FROM log GROUP BY partition")
def log_dir_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.events_log(spark, sf_dir).groupBy("partition").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("records"))


@query("epoch_record_collapse", fx.ORACLE_LOG + " SELECT partition, leader_epoch, min(record_offset) AS start_offset FROM log GROUP BY partition, leader_epoch")
def epoch_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.events_log(spark, sf_dir).groupBy("partition", "leader_epoch").agg(F.min("record_offset").alias("start_offset"))


@query("epoch_end_offset", fx.ORACLE_PARTS + " SELECT p.partition, coalesce((SELECT min(record_offset) FROM log l WHERE l.partition = p.partition AND l.leader_epoch > 0), next_offset) AS end_offset FROM parts p WHERE next_offset IS NOT NULL")
def epoch_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where epoch 0 ends: the start of the next epoch, or the log end."""
    log = fx.events_log(spark, sf_dir)
    later = log.where("leader_epoch > 0").groupBy("partition").agg(F.min("record_offset").alias("later"))
    parts = fx.partitions(log).where("next_offset is not null")
    return parts.join(later, "partition", "left").select("partition", F.coalesce("later", "next_offset").alias("end_offset"))


@query("epoch_fence", fx.ORACLE_PARTS + " SELECT partition, CASE WHEN partition % 3 * 65536 < leader_epoch THEN 'FENCED_LEADER_EPOCH' WHEN partition % 3 * 65536 > leader_epoch THEN 'UNKNOWN_LEADER_EPOCH' ELSE 'NONE' END AS error FROM parts")
def epoch_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.col("partition") % 3 * 65536
    error = F.when(asked < F.col("leader_epoch"), "FENCED_LEADER_EPOCH").when(asked > F.col("leader_epoch"), "UNKNOWN_LEADER_EPOCH").otherwise("NONE")
    return fx.partitions(fx.events_log(spark, sf_dir)).select("partition", error.alias("error"))


@query("alter_configs_fold", "SELECT CAST(user_id AS VARCHAR) AS topic, event_type AS name, arg_max(CASE WHEN event_id % 5 = 0 THEN 'DELETE' ELSE 'v' || event_id END, event_id) AS value FROM events GROUP BY 1, 2 HAVING max(event_id) % 5 <> 0")
def alter_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds SET and DELETE operations in order: the last one of each topic and name decides."""
    ops = fx.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("topic"), F.col("event_type").alias("name"), "event_id")
    value = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("v"), F.col("event_id")))
    last = ops.withColumn("value", value).groupBy("topic", "name").agg(F.max_by("value", "event_id").alias("value"))
    return last.where("value is not null")


#: principal, pattern, prefixed, op (bit), permission
_RULES = [("BUILDING", "*", False, 1, "ALLOW"), ("BUILDING", "Customer#00000001", True, 1, "DENY"), ("AUTOMOBILE", "Customer#0000000", True, 2, "ALLOW"), ("*", "Customer#000000042", False, 4, "ALLOW"), ("FURNITURE", "*", False, 2, "ALLOW"), ("*", "Customer#00000005", True, 2, "DENY")]
_RULES_SQL = ", ".join(f"('{a}', '{b}', {str(c).lower()}, {d}, '{e}')" for a, b, c, d, e in _RULES)
_HITS = f"""WITH rules(who, pattern, prefixed, op, permission) AS (VALUES {_RULES_SQL}), hits AS (
  SELECT c_custkey AS id, c_mktsegment AS principal, op, permission FROM customer LEFT JOIN rules ON (who = '*' OR who = c_mktsegment) AND (pattern = '*' OR pattern = c_name OR (prefixed AND starts_with(c_name, pattern))))"""


def acl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as resources, asked for by their segment as principal, with every rule that applies (six rules: broadcast)."""
    rules = spark.createDataFrame(_RULES, "who string, pattern string, prefixed boolean, op int, permission string")
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("principal"), F.col("c_name").alias("resource"))
    fits = F.col("pattern").isin("*") | (F.col("pattern") == F.col("resource")) | (F.col("prefixed") & F.col("resource").startswith(F.col("pattern")))
    return c.join(F.broadcast(rules), ((F.col("who") == "*") | (F.col("who") == F.col("principal"))) & fits, "left")


@query("acl_evaluate", _HITS + " SELECT id, principal = 'MACHINERY' OR (NOT coalesce(bool_or(permission = 'DENY' AND op = 1 + id % 2), false) AND coalesce(bool_or(permission = 'ALLOW' AND op = 1 + id % 2), false)) AS allowed FROM hits GROUP BY id, principal")
def acl_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superusers first, then any DENY, then any ALLOW, else denied."""
    asked = F.col("op") == 1 + F.col("id") % 2
    has = lambda p: F.coalesce(F.bool_or(asked & (F.col("permission") == p)), F.lit(False))
    out = acl_hits(spark, sf_dir).groupBy("id", "principal").agg(has("DENY").alias("deny"), has("ALLOW").alias("allow"))
    return out.select("id", F.when(F.col("principal") == "MACHINERY", True).when(F.col("deny"), False).otherwise(F.col("allow")).alias("allowed"))


@query("acl_authorized_ops", _HITS + " SELECT id, CAST(coalesce(bit_or(op) FILTER (WHERE permission = 'ALLOW'), 0) & ~coalesce(bit_or(op) FILTER (WHERE permission = 'DENY'), 0) AS INTEGER) AS operations FROM hits GROUP BY id")
def authorized_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = lambda p: F.coalesce(F.bit_or(F.when(F.col("permission") == p, F.col("op"))), F.lit(0))
    out = acl_hits(spark, sf_dir).groupBy("id").agg(bits("ALLOW").alias("allow"), bits("DENY").alias("deny"))
    return out.select("id", F.col("allow").bitwiseAND(F.bitwise_not("deny")).alias("operations"))
