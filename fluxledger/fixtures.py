"""Log, change and catalogue tables derived from the test tables, in Spark and as SQL for the oracle.

No randomness: every column is a rule over events, orders and customer, so both sides agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import partition_for
from .sources.log import stored
from .sources.scratch import once
from .sources.sink import PAGES, number_rows, write_log

PARTITIONS = 6
BATCH = 8
SEGMENT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the events topic (STORED_SCHEMA and event_id), made from the events table."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 37 != 0, F.col("user_id").cast("string"))
    # a user's partition is hashed once, not once per event
    users = e.select("user_id").distinct().withColumn("p", partition_for(F.col("user_id").cast("string"), PARTITIONS))
    e = e.join(users, "user_id").withColumn("key", key).withColumn("partition", F.when(F.col("key").isNull(), 0).otherwise(F.col("p")))
    e, _ = number_rows(e, ["partition"], ["ts", "event_id"], "record_offset")
    e = e.join(F.broadcast(e.groupBy("partition").agg(F.count("*").alias("n"))), "partition")
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k")
    value = F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(', "event_type": "'), F.col("event_type"), F.lit('", "cents": '), cents, F.lit(', "k": '), k, F.lit("}"))
    batch = F.expr(f"record_offset div {BATCH}")
    e = e.withColumns({
        "topic_id": F.lit(1), "batch": batch, "body": F.when(F.col("event_id") % 53 != 0, value),
        "timestamp": F.when(F.col("event_id") % 101 == 0, F.col("ts") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")),
    })
    has_pid = F.col("batch") % 3 != 0
    return e.select(
        "topic_id", "partition", "record_offset", "timestamp", F.lit("CreateTime").alias("timestamp_type"), "key", F.col("body").alias("value"),
        F.array(F.lit("trace-id"), F.lit("service-version")).alias("header_keys"),
        F.array(F.concat(F.lit("t-"), F.col("event_id")), F.when(F.col("event_id") % 29 != 0, F.concat(F.lit("2.4."), F.col("event_id") % 3))).alias("header_values"),
        F.when(F.col("record_offset") < F.expr("n div 2"), 0).otherwise(65536).alias("leader_epoch"),
        F.when(has_pid, F.col("batch") % 5).alias("producer_id"), F.when(has_pid, 0).alias("producer_epoch"),
        F.when(has_pid, F.col("record_offset") % 2147483648).cast("int").alias("sequence"), (F.col("batch") % 3 == 1).alias("is_transactional"),
        (F.col("event_id") % 211 == 210).alias("is_control"), (F.col("batch") * BATCH).alias("base_offset"),
        F.least(F.col("batch") * BATCH + BATCH - 1, F.col("n") - 1).alias("last_offset"), F.expr(f"record_offset div {SEGMENT} * {SEGMENT}").alias("segment_base"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("append_ts"),
        (F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("body"), F.lit(0)) + 61).cast("long").alias("size_bytes"), "event_id",
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log of the events topic: written once a session, partitioned by topic and partition, in offset order."""
    return stored(spark, once(spark, (sf_dir, "events-log"), lambda path: write_log(build_events_log(spark, sf_dir), path)))


def log_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The stored log with its stored side tables: partitions, abort index, open transactions (small tables that a log keeps beside its records)."""
    log = events_log(spark, sf_dir)
    made = [(partitions, "events-partitions"), (aborted, "events-aborted"), (open_transactions, "events-open")]
    return log, *[spark.read.parquet(once(spark, (sf_dir, name), lambda path, f=f: f(log).coalesce(1).write.parquet(path))) for f, name in made]


_MUL = "(({x}) * 1540483477) % 4294967296"


def _mul(x: str) -> str:
    return _MUL.format(x=x)


#: murmur2 of a short ASCII key `k` (at most 7 bytes: one whole word at most), as SQL over its bytes.
_B = lambda i: f"coalesce(ascii(substr(k, {i}, 1)), 0)::BIGINT"

MURMUR_CTES = f"""
u0 AS (SELECT DISTINCT user_id, CAST(user_id AS VARCHAR) AS k FROM events),
u1 AS (SELECT *, xor(2538058380::BIGINT, length(k)::BIGINT) AS h0, {_mul(f'{_B(1)} + {_B(2)} * 256 + {_B(3)} * 65536 + {_B(4)} * 16777216')} AS w0, length(k) % 4 AS rest, length(k) // 4 * 4 AS tail_at FROM u0),
u2 AS (SELECT *, {_mul('xor(w0, w0 >> 24)')} AS w1 FROM u1),
u3 AS (SELECT *, CASE WHEN length(k) >= 4 THEN xor({_mul('h0')}, w1) ELSE h0 END AS h1,
  (CASE WHEN rest >= 3 THEN ascii(substr(k, tail_at + 3, 1))::BIGINT * 65536 ELSE 0 END) + (CASE WHEN rest >= 2 THEN ascii(substr(k, tail_at + 2, 1))::BIGINT * 256 ELSE 0 END)
  + (CASE WHEN rest >= 1 THEN ascii(substr(k, tail_at + 1, 1))::BIGINT ELSE 0 END) AS tail FROM u2),
u4 AS (SELECT *, CASE WHEN rest > 0 THEN {_mul('xor(h1, tail)')} ELSE h1 END AS h2 FROM u3),
u5 AS (SELECT *, {_mul('xor(h2, h2 >> 13)')} AS h3 FROM u4),
users AS (SELECT user_id, k, xor(h3, h3 >> 15) AS h FROM u5)
"""

LOG_CTES = MURMUR_CTES + f""",
l0 AS (
  SELECT e.*, CASE WHEN event_id % 37 <> 0 THEN k END AS key, CASE WHEN event_id % 37 <> 0 THEN CAST((h & 2147483647) % {PARTITIONS} AS INTEGER) ELSE 0 END AS partition
  FROM events e JOIN users USING (user_id)
), l1 AS (
  SELECT *, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS record_offset, count(*) OVER (PARTITION BY partition) AS n,
    CASE WHEN event_id % 53 <> 0 THEN '{{"event_id": ' || event_id || ', "event_type": "' || event_type || '", "cents": ' || CAST(round(value * 100) AS BIGINT) || ', "k": ' || (props::JSON->>'$.k') || '}}' END AS body
  FROM l0
), log AS (
  SELECT 1 AS topic_id, partition, record_offset, CASE WHEN event_id % 101 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END AS timestamp, 'CreateTime' AS timestamp_type, key, body AS value,
    ['trace-id', 'service-version'] AS header_keys, ['t-' || event_id, CASE WHEN event_id % 29 <> 0 THEN '2.4.' || (event_id % 3) END] AS header_values,
    CASE WHEN record_offset < n // 2 THEN 0 ELSE 65536 END AS leader_epoch,
    CASE WHEN record_offset // {BATCH} % 3 <> 0 THEN record_offset // {BATCH} % 5 END AS producer_id, CASE WHEN record_offset // {BATCH} % 3 <> 0 THEN 0 END AS producer_epoch,
    CASE WHEN record_offset // {BATCH} % 3 <> 0 THEN CAST(record_offset % 2147483648 AS INTEGER) END AS sequence, record_offset // {BATCH} % 3 = 1 AS is_transactional,
    event_id % 211 = 210 AS is_control, record_offset // {BATCH} * {BATCH} AS base_offset, least(record_offset // {BATCH} * {BATCH} + {BATCH} - 1, n - 1) AS last_offset,
    record_offset // {SEGMENT} * {SEGMENT} AS segment_base, epoch_us(ts) // 1000 AS append_ts,
    coalesce(octet_length(encode(key)), 0) + coalesce(octet_length(encode(body)), 0) + 61 AS size_bytes, event_id
  FROM l1
)"""


def partitions(log: DataFrame) -> DataFrame:
    """topic_id, partition, log_start_offset, leader_epoch, next_offset; partition 6 was never written."""
    seen = log.groupBy("topic_id", "partition").agg(F.max("last_offset").alias("m"), F.max("leader_epoch").alias("leader_epoch"))
    seen = seen.select("topic_id", "partition", F.when(F.col("partition") == 1, 10).otherwise(0).cast("long").alias("log_start_offset"), "leader_epoch", (F.col("m") + 1).alias("next_offset"))
    never = log.sparkSession.createDataFrame([(1, PARTITIONS, 0, 0, None)], "topic_id int, partition int, log_start_offset long, leader_epoch int, next_offset long")
    return seen.unionByName(never)


PARTITION_CTES = f""",
parts AS (
  SELECT 1 AS topic_id, partition, CASE WHEN partition = 1 THEN 10 ELSE 0 END AS log_start_offset, max(leader_epoch) AS leader_epoch, max(last_offset) + 1 AS next_offset FROM log GROUP BY partition
  UNION ALL SELECT 1, {PARTITIONS}, 0, 0, NULL
)"""


def batches(log: DataFrame) -> DataFrame:
    keys = ["topic_id", "partition", "base_offset", "last_offset", "segment_base", "producer_id", "is_transactional"]
    return log.groupBy(*keys).agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("records"), F.max("append_ts").alias("append_ts"), F.min("sequence").alias("first_sequence"), F.max("timestamp").alias("max_timestamp"))


def aborted(log: DataFrame) -> DataFrame:
    """Abort index: a third of the transactional batches, each ended by a marker at the next batch's base."""
    b = log.where("is_transactional").select("topic_id", "partition", "producer_id", "base_offset", "last_offset").distinct()
    return b.where(f"base_offset div {BATCH} % 9 = 1").select("topic_id", "partition", "producer_id", F.col("base_offset").alias("first_offset"), (F.col("last_offset") + 1).alias("marker_offset"))


def open_transactions(log: DataFrame) -> DataFrame:
    """First offsets of ongoing transactions: one on partition 2, in its last tenth."""
    last = log.where("partition = 2").groupBy("topic_id", "partition").agg(F.max("record_offset").alias("m"))
    return last.select("topic_id", "partition", F.lit(4).cast("long").alias("producer_id"), F.expr(f"(m - m div 10) div {BATCH} * {BATCH}").alias("first_offset"))


ABORT_CTES = f""",
aborted AS (
  SELECT DISTINCT topic_id, partition, producer_id, base_offset AS first_offset, last_offset + 1 AS marker_offset FROM log WHERE is_transactional AND base_offset // {BATCH} % 9 = 1
), open_txn AS (
  SELECT topic_id, partition, 4 AS producer_id, (max(record_offset) - max(record_offset) // 10) // {BATCH} * {BATCH} AS first_offset FROM log WHERE partition = 2 GROUP BY topic_id, partition
), lso AS (
  SELECT p.topic_id, p.partition, p.log_start_offset, p.leader_epoch, p.next_offset, least(p.next_offset, coalesce(min(t.first_offset), p.next_offset)) AS stable_offset
  FROM parts p LEFT JOIN open_txn t USING (topic_id, partition) GROUP BY p.topic_id, p.partition, p.log_start_offset, p.leader_epoch, p.next_offset
)"""

ORACLE_LOG = "WITH " + LOG_CTES
ORACLE_PARTS = ORACLE_LOG + PARTITION_CTES
ORACLE_ALL = ORACLE_PARTS + ABORT_CTES


def build_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment events of the incident demo: order_id, amount_cents, version, charged_at, partition, record_offset.

    Orders are charged at their date plus seconds derived from the key; inside one month every
    seventh order is handled by version 2.4.1 and charged again two seconds later.
    """
    o = table(spark, sf_dir, "orders")
    at = o["o_orderdate"] + F.make_dt_interval(secs=(F.col("o_orderkey") * 7919 % 86400).cast("decimal(18,6)"))
    base = o.select(F.col("o_orderkey").alias("order_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_cents"), at.alias("charged_at"), F.col("o_custkey").alias("customer"))
    bad = (F.col("charged_at") >= F.to_timestamp_ntz(F.lit("1997-06-01 00:00:00"))) & (F.col("charged_at") < F.to_timestamp_ntz(F.lit("1997-07-01 00:00:00")))
    base = base.withColumn("version", F.when(bad, "2.4.1").otherwise("2.4.0")).withColumn("times", F.when(bad & (F.col("order_id") % 7 == 0), 2).otherwise(1))
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("again"))
    rows = rows.withColumn("charged_at", F.col("charged_at") + F.make_dt_interval(secs=(F.col("again") * 2).cast("decimal(18,6)"))).withColumn("partition", (F.col("order_id") % PARTITIONS).cast("int"))
    return rows.select("partition", "order_id", "customer", "amount_cents", "version", "charged_at", "again")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored payment log, written once a session in the order of time, so a window of time reads few row groups."""
    def write(path: str) -> None:
        rows = build_payments(spark, sf_dir)
        rows.repartitionByRange("charged_at").sortWithinPartitions("charged_at").write.options(**PAGES).parquet(path)

    return spark.read.parquet(once(spark, (sf_dir, "payments"), write))


PAYMENT_CTES = f"""
p0 AS (
  SELECT o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS t0, o_custkey AS customer FROM orders
), p1 AS (
  SELECT *, t0 >= TIMESTAMP '1997-06-01' AND t0 < TIMESTAMP '1997-07-01' AS bad FROM p0
), pay AS (
  SELECT order_id, customer, amount_cents, CASE WHEN bad THEN '2.4.1' ELSE '2.4.0' END AS version, CAST(order_id % {PARTITIONS} AS INTEGER) AS partition, again, t0 + to_seconds(again * 2) AS charged_at
  FROM p1, (VALUES (0), (1)) v(again) WHERE again = 0 OR (bad AND order_id % 7 = 0)
)"""
