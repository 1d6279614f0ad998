"""Queries over topics of a catalogue: produces and their visibility, settings, quotas, retention, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import archive as arc
from ..operators import configs as cfg
from ..sources import Catalog, ProduceError, log as src, sink
from ..sources.scratch import new_folder, once
from .registry import registry

QUERIES, ORACLES, query = registry()
_ORDER = ["ts", "event_id"]


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records to produce: their user as key (null for every 37th), their type as value."""
    key = F.when(F.col("event_id") % 37 != 0, F.col("user_id").cast("string"))
    headers = {"header_keys": F.array(F.lit("id")), "header_values": F.array(F.col("event_id").cast("string"))}
    return fx.table(spark, sf_dir, "events").select(key.alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("timestamp"), "event_id", "ts").withColumns(headers)


def event_topic(spark: SparkSession, sf_dir: str) -> Catalog:
    """The topic `events`, filled by two produces (even ids, then odd ones) and one that was refused."""

    def fill(path: str) -> None:
        catalog, rows = Catalog(spark, path), event_records(spark, sf_dir)
        catalog.create_topic("events", fx.PARTITIONS, {"max.message.bytes": "2000"})
        catalog.create_topic("gone", 3)
        catalog.create_topic("audit.log", 2, {"cleanup.policy": "compact, delete", "retention.ms": "1000"})
        catalog.drop_topic("gone")
        catalog.produce("events", rows.where("event_id % 2 = 0"), _ORDER, "even")
        catalog.produce("events", rows.where("event_id % 2 = 1"), _ORDER, "odd")
        catalog.produce("events", rows.where("event_id % 2 = 1"), _ORDER, "odd")  # repeated: writes nothing
        try:
            catalog.produce("events", rows.withColumn("value", F.repeat("value", F.lit(200))), _ORDER, "large")
        except ProduceError:
            pass

    return Catalog(spark, once(spark, (sf_dir, "event-topic"), fill))


_TOPIC = "WITH " + fx.MURMUR_CTES + f""",
t0 AS (
  SELECT event_id, ts AS timestamp, event_type AS value, event_id % 2 AS pass, CASE WHEN event_id % 37 <> 0 THEN k END AS key, CASE WHEN event_id % 37 <> 0 THEN CAST((h & 2147483647) % {fx.PARTITIONS} AS INTEGER) ELSE 0 END AS partition
  FROM events JOIN users USING (user_id)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY partition ORDER BY pass, timestamp, event_id) - 1 AS record_offset, coalesce(octet_length(encode(key)), 0) + octet_length(encode(value)) + 61 AS bytes FROM t0
)"""


@query("topic_read", _TOPIC + " SELECT partition, record_offset, timestamp, key, value, ['id'] AS header_keys, [CAST(event_id AS VARCHAR)] AS header_values FROM t")
def topic_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What finished produces wrote, by name; the refused one shows nowhere."""
    return event_topic(spark, sf_dir).read("events").select("partition", "record_offset", "timestamp", "key", "value", "header_keys", "header_values")


@query("topic_read_bounds", _TOPIC + " SELECT partition, record_offset, value FROM t WHERE partition = 2 AND record_offset >= 3 AND record_offset < 40")
def topic_read_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_topic(spark, sf_dir).read("events", partition=2, from_offset=3, to_offset=40).select("partition", "record_offset", "value")


@query("topic_partition_offsets", _TOPIC + " SELECT partition, 0 AS log_start_offset, max(record_offset) + 1 AS high_watermark, max(record_offset) + 1 AS offset_span, 0 AS leader_epoch FROM t GROUP BY partition")
def topic_partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_topic(spark, sf_dir).partition_offsets("events")


@query("topic_offset_for_time", _TOPIC + " SELECT partition, min(record_offset) AS found FROM t WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY partition")
def topic_offset_for_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_topic(spark, sf_dir).offset_for_time("events", "2024-01-05 00:00:00")


@query("topic_describe_page", "SELECT * FROM (VALUES ('audit.log', 1, 'events', 2), ('events', 0, 'events', 2), ('events', 1, 'events', 2)) v(name, partition, next_name, next_partition)")
def topic_describe_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of three partitions from a cursor on, and where the next one starts."""
    return event_topic(spark, sf_dir).describe_page(("audit.log", 1), 3).select("name", "partition", "next_name", "next_partition")


_SETTINGS = ", ".join(f"('{n}', '{d}')" for n, d, *_ in cfg.TOPIC_SETTINGS)


@query("describe_configs", f"WITH d(setting, value) AS (VALUES {_SETTINGS}), own(name, setting, value) AS (VALUES ('events', 'max.message.bytes', '2000'), ('audit.log', 'cleanup.policy', 'compact, delete'), ('audit.log', 'retention.ms', '1000')) SELECT n.name, d.setting, coalesce(own.value, d.value) AS value, own.value IS NULL AS is_default FROM (VALUES ('events'), ('audit.log')) n(name) CROSS JOIN d LEFT JOIN own ON own.name = n.name AND own.setting = d.setting")
def describe_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.describe(event_topic(spark, sf_dir).topics())


@query("cleanup_dispatch", "SELECT * FROM (VALUES ('events', false, true), ('audit.log', true, true)) v(name, compacts, retains)")
def cleanup_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.cleanup(event_topic(spark, sf_dir).topics())


_ASKED = """WITH asked AS (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'retention.ms' WHEN 1 THEN 'max.message.bytes' WHEN 2 THEN 'cleanup.policy' WHEN 3 THEN 'compression.type' ELSE 'no.such' END AS name,
    CASE event_id % 5 WHEN 2 THEN CASE WHEN event_type = 'view' THEN 'delete , compact' WHEN event_type = 'click' THEN 'delete,delete' ELSE event_type END WHEN 3 THEN CASE WHEN event_type = 'view' THEN 'producer' ELSE 'gzip' END
      ELSE CAST(CAST(round(value * 100000) AS BIGINT) - 1000000 AS VARCHAR) END AS value FROM events)"""


@query("config_validation", _ASKED + """ SELECT event_id, CASE name WHEN 'no.such' THEN 'UNKNOWN_CONFIG' WHEN 'compression.type' THEN CASE WHEN value <> 'producer' THEN 'READ_ONLY' END
  WHEN 'cleanup.policy' THEN CASE WHEN value <> 'delete , compact' THEN 'BAD_VALUE' END WHEN 'retention.ms' THEN CASE WHEN CAST(value AS BIGINT) < -1 THEN 'BAD_VALUE' END
  ELSE CASE WHEN CAST(value AS BIGINT) < 0 OR CAST(value AS BIGINT) > 8388608 THEN 'BAD_VALUE' END END AS error FROM asked""")
def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 5
    name = F.when(m == 0, "retention.ms").when(m == 1, "max.message.bytes").when(m == 2, "cleanup.policy").when(m == 3, "compression.type").otherwise("no.such")
    policy = F.when(F.col("event_type") == "view", "delete , compact").when(F.col("event_type") == "click", "delete,delete").otherwise(F.col("event_type"))
    number = (F.round(F.col("value") * 100000).cast("long") - 1000000).cast("string")
    value = F.when(m == 2, policy).when(m == 3, F.when(F.col("event_type") == "view", "producer").otherwise("gzip")).otherwise(number)
    return cfg.judge_settings(fx.table(spark, sf_dir, "events").select("event_id", name.alias("name"), value.alias("value"))).select("event_id", "error")


_BATCHES = ", b AS (SELECT partition, base_offset, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE key IS NULL) AS null_keys FROM log GROUP BY partition, base_offset)"


@query("produce_validation", fx.ORACLE_LOG + _BATCHES + " SELECT partition, base_offset, CASE WHEN bytes + 12 > 1050 THEN 'MESSAGE_TOO_LARGE' WHEN null_keys > 0 THEN 'INVALID_RECORD' END AS error FROM b")
def produce_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch against a limit on its bytes and, on a compacted topic, against null keys."""
    b = fx.events_log(spark, sf_dir).groupBy("partition", "base_offset").agg(F.sum("size_bytes").alias("bytes"), F.count_if(F.col("key").isNull()).alias("null_keys"))
    return sink.validate_produce(b, 1050, compacted=True).select("partition", "base_offset", "error")


@query("produce_offsets", fx.ORACLE_PARTS + " SELECT event_id, coalesce(next_offset, 0) + row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS record_offset FROM l0 LEFT JOIN parts USING (partition)")
def produce_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events once more, behind the end of each partition."""
    log, parts, _, _ = fx.log_state(spark, sf_dir)
    rows = log.select("topic_id", "partition", "event_id").join(fx.table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    return sink.assign_offsets(rows, parts, _ORDER).select("event_id", "record_offset")


@query("topic_delete_records", _TOPIC + ", e AS (SELECT partition, max(record_offset) + 1 AS n FROM t GROUP BY partition) SELECT t.partition, count(*) AS records, min(record_offset) AS first FROM t JOIN e USING (partition) WHERE record_offset >= CASE partition WHEN 1 THEN 7 WHEN 2 THEN n - 1 ELSE 0 END GROUP BY t.partition")
def topic_delete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log starts moved forward, backward (refused by the rule that they only move on) and out of range; then what is left to read."""
    catalog = Catalog(spark, new_folder(spark, "delete-records"))
    catalog.create_topic("events", fx.PARTITIONS)
    catalog.produce("events", event_records(spark, sf_dir).withColumn("pass", F.col("event_id") % 2), ["pass", *_ORDER])
    end = catalog.partition_offsets("events").where("partition = 2").first()["high_watermark"]
    catalog.delete_records("events", {1: 7, 2: end - 1, 3: -7, 4: 10**12})
    catalog.delete_records("events", {1: 3})
    return catalog.read("events").groupBy("partition").agg(F.count("*").alias("records"), F.min("record_offset").alias("first"))


@query("topic_retention", _TOPIC + ", s AS (SELECT partition, pass, sum(bytes) AS bytes, max(record_offset) + 1 AS upto FROM t GROUP BY partition, pass), a AS (SELECT partition, sum(bytes) AS bytes FROM s GROUP BY partition) SELECT s.partition, 1 AS dropped, upto AS new_log_start FROM s JOIN a USING (partition) WHERE pass = 0 AND a.bytes > 5000")
def topic_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest produce of each partition over the bytes goes; the newest stays."""
    catalog = Catalog(spark, new_folder(spark, "retention"))
    rows = event_records(spark, sf_dir)
    catalog.create_topic("events", fx.PARTITIONS, {"retention.bytes": "5000"})
    for p in (0, 1):
        catalog.produce("events", rows.where(F.col("event_id") % 2 == p), _ORDER)
    return catalog.enforce_retention("events", retention_ms=-1)


_PIECES = ", s AS (SELECT partition, pass, CAST(sum(bytes) AS BIGINT) AS bytes, min(record_offset) AS first_offset, max(timestamp) AS newest FROM t GROUP BY partition, pass)"


def _archived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sealed pieces of the topic, and the ledger of an archive that was filled between its two produces."""

    def fill(path: str) -> None:
        catalog, rows = Catalog(spark, path), event_records(spark, sf_dir)
        catalog.create_topic("events", fx.PARTITIONS)
        catalog.produce("events", rows.where("event_id % 2 = 0"), _ORDER)
        catalog.archive("events", f"{path}/archive")
        catalog.archive("events", f"{path}/archive")  # nothing new
        catalog.produce("events", rows.where("event_id % 2 = 1"), _ORDER)

    path = once(spark, (sf_dir, "archived-topic"), fill)
    catalog = Catalog(spark, path)
    piece = lambda m: m.select(F.lit(1).alias("topic_id"), "partition", "first_offset", "bytes", F.col("max_timestamp").alias("at"))
    return piece(catalog.markers("events")), piece(catalog.archived(f"{path}/archive"))


@query("archive_status", _TOPIC + _PIECES + " SELECT count(*) FILTER (WHERE pass = 0) AS archived, CAST(sum(bytes) FILTER (WHERE pass = 0) AS BIGINT) AS archived_bytes, count(*) FILTER (WHERE pass = 1) AS pending, CAST(sum(bytes) FILTER (WHERE pass = 1) AS BIGINT) AS pending_bytes, min(newest) FILTER (WHERE pass = 1) AS oldest_pending FROM s")
def archive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_status(*_archived(spark, sf_dir))


@query("restore_check", _TOPIC + _PIECES + ", e AS (SELECT partition, max(record_offset) + 1 AS log_end FROM t WHERE pass = 0 GROUP BY partition) SELECT partition, 'markers past the log end' AS finding, count(*) AS n FROM s JOIN e USING (partition) WHERE first_offset >= log_end GROUP BY partition UNION ALL SELECT partition, 'log went back', 1 FROM e JOIN (SELECT partition, max(record_offset) + 1 AS noted FROM t GROUP BY partition) USING (partition) WHERE log_end < noted UNION ALL SELECT DISTINCT partition, 'log is gone', 1 FROM t WHERE pass = 1 AND partition NOT IN (SELECT partition FROM e) UNION ALL SELECT partition, 'archived piece is missing', 1 FROM s WHERE pass = 0 AND partition = 3")
def restore_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic restored to its state before the second produce, while the notes are newer, and one archived piece lost."""
    catalog = event_topic(spark, sf_dir)
    pieces, ledger = _archived(spark, sf_dir)
    first = catalog.stored("events").where("produce = 'even'")
    ends = first.groupBy("topic_id", "partition").agg((F.max("record_offset") + 1).alias("log_end")).withColumn("topic_id", F.lit(1))
    noted = pieces.groupBy("topic_id", "partition").agg(F.lit(None).cast("long").alias("x")).drop("x").join(catalog.partition_offsets("events").select("partition", F.col("high_watermark").alias("log_end")), "partition").select("topic_id", "partition", "log_end")
    epochs = catalog.stored("events").groupBy("partition", "leader_epoch").agg(F.min("record_offset").alias("start_offset")).select(F.lit(1).alias("topic_id"), "partition", "start_offset")
    markers = pieces.withColumnRenamed("first_offset", "base_offset")
    return arc.restore_check(ends, markers, epochs, noted, ledger, ledger.where("partition <> 3")).select("partition", "finding", "n")


#: quota_type, entity_type, entity_name, value
_QUOTAS = [("produce", "user", "BUILDING", 1000.0), ("produce", "user", None, 2000.0), ("consume", "client-id", "0-PRI", 300.0), ("consume", "client-id", None, 400.0), ("consume", "user", "MACHINERY", 500.0), ("request", "client-id", "3-PRI", 7.0)]
_QUOTAS_SQL = ", ".join(f"('{a}', '{b}', {'NULL' if c is None else repr(c)}, {d})" for a, b, c, d in _QUOTAS)


@query("quota_resolve", f"""WITH q(quota_type, entity_type, entity_name, value) AS (VALUES {_QUOTAS_SQL}), c AS (SELECT c_custkey AS id, c_mktsegment AS principal, (c_custkey % 5) || '-PRI' AS client_id FROM customer),
m AS (SELECT c.*, q.quota_type, CAST(q.value AS DOUBLE) AS value, CASE WHEN entity_type = 'user' THEN 'user:' || principal ELSE 'client-id:' || client_id END AS entity, CASE WHEN entity_type = 'user' AND entity_name = principal THEN 0 WHEN entity_type = 'user' AND entity_name IS NULL THEN 1 WHEN entity_type = 'client-id' AND entity_name = client_id THEN 2 WHEN entity_type = 'client-id' AND entity_name IS NULL THEN 3 END AS rank FROM c CROSS JOIN q)
SELECT id, quota_type, arg_min(entity, rank) AS entity, arg_min(value, rank) AS value FROM m WHERE rank IS NOT NULL GROUP BY id, quota_type""")
def quota_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = spark.createDataFrame(_QUOTAS, "quota_type string, entity_type string, entity_name string, value double")
    clients = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("principal"), F.concat(F.col("c_custkey") % 5, F.lit("-PRI")).alias("client_id"))
    return cfg.applicable_quotas(clients, quotas).select("id", "quota_type", "entity", "value")


@query("quota_throttle", "WITH " + fx.LOG_CTES + """, u AS (SELECT partition AS entity, date_trunc('hour', timestamp) + to_milliseconds(epoch_us(timestamp) // 1000 % 3600000 // 60) AS ts, event_id, size_bytes FROM log),
g AS (SELECT entity, ts, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM u GROUP BY entity, ts),
w AS (SELECT *, sum(bytes) OVER (PARTITION BY entity, date_trunc('second', ts) ORDER BY ts) AS used, epoch_us(ts) // 1000 - epoch_us(min(ts) OVER (PARTITION BY entity, date_trunc('second', ts))) // 1000 AS elapsed FROM g)
SELECT entity, ts, CAST(greatest(0, least(11000, floor(CAST(used AS DOUBLE) / 50.0 * 1000.0 - CAST(elapsed AS DOUBLE)))) AS INTEGER) AS throttle_ms FROM w""")
def quota_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each partition against 50 bytes a second, with the minutes of an hour packed into seconds so that windows hold several requests."""
    ts = F.col("timestamp").cast("timestamp")
    packed = F.timestamp_micros(F.unix_micros(F.date_trunc("hour", ts)) + F.floor(F.unix_millis(ts) % 3600000 / 60).cast("long") * 1000).cast("timestamp_ntz")
    usage = fx.events_log(spark, sf_dir).groupBy(F.col("partition").alias("entity"), packed.alias("ts")).agg(F.sum("size_bytes").alias("bytes")).withColumn("quota", F.lit(50.0))
    return cfg.throttled(usage).select("entity", "ts", "throttle_ms")


@query("json_aggregates", """SELECT o_custkey AS customer, CAST(to_json(list({'id': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey)) AS VARCHAR) AS orders, count(*) AS n FROM orders GROUP BY 1""")
def json_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a group as one JSON array, in order."""
    o = fx.table(spark, sf_dir, "orders")
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))
    return o.groupBy(F.col("o_custkey").alias("customer")).agg(F.to_json(rows).alias("orders"), F.count("*").alias("n"))


@query("json_object_aggregate", """SELECT c AS customer, CAST(to_json(map_from_entries(list((s, n) ORDER BY s))) AS VARCHAR) AS by_status FROM (SELECT o_custkey AS c, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY c""")
def json_object_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a group as one JSON object by name."""
    o = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    return o.groupBy("customer").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n"))))).alias("by_status"))


@query("newest_per_key", fx.ORACLE_LOG + " SELECT key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS n FROM log WHERE key IS NOT NULL) WHERE n <= 5")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest events of each key by insertion; Spark keeps five rows a key and task before it shuffles."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy(F.desc("event_id"))
    return fx.events_log(spark, sf_dir).where("key is not null").withColumn("n", F.row_number().over(w)).where("n <= 5").select("key", "event_id")


@query("subscription_names", "SELECT name FROM (SELECT DISTINCT event_type AS name FROM events) WHERE name IN ('view', 'no.such') OR regexp_full_match(name, 'c.*|.*r')")
def subscription_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names asked for, joined with those that match a pattern as a whole."""
    from ..functions import anchored

    names = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    asked = names.where(F.col("name").isin("view", "no.such"))
    return asked.union(names.where(F.col("name").rlike(anchored("c.*|.*r")))).distinct()


@query("tombstone_clock", fx.ORACLE_LOG + """, seen AS (SELECT partition, date_trunc('day', timestamp) + INTERVAL 1 DAY AS done, max(record_offset) + 1 AS upto FROM log GROUP BY 1, 2),
cleaned AS (SELECT partition, done, max(upto) OVER (PARTITION BY partition ORDER BY done) AS clean_end FROM seen), now AS (SELECT max(timestamp) AS t FROM log), dirty AS (SELECT partition, max(clean_end) AS dirty_from FROM cleaned GROUP BY partition)
SELECT l.partition, l.record_offset, l.record_offset < d.dirty_from AND min(c.done) <= any_value(now.t) - INTERVAL 10 DAY AS removable FROM log l JOIN dirty d USING (partition) CROSS JOIN now LEFT JOIN cleaned c ON c.partition = l.partition AND c.clean_end > l.record_offset WHERE l.value IS NULL GROUP BY l.partition, l.record_offset, d.dirty_from""")
def tombstone_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones that a pass (one at the end of each day) reached ten days ago and that lie below what is dirty."""
    from pyspark.sql import Window

    from .maintenance import removable_tombstones

    log = fx.events_log(spark, sf_dir)
    day = (F.date_trunc("day", F.col("timestamp").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    seen = log.groupBy("topic_id", "partition", day.alias("at")).agg((F.max("record_offset") + 1).alias("upto"))
    cleaned = seen.withColumn("clean_end", F.max("upto").over(Window.partitionBy("topic_id", "partition").orderBy("at")))
    now = log.agg((F.max("timestamp") - F.expr("INTERVAL 10 DAY")).alias("t")).first()["t"]
    return removable_tombstones(log, cleaned, now).select("partition", "record_offset", "removable")


__all__ = ["event_topic", "src"]
