"""Queries that read the log: bounds, time, pages, headers, statistics, isolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import header_value, murmur2, partition_for
from ..operators import isolation as iso
from ..sources import log as src
from .registry import registry

QUERIES, ORACLES, query = registry()
_COLS = "partition, record_offset, timestamp, timestamp_type, key, value, leader_epoch, producer_id, producer_epoch, sequence, is_transactional"
_NOT_ABORTED = "NOT EXISTS (SELECT 1 FROM aborted a WHERE a.partition = l.partition AND a.producer_id = l.producer_id AND l.is_transactional AND a.first_offset <= l.last_offset AND a.marker_offset >= l.base_offset)"
_COMMITTED = f"FROM log l JOIN lso USING (topic_id, partition) WHERE NOT is_control AND record_offset >= log_start_offset AND record_offset < stable_offset AND {_NOT_ABORTED}"
_UNCOMMITTED = "FROM log l JOIN lso USING (topic_id, partition) WHERE NOT is_control AND record_offset >= log_start_offset"
_T1, _T2 = "2024-01-05 00:00:00", "2024-01-12 00:00:00"


def _sql(rest: str, head: str = f"SELECT {_COLS.replace('leader_epoch', 'l.leader_epoch')}") -> str:
    return f"{fx.ORACLE_ALL} {head} {rest}"


def _read(spark: SparkSession, sf_dir: str, **bounds) -> DataFrame:
    log, parts, aborted, open_txns = fx.log_state(spark, sf_dir)
    return src.read_log(log, parts, aborted, open_txns, **bounds).select(*_COLS.split(", "))


@query("log_read_all", _sql(_COMMITTED))
def read_all(spark, sf_dir):
    return _read(spark, sf_dir)


@query("read_committed", _sql(_COMMITTED + " AND partition = 2"))
def read_committed(spark, sf_dir):
    return _read(spark, sf_dir, partition=2)


@query("read_uncommitted", _sql(_UNCOMMITTED))
def read_uncommitted(spark, sf_dir):
    return _read(spark, sf_dir, isolation="read_uncommitted")


@query("log_read_partition", _sql(_UNCOMMITTED + " AND partition = 3"))
def read_partition(spark, sf_dir):
    return _read(spark, sf_dir, partition=3, isolation="read_uncommitted")


@query("log_read_offsets", _sql(_COMMITTED + " AND record_offset >= 5 AND record_offset < 80"))
def read_offsets(spark, sf_dir):
    return _read(spark, sf_dir, from_offset=5, to_offset=80)


_ALL_COLS = _COLS.replace("value,", "value, header_keys, header_values,").replace("leader_epoch", "l.leader_epoch")


@query("log_read_all_columns", _sql(_COMMITTED, f"SELECT {_ALL_COLS}"))
def read_all_columns(spark, sf_dir):
    """All thirteen columns of a reader, headers too."""
    return src.read_log(*fx.log_state(spark, sf_dir))


@query("log_read_clamped", _sql(_UNCOMMITTED + " AND record_offset < 12"))
def read_clamped(spark, sf_dir):
    return _read(spark, sf_dir, from_offset=-10, to_offset=12, isolation="read_uncommitted")


@query("log_read_empty_range", _sql(_COMMITTED + " AND 1 = 0"))
def read_empty(spark, sf_dir):
    return _read(spark, sf_dir, from_offset=9, to_offset=3)


_FOUND = "(SELECT min(record_offset) FROM log x WHERE x.partition = l.partition AND x.timestamp >= TIMESTAMP '{t}')"


def _bound(t: str) -> str:
    return f"coalesce({_FOUND.format(t=t)}, next_offset)"


_TIMED = ", ft AS (SELECT partition, min(record_offset) AS f FROM log WHERE timestamp >= TIMESTAMP '{a}' GROUP BY partition), tt AS (SELECT partition, min(record_offset) AS t FROM log WHERE timestamp >= TIMESTAMP '{b}' GROUP BY partition)"
_TIME_SQL = fx.ORACLE_ALL + _TIMED.format(a=_T1, b=_T2) + f" SELECT {_COLS.replace('leader_epoch', 'l.leader_epoch')} FROM log l JOIN lso USING (topic_id, partition) LEFT JOIN ft USING (partition) LEFT JOIN tt USING (partition) WHERE NOT is_control AND record_offset >= log_start_offset AND record_offset >= coalesce(f, next_offset) AND record_offset < coalesce(t, next_offset)"


@query("log_read_time_range", _TIME_SQL)
def read_time(spark, sf_dir):
    return _read(spark, sf_dir, from_time=_T1, to_time=_T2, isolation="read_uncommitted")


@query("log_read_time_and_offset", _TIME_SQL + " AND record_offset < 400")
def read_time_offset(spark, sf_dir):
    return _read(spark, sf_dir, from_time=_T1, to_time=_T2, to_offset=400, isolation="read_uncommitted")


@query("log_read_out_of_order_ts", _TIME_SQL + f" AND (timestamp < TIMESTAMP '{_T1}' OR timestamp >= TIMESTAMP '{_T2}')")
def read_out_of_order(spark, sf_dir):
    """Records inside the range of offsets whose own timestamp lies outside the bounds are returned all the same."""
    rows = _read(spark, sf_dir, from_time=_T1, to_time=_T2, isolation="read_uncommitted")
    return rows.where((F.col("timestamp") < F.to_timestamp_ntz(F.lit(_T1))) | (F.col("timestamp") >= F.to_timestamp_ntz(F.lit(_T2))))


_SHIFT = "(SELECT ts - INTERVAL 55 MINUTE FROM events WHERE event_id = 101)"


@query("log_read_shifted_timestamps", fx.ORACLE_ALL + f", ft AS (SELECT partition, min(record_offset) AS f FROM log WHERE timestamp >= {_SHIFT} GROUP BY partition) SELECT partition, record_offset, timestamp FROM log JOIN ft USING (partition) JOIN lso USING (partition) WHERE NOT is_control AND record_offset >= log_start_offset AND record_offset >= f AND timestamp < {_SHIFT}")
def read_shifted(spark, sf_dir):
    """Records behind the offset of a time whose own timestamp (an hour early for some) lies before it."""
    at = fx.table(spark, sf_dir, "events").where("event_id = 101").select((F.col("ts") - F.expr("INTERVAL 55 MINUTE")).cast("string")).first()[0]
    rows = _read(spark, sf_dir, from_time=at, isolation="read_uncommitted").where(F.col("timestamp") < F.lit(at).cast("timestamp_ntz"))
    return rows.select("partition", "record_offset", "timestamp")


@query("log_read_max_records", _sql(_COMMITTED + " ORDER BY partition, record_offset LIMIT 250"))
def read_max(spark, sf_dir):
    return _read(spark, sf_dir, max_records=250)


@query("log_last_n_per_partition", fx.ORACLE_PARTS + " SELECT partition, record_offset, key FROM log JOIN parts USING (topic_id, partition) WHERE record_offset >= next_offset - 5")
def last_n(spark, sf_dir):
    log = fx.events_log(spark, sf_dir)
    return src.last_n(log, fx.partitions(log), 5).select("partition", "record_offset", "key")


_BATCHES = ", b AS (SELECT topic_id, partition, base_offset, last_offset, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS records FROM log GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY topic_id, partition, base_offset, last_offset")


@query("log_fetch_budget", fx.ORACLE_LOG + _BATCHES + " SELECT partition, base_offset, bytes FROM (SELECT *, sum(bytes) OVER w AS upto, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY topic_id, partition ORDER BY base_offset)) WHERE upto <= 20000 OR n = 1")
def fetch_budget(spark, sf_dir):
    return src.fetch_page(fx.batches(fx.events_log(spark, sf_dir)), 20000).select("partition", "base_offset", "bytes")


@query("log_headers_unnest", fx.ORACLE_LOG + " SELECT partition, record_offset, unnest(header_keys) AS name, unnest(header_values) AS value FROM log WHERE partition = 1")
def headers_unnest(spark, sf_dir):
    return headers_unnest_all(spark, sf_dir).where("partition = 1")


@query("log_headers_unnest_all", fx.ORACLE_LOG + " SELECT partition, record_offset, unnest(header_keys) AS name, unnest(header_values) AS value FROM log")
def headers_unnest_all(spark, sf_dir):
    return fx.events_log(spark, sf_dir).select("partition", "record_offset", F.inline(F.arrays_zip(F.col("header_keys").alias("name"), F.col("header_values").alias("value"))))


@query("log_headers_numbered", fx.ORACLE_LOG + " SELECT partition, record_offset, unnest(range(len(header_keys))) AS n, unnest(header_keys) AS name FROM log")
def headers_numbered(spark, sf_dir):
    """Headers with their place in the record."""
    return fx.events_log(spark, sf_dir).select("partition", "record_offset", F.posexplode("header_keys").alias("n", "name"))


@query("log_header_lookup", fx.ORACLE_LOG + " SELECT header_values[2] AS version, count(*) AS records FROM log GROUP BY 1")
def header_lookup(spark, sf_dir):
    return fx.events_log(spark, sf_dir).groupBy(header_value("service-version").alias("version")).agg(F.count("*").alias("records"))


@query("log_json_filter", fx.ORACLE_LOG + " SELECT partition, record_offset, CAST(value::JSON->>'$.cents' AS BIGINT) AS cents FROM log WHERE value::JSON->>'$.event_type' = 'purchase'")
def json_filter(spark, sf_dir):
    rows = fx.events_log(spark, sf_dir).select("partition", "record_offset", F.from_json("value", "event_type string, cents long").alias("v"))
    return rows.where("v.event_type = 'purchase'").select("partition", "record_offset", F.col("v.cents").alias("cents"))


@query("log_latest_by_key_text", fx.ORACLE_LOG + " SELECT key, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids, count(DISTINCT partition) AS partitions FROM log WHERE key IS NOT NULL GROUP BY key")
def ids_by_key(spark, sf_dir):
    rows = fx.events_log(spark, sf_dir).where("key is not null").groupBy("key")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"), F.count_distinct("partition").alias("partitions"))


@query("partition_offsets", fx.ORACLE_PARTS + " SELECT partition, log_start_offset, next_offset AS high_watermark, next_offset - log_start_offset AS offset_span, leader_epoch FROM parts")
def partition_offsets(spark, sf_dir):
    log = fx.events_log(spark, sf_dir)
    return src.partition_offsets(fx.partitions(log), log)


_MAXTS = ", mt AS (SELECT partition, record_offset AS m FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY timestamp DESC, record_offset) AS n FROM log) WHERE n = 1)"


@query("list_offsets_sentinels", fx.ORACLE_ALL + _MAXTS + " SELECT partition, coalesce(stable_offset, 0) AS latest, log_start_offset AS earliest, CASE WHEN m < stable_offset THEN m END AS max_timestamp, log_start_offset AS earliest_local FROM lso LEFT JOIN mt USING (partition)")
def list_offsets(spark, sf_dir):
    log = fx.events_log(spark, sf_dir)
    return src.list_offsets(fx.partitions(log), log, fx.open_transactions(log), "read_committed")


@query("offset_of_max_timestamp", fx.ORACLE_LOG + _MAXTS + " SELECT partition, m AS max_timestamp_offset FROM mt")
def max_timestamp(spark, sf_dir):
    return src.max_timestamp_offsets(fx.events_log(spark, sf_dir)).select("partition", "max_timestamp_offset")


@query("offset_for_time", fx.ORACLE_LOG + f" SELECT partition, min(record_offset) AS found FROM log WHERE timestamp >= TIMESTAMP '{_T1}' GROUP BY partition")
def offset_for_time(spark, sf_dir):
    return src.find_offsets(fx.events_log(spark, sf_dir), _T1).select("partition", "found")


@query("murmur2_partition", "WITH " + fx.MURMUR_CTES + f" SELECT user_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash, CAST((h & 2147483647) % {fx.PARTITIONS} AS INTEGER) AS partition FROM users")
def murmur(spark, sf_dir):
    key = F.col("user_id").cast("string")
    users = fx.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", murmur2(key).cast("long").alias("hash"), partition_for(key, fx.PARTITIONS).alias("partition"))


@query("lsn_stable_offset", fx.ORACLE_ALL + " SELECT partition, stable_offset FROM lso")
def stable(spark, sf_dir):
    log = fx.events_log(spark, sf_dir)
    return iso.stable_offsets(fx.partitions(log), fx.open_transactions(log)).select("partition", "stable_offset")


@query("abort_index_overlap", fx.ORACLE_ALL + " SELECT DISTINCT l.partition, l.producer_id, l.base_offset, a.first_offset, a.marker_offset FROM log l JOIN aborted a ON a.partition = l.partition AND a.producer_id = l.producer_id AND a.first_offset <= l.last_offset AND a.marker_offset >= l.base_offset WHERE l.is_transactional")
def abort_overlap(spark, sf_dir):
    log = fx.events_log(spark, sf_dir)
    return iso.overlapping_aborts(log, fx.aborted(log)).select("partition", "producer_id", "base_offset", "first_offset", "marker_offset")


@query("marker_visibility", fx.ORACLE_LOG + f" SELECT partition, count(*) AS records FROM log WHERE NOT (is_transactional AND base_offset // {fx.BATCH} % 3 = 1 AND base_offset // {fx.BATCH} % 7 = 0) GROUP BY partition")
def marker_visibility(spark, sf_dir):
    """Transactional batches as SQL produces (epoch -1); every seventh has no marker and stays hidden."""
    log = fx.events_log(spark, sf_dir).withColumn("producer_epoch", F.when(F.col("is_transactional"), -1).otherwise(F.col("producer_epoch")))
    markers = log.where(f"base_offset div {fx.BATCH} % 7 <> 0").select("topic_id", "partition", "base_offset").distinct()
    return iso.marker_backed(log, markers).groupBy("partition").agg(F.count("*").alias("records"))


@query("hourly_report", fx.ORACLE_LOG + " SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, count(*) AS records, count(DISTINCT key) AS users FROM log GROUP BY 1")
def hourly(spark, sf_dir):
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")
    return fx.events_log(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.count("*").alias("records"), F.count_distinct("key").alias("users"))
