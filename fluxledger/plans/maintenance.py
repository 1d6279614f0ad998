"""Log maintenance: compaction, retention, moving the log start, marker reconciliation, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import isolation as iso
from .registry import registry

QUERIES, ORACLES, query = registry()
_LAG_MS, _RETENTION_MS, _BUDGET = 86_400_000, 7 * 86_400_000, 20_000
_PLACE = ["topic_id", "partition"]


def survivors(log: DataFrame) -> DataFrame:
    """Records that stay: the last of each key, and all without a key or of control batches, which supersede nothing."""
    last = log.where("key is not null and not is_control").groupBy(*_PLACE, "key").agg(F.max("record_offset").alias("last_of_key"))
    kept = log.join(last, [*_PLACE, "key"], "left")
    return kept.where("key is null or is_control or record_offset = last_of_key").drop("last_of_key")


def removable_tombstones(log: DataFrame, cleaned: DataFrame, before) -> DataFrame:
    """Tombstones with `removable`: below the end of the last pass, and reached by a pass (at, clean_end) at or before `before`.

    Passes are a small history per partition: a row a pass.
    """
    t = log.where("value is null").select("topic_id", "partition", "record_offset")
    dirty = cleaned.groupBy(*_PLACE).agg(F.max("clean_end").alias("dirty_from"))
    first = t.join(cleaned.select(*_PLACE, "at", "clean_end"), _PLACE, "left").where("clean_end > record_offset or clean_end is null").groupBy(*_PLACE, "record_offset").agg(F.min("at").alias("first_at"))
    rows = t.join(first, [*_PLACE, "record_offset"], "left").join(F.broadcast(dirty), _PLACE, "left")
    return rows.withColumn("removable", F.coalesce((F.col("record_offset") < F.col("dirty_from")) & (F.col("first_at") <= F.lit(before)), F.lit(False)))


def forget_markers(markers: DataFrame, parts: DataFrame) -> DataFrame:
    """Markers and aborts (last_offset) that still have a record at or past the log start."""
    return markers.join(parts.select(*_PLACE, "log_start_offset"), _PLACE).where("last_offset >= log_start_offset").drop("log_start_offset")


def within_map(log: DataFrame, map_end: DataFrame) -> DataFrame:
    """What a pass judges: records below the end of its offset map (topic_id, partition, map_end); the rest stays as it is."""
    return log.join(map_end, _PLACE).where("record_offset < map_end").drop("map_end")


def without_aborted(log: DataFrame, aborted: DataFrame) -> DataFrame:
    """Aborted batches go whole, before anything is judged."""
    gone = iso.overlapping_aborts(log, aborted).select(*_PLACE, "base_offset").distinct()
    return log.join(gone, [*_PLACE, "base_offset"], "left_anti")


def segments(log: DataFrame) -> DataFrame:
    """A row per segment: bytes, records, last offset, newest append time, and whether it is sealed."""
    s = log.groupBy(*_PLACE, "segment_base").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("records"), F.max("record_offset").alias("last"), F.max("append_ts").alias("newest"))
    active = s.groupBy(*_PLACE).agg(F.max("segment_base").alias("active"))
    return s.join(active, _PLACE).withColumn("sealed", F.col("segment_base") < F.col("active"))


def expired_by_time(log: DataFrame, cutoff) -> DataFrame:
    """Sealed segments before the first one that is newer than the cutoff."""
    upto = Window.partitionBy(*_PLACE).orderBy("segment_base").rowsBetween(Window.unboundedPreceding, 0)
    return segments(log).withColumn("upto", F.max("newest").over(upto)).where(F.col("sealed") & (F.col("upto") < cutoff))


def expired_by_bytes(log: DataFrame, budget: int) -> DataFrame:
    """Oldest sealed segments until the rest fits the budget; the active segment counts and stays."""
    before = Window.partitionBy(*_PLACE).orderBy("segment_base").rowsBetween(Window.unboundedPreceding, -1)
    s = segments(log).withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("live", F.sum("bytes").over(Window.partitionBy(*_PLACE)))
    return s.where(F.col("sealed") & (F.col("before") < F.col("live") - budget))


_LATEST = "(SELECT *, max(record_offset) FILTER (WHERE NOT is_control) OVER (PARTITION BY partition, key) AS m FROM {src})"
_STAYS = "(key IS NULL OR is_control OR record_offset = m)"
_KEPT = "kept AS (SELECT * FROM " + _LATEST.format(src="log") + f" WHERE {_STAYS})"


@query("compact_latest", fx.ORACLE_LOG + f", {_KEPT} SELECT partition, record_offset, key, value FROM kept")
def compact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(fx.events_log(spark, sf_dir)).select("partition", "record_offset", "key", "value")


@query("compact_null_keys", fx.ORACLE_LOG + f", {_KEPT} SELECT partition, count(*) AS kept, count(*) FILTER (WHERE key IS NULL) AS kept_without_key FROM kept GROUP BY partition")
def compact_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(fx.events_log(spark, sf_dir)).groupBy("partition").agg(F.count("*").alias("kept"), F.count_if(F.col("key").isNull()).alias("kept_without_key"))


@query("compact_tombstones", fx.ORACLE_PARTS + f", {_KEPT} SELECT partition, record_offset, value IS NULL AS tombstone FROM kept JOIN parts USING (topic_id, partition) WHERE value IS NOT NULL OR is_control OR key IS NULL OR record_offset >= next_offset // 2")
def compact_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones below the range cleaned long ago (here: the older half) go; newer ones stay."""
    log = fx.events_log(spark, sf_dir)
    kept = survivors(log).join(fx.partitions(log).select(*_PLACE, "next_offset"), _PLACE)
    return kept.where("value is not null or is_control or key is null or record_offset >= next_offset div 2").select("partition", "record_offset", F.col("value").isNull().alias("tombstone"))


_ALIVE = "alive AS (SELECT * FROM log l WHERE NOT EXISTS (SELECT 1 FROM aborted a WHERE a.partition = l.partition AND a.producer_id = l.producer_id AND l.is_transactional AND a.first_offset <= l.last_offset AND a.marker_offset >= l.base_offset))"


@query("compact_aborted", fx.ORACLE_ALL + f", {_ALIVE} SELECT partition, record_offset, key FROM {_LATEST.format(src='alive')} WHERE {_STAYS}")
def compact_aborted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.events_log(spark, sf_dir)
    return survivors(without_aborted(log, fx.aborted(log))).select("partition", "record_offset", "key")


@query("compact_batches", fx.ORACLE_LOG + f", {_KEPT} SELECT partition, base_offset AS old_base, min(record_offset) AS new_base, max(record_offset) AS new_last, count(*) AS records, min(producer_id) AS producer_id FROM kept GROUP BY partition, base_offset")
def compact_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt batches: offsets are never renumbered, the base is the first survivor, the producer stays."""
    kept = survivors(fx.events_log(spark, sf_dir)).groupBy("partition", F.col("base_offset").alias("old_base"))
    return kept.agg(F.min("record_offset").alias("new_base"), F.max("record_offset").alias("new_last"), F.count("*").alias("records"), F.min("producer_id").alias("producer_id"))


_SEG = "seg AS (SELECT topic_id, partition, segment_base, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS records, max(record_offset) AS last, max(append_ts) AS newest FROM log GROUP BY topic_id, partition, segment_base), sg AS (SELECT *, segment_base < max(segment_base) OVER (PARTITION BY partition) AS sealed FROM seg)"


@query("compact_eligible_segments", fx.ORACLE_ALL + f", {_SEG} SELECT partition, segment_base, bytes, records FROM sg JOIN lso USING (topic_id, partition) WHERE sealed AND last < stable_offset AND newest <= (SELECT max(append_ts) FROM log) - {_LAG_MS}")
def compact_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed segments old enough and wholly below the stable offset."""
    log = fx.events_log(spark, sf_dir)
    stable = iso.stable_offsets(fx.partitions(log), fx.open_transactions(log)).select(*_PLACE, "stable_offset")
    now = log.agg(F.max("append_ts")).scalar()
    return segments(log).join(stable, _PLACE).where(F.col("sealed") & (F.col("last") < F.col("stable_offset")) & (F.col("newest") <= now - _LAG_MS)).select("partition", "segment_base", "bytes", "records")


@query("retention_time", fx.ORACLE_LOG + f", {_SEG}, fresh AS (SELECT partition, min(segment_base) AS f FROM sg WHERE NOT sealed OR newest >= (SELECT max(append_ts) FROM log) - {_RETENTION_MS} GROUP BY partition) SELECT partition, count(*) AS dropped, max(last) + 1 AS new_log_start FROM sg JOIN fresh USING (partition) WHERE segment_base < f GROUP BY partition")
def retention_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.events_log(spark, sf_dir)
    gone = expired_by_time(log, log.agg(F.max("append_ts")).scalar() - _RETENTION_MS)
    return gone.groupBy("partition").agg(F.count("*").alias("dropped"), (F.max("last") + 1).alias("new_log_start"))


@query("retention_bytes", fx.ORACLE_LOG + f", {_SEG}, rest AS (SELECT *, sum(bytes) OVER (PARTITION BY partition ORDER BY segment_base DESC) AS from_here FROM sg) SELECT partition, segment_base, bytes FROM rest WHERE sealed AND from_here > {_BUDGET}")
def retention_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expired_by_bytes(fx.events_log(spark, sf_dir), _BUDGET).select("partition", "segment_base", "bytes")


_TARGETS = "(0, -1), (1, 5), (2, 20), (3, -7), (4, 1000000000000)"


@query("delete_records", fx.ORACLE_PARTS + f" SELECT partition, CASE WHEN t < -1 OR t > next_offset THEN 'OFFSET_OUT_OF_RANGE' ELSE 'NONE' END AS error, CASE WHEN t < -1 OR t > next_offset THEN log_start_offset ELSE greatest(log_start_offset, CASE WHEN t = -1 THEN next_offset ELSE t END) END AS low_watermark FROM parts JOIN (VALUES {_TARGETS}) v(partition, t) USING (partition)")
def delete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 means the high watermark; the log start only moves forward."""
    asked = spark.createDataFrame([(0, -1), (1, 5), (2, 20), (3, -7), (4, 10**12)], "partition int, t long")
    p = fx.partitions(fx.events_log(spark, sf_dir)).join(asked, "partition").withColumn("t", F.when(F.col("t") == -1, F.col("next_offset")).otherwise(F.col("t")))
    ok = F.col("t").between(0, F.col("next_offset"))
    return p.select("partition", F.when(ok, "NONE").otherwise("OFFSET_OUT_OF_RANGE").alias("error"), F.when(ok, F.greatest("log_start_offset", "t")).otherwise(F.col("log_start_offset")).alias("low_watermark"))


@query("marker_reconcile", fx.ORACLE_PARTS + " SELECT DISTINCT l.partition, l.base_offset FROM log l JOIN parts p USING (topic_id, partition) WHERE is_transactional AND l.base_offset < next_offset * 3 // 4")
def marker_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After recovery found the log shorter (here three quarters), markers at or past its end go."""
    log = fx.events_log(spark, sf_dir)
    ends = fx.partitions(log).select(*_PLACE, F.expr("next_offset * 3 div 4").alias("end"))
    markers = log.where("is_transactional").select(*_PLACE, "base_offset").distinct()
    return markers.join(ends, _PLACE).where("base_offset < end").select("partition", "base_offset")


@query("archive_pending", fx.ORACLE_LOG + f", {_SEG} SELECT partition, segment_base, bytes FROM sg WHERE sealed AND segment_base // {fx.SEGMENT} % 3 <> 0")
def archive_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed segments that the archive (here every third) does not hold."""
    s = segments(fx.events_log(spark, sf_dir))
    done = s.where(f"segment_base div {fx.SEGMENT} % 3 = 0").select(*_PLACE, "segment_base")
    return s.where("sealed").join(done, [*_PLACE, "segment_base"], "left_anti").select("partition", "segment_base", "bytes")


@query("compact_bounded", fx.ORACLE_ALL + """, bound AS (SELECT partition, stable_offset // 2 AS e FROM lso), judged AS (SELECT log.* FROM log JOIN bound USING (partition) WHERE record_offset < e),
  m AS (SELECT partition, key, max(record_offset) AS last FROM judged WHERE key IS NOT NULL AND NOT is_control GROUP BY 1, 2)
  SELECT j.partition, j.record_offset FROM judged j LEFT JOIN m ON m.partition = j.partition AND m.key = j.key WHERE j.key IS NULL OR j.is_control OR j.record_offset = m.last""")
def compact_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass whose offset map ends halfway to the stable offset: nothing above its end is judged or supersedes anything."""
    log, parts, _, open_txns = fx.log_state(spark, sf_dir)
    ends = iso.stable_offsets(parts, open_txns).select(*_PLACE, F.expr("stable_offset div 2").alias("map_end"))
    return survivors(within_map(log, ends)).select("partition", "record_offset")


@query("markers_forgotten", fx.ORACLE_PARTS + " SELECT DISTINCT l.partition, l.base_offset FROM log l JOIN parts p USING (topic_id, partition) WHERE is_transactional AND l.last_offset >= log_start_offset")
def markers_forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, parts, _, _ = fx.log_state(spark, sf_dir)
    markers = log.where("is_transactional").select(*_PLACE, "base_offset", "last_offset").distinct()
    return forget_markers(markers, parts).select("partition", "base_offset")
