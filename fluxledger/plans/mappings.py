"""Queries over change mappings: drained topics, dead letters, places, previews, snapshots, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..sources import Catalog
from ..sources.scratch import new_folder, once
from ..streaming.drain import ChangeMappings, commit_summaries, deliverable, snapshot_changes
from ..streaming.reader import read_log_stream, records_of
from . import cdc
from .registry import registry

QUERIES, ORACLES, query = registry()
_COLUMNS = "id bigint, cents bigint, status string"


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of the fixture as CHANGE_SCHEMA rows; every 97th amount is no number, deletes carry key and status only."""
    c = cdc.changes(spark, sf_dir)
    cents = F.when(F.col("cents") % 97 == 0, "n/a").otherwise(F.col("cents").cast("string"))
    id_ = F.col("id").cast("string")
    new = F.when(F.col("op") != "D", F.create_map(F.lit("id"), id_, F.lit("cents"), cents, F.lit("status"), F.col("new_status")))
    old = F.when(F.col("op") != "I", F.create_map(F.lit("id"), id_, F.lit("status"), F.col("old_status")))
    cols = F.from_json(F.lit('[{"name":"id","type":"bigint"},{"name":"cents","type":"bigint"},{"name":"status","type":"text"}]'), "array<struct<name:string,type:string>>")
    return c.select(
        (F.col("end_lsn") + F.col("seq")).alias("lsn"), F.col("end_lsn").cast("long").alias("end_lsn"), (F.col("id") * 3 + F.col("seq")).alias("seq"), F.col("xid").cast("long").alias("xid"), F.lit(None).cast("timestamp_ntz").alias("commit_ts"),
        "op", F.lit("public").alias("schema"), F.lit("orders").alias("table"), cols.alias("cols"), new.alias("new"), old.alias("old"),
    )


def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderstatus").alias("status"))


def drained(spark: SparkSession, sf_dir: str) -> tuple[Catalog, ChangeMappings, DataFrame]:
    """Two mappings of the orders' changes, drained three times: the older half of the commits, the newer half, nothing new."""

    def fill(path: str) -> None:
        catalog = Catalog(spark, path)
        catalog.create_topic("paid")
        catalog.create_topic("all")
        m = ChangeMappings(catalog, f"{path}/mappings")
        value = "to_json(struct(new.id AS id, new.cents AS cents, op))"
        m.add_mapping("paid", "public.orders", "paid", _COLUMNS, value, "new.id", "new.status = 'F'", "skip")
        m.add_mapping("all", "orders", "all", _COLUMNS, "op", "new.id")
        m.add_mapping("removed", "orders", "all", _COLUMNS, "op")
        m.remove_mapping("removed")
        changes = order_changes(spark, sf_dir)
        half = changes.agg(F.expr("max(xid) div 2").alias("h")).first()["h"]
        folder = f"{path}/changes"
        for part in (F.col("xid") <= half, F.col("xid") > half):
            changes.where(part).write.mode("append").option("maxRecordsPerFile", 500_000).parquet(folder)  # small files can be shared out
            m.drain(folder)
        m.drain(folder)

    path = once(spark, (sf_dir, "drained-orders"), fill)
    catalog = Catalog(spark, path)
    return catalog, ChangeMappings(catalog, f"{path}/mappings"), spark.read.parquet(f"{path}/changes")


_C = cdc._CHANGES + """, h AS (SELECT max(xid) // 2 AS h FROM changes), ch AS (SELECT *, id * 3 + seq AS place, cents % 97 = 0 AND op <> 'D' AS broken, CASE WHEN op = 'D' THEN old_status ELSE new_status END AS status, xid > h AS late FROM changes, h)"""


@query("mapping_drain", _C + """ SELECT row_number() OVER (ORDER BY late, end_lsn, place) - 1 AS record_offset, CAST(id AS VARCHAR) AS key,
  '{"id":' || id || CASE WHEN op <> 'D' THEN ',"cents":' || cents ELSE '' END || ',"op":"' || op || '"}' AS value FROM ch WHERE NOT broken AND status = 'F'""")
def mapping_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic that a mapping with filter, key and value filled, in the order of the commits; unreadable changes were skipped."""
    return drained(spark, sf_dir)[0].read("paid").select("record_offset", "key", "value")


@query("mapping_dead_letters", _C + " SELECT 'paid' AS mapping, end_lsn, place AS seq, 'cents is no bigint' AS error FROM ch WHERE broken")
def mapping_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, sf_dir)[1].dead_letters()


@query("mapping_stalled_topic", _C + ", b AS (SELECT min(end_lsn) AS hold FROM ch WHERE broken) SELECT row_number() OVER (ORDER BY end_lsn, place) - 1 AS record_offset, CAST(id AS VARCHAR) AS key, op AS value FROM ch, b WHERE end_lsn < hold")
def mapping_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping that stalls has sent the whole commits before the first one it cannot render, and nothing of later drains."""
    return drained(spark, sf_dir)[0].read("all").select("record_offset", "key", "value")


_PLACES = ", b AS (SELECT min(end_lsn) AS hold FROM ch WHERE broken), pl AS (SELECT 'all' AS mapping, max(end_lsn) AS end_lsn, arg_max(place, end_lsn * 100000000 + place) AS seq FROM ch, b WHERE end_lsn < hold UNION ALL SELECT 'paid', max(end_lsn), arg_max(place, end_lsn * 100000000 + place) FROM ch WHERE broken OR status = 'F')"


@query("mapping_status", _C + _PLACES + " SELECT mapping, pl.end_lsn, pl.seq, (SELECT count(*) FROM ch WHERE (ch.end_lsn, ch.place) > (pl.end_lsn, pl.seq) AND (mapping = 'all' OR broken OR status = 'F')) AS pending, CASE WHEN mapping = 'paid' THEN (SELECT count(*) FROM ch WHERE broken) ELSE 0 END AS dead FROM pl")
def mapping_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m, changes = drained(spark, sf_dir)
    return m.status(changes)


@query("slot_advance_target", _C + _PLACES + " SELECT min(end_lsn) AS target FROM pl WHERE mapping = 'all'")
def slot_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source may forget up to the place of the mapping that is behind."""
    _, m, changes = drained(spark, sf_dir)
    return spark.createDataFrame([(m.slot_target(changes),)], "target long")


@query("mapping_preview", """SELECT CAST(o_orderkey AS VARCHAR) AS key, '{"id":' || o_orderkey || ',"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || ',"op":"I"}' AS value FROM orders WHERE o_orderstatus = 'F' AND CAST(round(o_totalprice * 100) AS BIGINT) > 10000000""")
def mapping_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, sf_dir)[1].preview("paid", orders_table(spark, sf_dir), "new.cents > 10000000")


@query("mapping_snapshot", """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS record_offset, CAST(o_orderkey AS VARCHAR) AS key, '{"id":' || o_orderkey || ',"op":"R"}' AS value FROM orders""")
def mapping_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once, in the order of the key; run twice, sent once."""
    path = new_folder(spark, "snapshot")
    catalog = Catalog(spark, path)
    catalog.create_topic("orders")
    m = ChangeMappings(catalog, f"{path}/mappings")
    m.add_mapping("orders", "orders", "orders", _COLUMNS, "to_json(struct(new.id AS id, op))", "new.id")
    for _ in range(2):
        m.snapshot("orders", orders_table(spark, sf_dir), ["id"])
    return catalog.read("orders").select("record_offset", "key", "value")


@query("change_diff", "WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'I' WHEN b.id IS NULL THEN 'D' ELSE 'U' END AS op, a.s AS old_status, b.s AS new_status FROM a FULL JOIN b ON a.id = b.id WHERE a.s IS DISTINCT FROM b.s")
def change_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that lead from one state of a table to another."""
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    after = o.where("id % 7 <> 0").withColumn("status", F.when(F.col("id") % 4 == 0, "X").otherwise(F.col("status")))
    out = snapshot_changes(o.where("id % 5 <> 0"), after, "orders", ["id"])
    return out.select(F.col("k.id").alias("id"), "op", F.try_element_at("old", F.lit("status")).alias("old_status"), F.try_element_at("new", F.lit("status")).alias("new_status"))


@query("commit_summary", _C + """, b AS (SELECT max(end_lsn) // 2 AS e FROM ch) SELECT xid, end_lsn, count(*) AS event_count, '{"public.orders":' || count(*) || '}' AS data_collections FROM ch, b WHERE end_lsn <= e GROUP BY xid, end_lsn""")
def commit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent after each commit that ended by a place: how many changes it had, by table."""
    changes = order_changes(spark, sf_dir)
    upto = changes.agg(F.expr("max(end_lsn) div 2").alias("e")).first()["e"]
    return commit_summaries(changes, upto).select("xid", "end_lsn", "event_count", F.to_json("data_collections").alias("data_collections"))


@query("deliverable_prefix", _C + ", b AS (SELECT min(end_lsn) - 1 AS hold FROM ch WHERE broken) SELECT id, seq FROM ch, b WHERE end_lsn <= hold")
def deliverable_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = order_changes(spark, sf_dir)
    hold = changes.where(F.expr("try_element_at(new, 'cents') = 'n/a'")).agg((F.min("end_lsn") - 1).alias("h")).first()["h"]
    return deliverable(changes, hold).select(F.expr("seq div 3").alias("id"), (F.col("seq") % 3).cast("int").alias("seq"))


@query("topic_stream", _C + " SELECT 0 AS partition, count(*) AS records, min(id) AS least, max(id) AS largest FROM ch WHERE NOT broken AND status = 'F'")
def topic_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic read as a stream of finished produces, landed batch by batch; a batch that runs again overwrites itself."""
    catalog, out = drained(spark, sf_dir)[0], new_folder(spark, "topic-stream")

    def land(markers: DataFrame, batch_id: int) -> None:
        records_of(catalog, "paid", markers).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = read_log_stream(catalog, "paid", max_produces_per_trigger=1)
    stream.writeStream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(land).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("partition").agg(F.count("*").alias("records"), F.min(F.col("key").cast("long")).alias("least"), F.max(F.col("key").cast("long")).alias("largest"))
