"""Change projection: row changes to keyed records, enrichment, snapshots, commits, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .registry import registry

QUERIES, ORACLES, query = registry()

#: An insert per order, an update of every third, a delete of every eleventh; four order keys share a commit.
_CHANGES = """WITH c0 AS (
  SELECT o_orderkey AS id, o_custkey AS customer, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority AS priority,
    o_orderkey // 4 AS xid, o_orderkey // 4 * 1000 AS end_lsn, CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE 'F' END AS before, o_orderstatus AS after FROM orders
), changes AS (
  SELECT *, 0 AS seq, 'I' AS op, NULL AS old_status, before AS new_status FROM c0
  UNION ALL SELECT *, 1, 'U', before, after FROM c0 WHERE id % 3 = 0
  UNION ALL SELECT *, 2, 'D', CASE WHEN id % 3 = 0 THEN after ELSE before END, NULL FROM c0 WHERE id % 11 = 0
)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = fx.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = F.when(key % 2 == 0, "P").otherwise("F")
    none = F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("I").alias("op"), none.alias("old_status"), first.alias("new_status")),
        F.when(key % 3 == 0, F.struct(F.lit(1).alias("seq"), F.lit("U").alias("op"), first.alias("old_status"), F.col("o_orderstatus").alias("new_status"))),
        F.when(key % 11 == 0, F.struct(F.lit(2).alias("seq"), F.lit("D").alias("op"), F.when(key % 3 == 0, F.col("o_orderstatus")).otherwise(first).alias("old_status"), none.alias("new_status"))),
    )
    rows = o.select(key.alias("id"), F.col("o_custkey").alias("customer"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderpriority").alias("priority"), F.expr("o_orderkey div 4").alias("xid"), F.explode(F.array_compact(kinds)).alias("c"))
    return rows.select("*", (F.col("xid") * 1000).alias("end_lsn"), "c.*").drop("c")


def transition(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """What a row filter makes of each change: entering rows are inserts, leaving ones deletes, others are not sent."""
    was, now = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
    return rows.withColumn("sent", F.when(was & now, "U").when(now, "I").when(was, "D")).where("sent is not null")


@query("cdc_render", _CHANGES + """ SELECT CAST(id AS VARCHAR) AS key, CASE WHEN op <> 'D' THEN '{"id":' || id || ',"cents":' || cents || ',"status":"' || new_status || '"}' END AS value, xid, seq FROM changes""")
def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct("id", "cents", F.col("new_status").alias("status")))
    return changes(spark, sf_dir).select(F.col("id").cast("string").alias("key"), F.when(F.col("op") != "D", body).alias("value"), "xid", "seq")


@query("cdc_delete_key", _CHANGES + " SELECT CAST(id AS VARCHAR) AS key, xid, end_lsn FROM changes WHERE op = 'D'")
def delete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).where("op = 'D'").select(F.col("id").cast("string").alias("key"), "xid", "end_lsn")


@query("cdc_filter_transition", _CHANGES + " SELECT id, seq, CASE WHEN o AND n THEN 'U' WHEN n THEN 'I' ELSE 'D' END AS sent FROM (SELECT *, coalesce(old_status = 'F', false) AS o, coalesce(new_status = 'F', false) AS n FROM changes) WHERE o OR n")
def filter_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transition(changes(spark, sf_dir), F.col("old_status") == "F", F.col("new_status") == "F").select("id", "seq", "sent")


@query("cdc_enrich", _CHANGES + " SELECT id, seq, op, c_mktsegment AS segment FROM changes LEFT JOIN customer ON c_custkey = customer")
def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    return changes(spark, sf_dir).join(c, "customer", "left").select("id", "seq", "op", "segment")


@query("cdc_toast_unchanged", _CHANGES + " SELECT id, seq, CASE WHEN id % 7 = 0 THEN 'unchanged' ELSE 'sent' END AS state, CASE WHEN id % 7 <> 0 THEN priority END AS priority FROM changes WHERE op = 'U'")
def toast_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large column that the update did not touch (every seventh) is left out of the message, which differs from null."""
    sent = F.when(F.col("id") % 7 != 0, F.create_map(F.lit("priority"), F.col("priority"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = changes(spark, sf_dir).where("op = 'U'").withColumn("new", sent)
    return rows.select("id", "seq", F.when(F.map_contains_key("new", "priority"), "sent").otherwise("unchanged").alias("state"), F.try_element_at("new", F.lit("priority")).alias("priority"))


@query("cdc_two_shapes", _CHANGES + ", half AS (SELECT CAST(max(id) // 2 AS BIGINT) AS h FROM changes) SELECT CASE WHEN id > h THEN 'total_cents' ELSE 'cents' END AS column_name, count(*) AS records, CAST(sum(cents) AS BIGINT) AS cents FROM changes, half WHERE op <> 'D' GROUP BY 1")
def two_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows carry a renamed column; both shapes are read as one."""
    c = changes(spark, sf_dir)
    renamed = F.col("id") > F.floor(c.agg(F.max("id")).scalar() / 2)
    name = F.when(renamed, "total_cents").otherwise("cents")
    doc = c.where("op <> 'D'").select(name.alias("column_name"), F.to_json(F.create_map(name, F.col("cents"))).alias("v"))
    doc = doc.withColumn("r", F.from_json("v", "cents long, total_cents long"))
    return doc.groupBy("column_name").agg(F.count("*").alias("records"), F.sum(F.coalesce("r.total_cents", "r.cents")).alias("cents"))


@query("cdc_snapshot", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def snapshot_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyset page: the next 50 keys after the last one sent, in the key's own order."""
    o = fx.table(spark, sf_dir, "orders").where("o_orderkey > 100").orderBy("o_orderkey").limit(50)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("cdc_snapshot_page_composite", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY l_orderkey, l_linenumber LIMIT 50")
def snapshot_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = "l_orderkey >= 100 and (l_orderkey > 100 or l_linenumber > 2)"  # the first term reaches the scan
    return fx.table(spark, sf_dir, "lineitem").where(after).select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(50)


@query("cdc_txn_summary", _CHANGES + " SELECT xid, end_lsn, count(*) AS records, count(*) FILTER (WHERE op = 'I') AS inserts, count(*) FILTER (WHERE op = 'U') AS updates, count(*) FILTER (WHERE op = 'D') AS deletes FROM changes GROUP BY xid, end_lsn")
def txn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("op") == k[0].upper()).alias(k) for k in ("inserts", "updates", "deletes")]
    return changes(spark, sf_dir).groupBy("xid", "end_lsn").agg(F.count("*").alias("records"), *counts)


_BAD = "op = 'U' AND cents > 30000000"


@query("cdc_dead_letter", _CHANGES + f" SELECT id, seq, end_lsn, 'amount above limit' AS reason FROM changes WHERE {_BAD}")
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).where(_BAD).select("id", "seq", "end_lsn", F.lit("amount above limit").alias("reason"))


@query("cdc_stall_prefix", _CHANGES + f" SELECT id, seq FROM changes WHERE end_lsn < coalesce((SELECT min(end_lsn) FROM changes WHERE {_BAD}), 9223372036854775807)")
def stall_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without dead letters, only whole commits before the first failing one are delivered."""
    c = changes(spark, sf_dir)
    first = c.where(_BAD).agg(F.coalesce(F.min("end_lsn"), F.lit(2**63 - 1))).scalar()
    return c.where(F.col("end_lsn") < first).select("id", "seq")


@query("cdc_resume", _CHANGES + " SELECT id, seq FROM changes WHERE end_lsn > 200000 OR (end_lsn = 200000 AND id * 3 + seq > 2402)")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes after a stored place inside a commit."""
    place = F.struct("end_lsn", (F.col("id") * 3 + F.col("seq")).alias("at")) > F.struct(F.lit(200000).cast("long").alias("end_lsn"), F.lit(2402).cast("long").alias("at"))
    return changes(spark, sf_dir).where(place & (F.col("end_lsn") >= 200000)).select("id", "seq")


@query("outbox_route", _CHANGES + " SELECT CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'orders.fast' ELSE 'orders.slow' END AS topic, count(*) AS records FROM changes WHERE op = 'I' GROUP BY 1 UNION ALL SELECT 'orders.audit', count(*) FROM changes WHERE op <> 'I'")
def outbox_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.col("op") != "I", "orders.audit").when(F.col("priority").isin("1-URGENT", "2-HIGH"), "orders.fast").otherwise("orders.slow")
    return changes(spark, sf_dir).groupBy(topic.alias("topic")).agg(F.count("*").alias("records"))
