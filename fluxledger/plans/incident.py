"""The incident analysis: repeated charges, when they happened, what changed, who is owed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from .registry import registry

QUERIES, ORACLES, query = registry()
_FROM, _TO = "1997-05-31 12:00:00", "1997-06-03 12:00:00"


def repeats(payments: DataFrame) -> DataFrame:
    """Every charge with its number among the charges of its order."""
    w = Window.partitionBy("order_id").orderBy("charged_at", "again")
    return payments.withColumn("n", F.row_number().over(w))


@query("incident_how_bad", "WITH " + fx.PAYMENT_CTES + """
SELECT count(*) AS repeats, count(DISTINCT customer) AS customers, CAST(sum(amount_cents) AS BIGINT) AS cents, min(charged_at) AS first_at, max(charged_at) AS last_at
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY charged_at, again) AS n FROM pay) WHERE n > 1""")
def how_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(fx.payments(spark, sf_dir)).where("n > 1").agg(
        F.count("*").alias("repeats"), F.count_distinct("customer").alias("customers"), F.sum("amount_cents").alias("cents"),
        F.min("charged_at").alias("first_at"), F.max("charged_at").alias("last_at"))


@query("incident_when", "WITH " + fx.PAYMENT_CTES + """
SELECT date_trunc('day', charged_at)::TIMESTAMP AS day, count(*) AS charges, count(*) FILTER (WHERE version = '2.4.1') AS new_version, CAST(sum(amount_cents) AS BIGINT) AS cents
FROM pay GROUP BY 1""")
def when(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", F.col("charged_at").cast("timestamp")).cast("timestamp_ntz")
    return fx.payments(spark, sf_dir).groupBy(day.alias("day")).agg(F.count("*").alias("charges"), F.count_if(F.col("version") == "2.4.1").alias("new_version"), F.sum("amount_cents").alias("cents"))


@query("incident_what_changed", "WITH " + fx.PAYMENT_CTES + f"""
SELECT date_trunc('minute', charged_at)::TIMESTAMP AS minute, version, count(*) AS charges
FROM pay WHERE charged_at >= TIMESTAMP '{_FROM}' AND charged_at < TIMESTAMP '{_TO}' GROUP BY 1, 2""")
def what_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.payments(spark, sf_dir).where(F.col("charged_at").between(F.to_timestamp_ntz(F.lit(_FROM)), F.to_timestamp_ntz(F.lit(_TO))) & (F.col("charged_at") < F.to_timestamp_ntz(F.lit(_TO))))
    minute = F.date_trunc("minute", F.col("charged_at").cast("timestamp")).cast("timestamp_ntz")
    return p.groupBy(minute.alias("minute"), "version").agg(F.count("*").alias("charges"))


@query("incident_refunds", "WITH " + fx.PAYMENT_CTES + """
SELECT n.order_id, c.c_name AS customer_name, n.amount_cents, n.charged_at
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY charged_at, again) AS n FROM pay) n JOIN customer c ON c.c_custkey = n.customer WHERE n.n > 1""")
def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("customer_name"))
    return repeats(fx.payments(spark, sf_dir)).where("n > 1").join(c, "customer").select("order_id", "customer_name", "amount_cents", "charged_at")


@query("stock_state_compacted", """
WITH m AS (SELECT l_partkey AS part, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS used,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS last FROM lineitem)
SELECT part, CAST(round(100000 - used) AS BIGINT) AS stock FROM m WHERE last = 1""")
def stock_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running stock per part compacted to its latest value: the last running sum is the whole sum, so no window is needed."""
    return fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.round(100000 - F.sum("l_quantity")).cast("long").alias("stock"))


@query("shipments_projection", """
SELECT o_orderkey AS order_id, CASE WHEN o_totalprice >= 200000 THEN 'express' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'priority' ELSE 'standard' END AS carrier
FROM orders WHERE o_orderstatus = 'F'""")
def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    carrier = F.when(F.col("o_totalprice") >= 200000, "express").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "priority").otherwise("standard")
    return fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"), carrier.alias("carrier"))
