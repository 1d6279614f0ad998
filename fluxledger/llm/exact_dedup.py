"""Exact deduplication as a stateful stream (operator 10, DataFrame functions only).

Documents are landed as narrow rows (digest, stable id, content locator) and streamed through a keyed
aggregation whose state lies in RocksDB on disk and never expires. State per digest: how many rows
carry it, the largest id and that row's locator. A locator names where the content is: file and row
number of the table that `docs` reads, or, if docs is not read from files or a `checkpoint` is given,
run and row number of the landed table, which then holds the texts too. Hits (digests with several rows) are
checked on full bytes, fetched by locator, also against rows of earlier runs: distinct pairs of digest and
whole normalised text, collapsed map-side so that no group of copies is gathered anywhere, must be
one per digest. A Bloom filter that Spark makes of the hits keeps all other texts out of the shuffle.
Digests that fail the check (possible with a weak `digest`, never seen with SHA-256) are grouped
again by digest and full text.

Defined results: null text counts as empty; equal ids in one class count as separate rows of
which each is kept if it carries the largest id; a null id is smaller than any other; ids are cast to
long; other columns, whatever their names, are not read unless `carry` names them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOOM, ascii_lower, load, scratch_path, spark_conf, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a partition's store is closed when its task ends, so open stores follow the cores, not the partitions
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def stream_state(spark: SparkSession, folder: str, checkpoint: str, max_bytes_per_trigger: int = 256 << 30) -> DataFrame:
    """Streams a landed table (digest, id, locator) into the keyed state; returns digest, members, keep_id, keep_locator.

    With the `checkpoint` of earlier runs, whose rows lie in the same folder, their state is found again and only
    new files are read. Updates land as one table per micro-batch, so a batch that is run again after a failure
    overwrites its own output.
    """
    out = f"{checkpoint}/updates"
    schema = "digest binary, members long, keep_id long, keep_locator string"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rows = spark.readStream.schema("digest binary, id long, locator string").option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(folder)
    state = rows.groupBy("digest").agg(F.count("*").alias("members"), F.max("id").alias("keep_id"), F.max_by("locator", "id").alias("keep_locator"))
    with spark_conf(spark, _STATE):
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).foreachBatch(land).start()
        query.awaitTermination()
    updates = spark.read.schema(schema + ", batch long").parquet(out)
    # members and keep_id of a digest only grow, so the last update is the largest
    return updates.groupBy("digest").agg(F.max("members").alias("members"), F.max("keep_id").alias("keep_id"), F.max_by("keep_locator", "members").alias("keep_locator"))


def _place(docs: DataFrame) -> Column | None:
    """File and row number of each row, if docs is read from files that tell."""
    place = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))
    try:
        docs.select(place).schema  # analysed here
    except AnalysisException:
        return None
    return place


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest=None, checkpoint: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, text_sha256, keep_id, keep_locator, group_size, kept and the `carry` columns.

    `digest` maps the normalised text column to a binary key; SHA-256 by default. With `checkpoint`, rows of
    earlier calls with the same folder count too.
    """
    spark = docs.sparkSession
    place = None if checkpoint else _place(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"), *[F.col(c) for c in carry], *([] if place is None else [place.alias("locator")]))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    rows = rows.withColumn("digest", digest(F.col("norm")) if digest else F.unhex("sha"))
    work = checkpoint or scratch_path(spark, "dedup")
    folder, run = f"{work}/landed", uuid.uuid4().hex
    if place is None:
        rows = rows.withColumn("locator", F.concat(F.lit(f"{run}#"), F.monotonically_increasing_id().cast("string"))).withColumn("run", F.lit(run))
        rows.write.mode("append").parquet(folder)
        rows = spark.read.schema(rows.schema).parquet(folder)
        landed = rows.where(F.col("run") == run)
    else:
        narrow = rows.select("digest", "id", "sha", "locator", *carry)
        narrow.write.parquet(folder)
        landed = spark.read.schema(narrow.schema).parquet(folder)
    # tables are written before they are joined, so that Spark can split a hot digest
    state = written(stream_state(spark, folder, work), "dedup-state")
    result = landed.select("digest", "id", "sha", "locator", *carry).join(state, "digest", "left")
    if place is None:
        texts = rows.select("digest", "norm").join(state.where("members > 1").select("digest"), "digest", "left_semi")
    else:
        result = written(result, "dedup-result")
        hits = result.where("members > 1").select("locator", F.col("digest").alias("hit"))
        texts = rows.select("locator", "norm").join(hits, "locator").select(F.col("hit").alias("digest"), "norm")
    with spark_conf(spark, BLOOM):
        odd = written(texts.distinct().groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-odd")
    if not odd.isEmpty():
        again = rows.join(odd, "digest", "left_semi")
        split = again.groupBy("digest", "norm").agg(F.count("*").alias("members"), F.max("id").alias("keep_id"), F.max_by("locator", "id").alias("keep_locator"))
        ours = again.where(F.col("run") == run) if place is None else again
        columns = ["digest", "id", "sha", "locator", *carry, "members", "keep_id", "keep_locator"]
        result = result.join(odd, "digest", "left_anti").select(*columns).unionByName(ours.join(split, ["digest", "norm"]).select(*columns))
    return result.select(F.col("id"), F.col("sha").alias("text_sha256"), "keep_id", "keep_locator", F.col("members").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), *carry)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
