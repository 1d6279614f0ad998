"""Shared pieces: scratch tables, ASCII lower-casing, word rules, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not blank, tab or line/page break.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Runtime Bloom filters at any size of both tables; the filter itself has a fixed size.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1024g"}


@contextmanager
def spark_conf(spark: SparkSession, values: dict[str, str]):
    """Sets SQL settings for the plans made inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast path of lower()."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Lets Spark cut the Arrow batches it sends to Python by bytes, unless the session says otherwise than Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local master without one gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch folders of each application that are still there.
_folders: dict[str, set[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _folders.get(spark.sparkContext.applicationId, set()).discard(folder)


def release_scratch(spark: SparkSession) -> None:
    """Deletes every scratch folder that operators of this application still keep. Results not yet saved read some of them, so save these first."""
    for folder in list(_folders.get(spark.sparkContext.applicationId, ())):
        _delete(spark, folder)


def written(df: DataFrame, name: str, watch: Observation | None = None, *metrics: Column) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors. `watch` gets `metrics` of the rows written."""
    path = scratch_path(df.sparkSession, name)
    (df.observe(watch, *metrics) if watch else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_folder = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_folder)


def bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """Packed bits, `size` of them (a fixed bound), set at every value of the int column `bit`; at most size / 8 bytes reach the driver.

    Made for broadcasting as a filter before an exact join: it may let too much pass, never too little.
    """
    out = np.zeros(-(-size // 32768) * 4096, np.uint8)
    parts = bits.groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768)).cast("long")).alias("bits"))
    for r in parts.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def has_bit(packed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (packed[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) as (id, component), component being the smallest id in reach.

    Alternates large-star and small-star steps, each one grouping by node with map-side
    minimum first; the edge table is rewritten to the shared folder each round, so neither
    the driver nor a task ever holds a component. Nodes with no partner are not returned.
    """
    und = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = written(und, "cc")
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour points to the smallest of the neighbourhood
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour and the node itself point to the smallest
        down = large.distinct()
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        watch = Observation()
        nxt = written(small.where("a <> b").distinct(), "cc", watch, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        state = watch.get
        drop_written(cur)
        cur = nxt
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own)
