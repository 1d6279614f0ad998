"""Topics: a catalogue, produces that count once their marker is there, reading by name, retention and archive.

Under `root`, `ops` holds numbered JSON files, each one operation on the catalogue, and `topic=ID` a folder
per topic: `data/produce=P/partition=N` with the rows of one produce in offset order, and `markers` with a
numbered JSON file per finished produce: its first and last offset in every partition. Rows store their place in
the produce; the marker's first offset makes it an offset. A marker file can be created only once, so
of two produces at the same time one takes the number and the other moves behind it without
rewriting its rows, and a failed produce leaves rows that no marker names and nobody reads. Markers are
small (a row per produce and partition); bounds on offsets and times cut them first, and only the
produces that are left are scanned.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import partition_for
from ..functions.text import TOPIC_NAME
from ..operators.configs import check_config
from .log import find_offsets, read_log
from .scratch import create_file, delete, file_names, new_folder, read_file
from .sink import PAGES, fits, number_rows, record_size, validate_produce

_ROW = "key string, value string, timestamp timestamp_ntz, header_keys array<string>, header_values array<string>, place long, produce string, partition int"
_MARKER = "produce string, partition int, first_offset long, last_offset long, bytes long, max_timestamp timestamp_ntz, leader_epoch int, at long"
BATCH_RECORDS = 8
#: Bytes of records that a task of a produce sorts at a time.
RANGE_BYTES = 1 << 25


class ProduceError(ValueError):
    """A produce that was refused as a whole."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # the catalogue

    def _ops(self) -> list[dict]:
        return [json.loads(read_file(self.spark, f"{self.root}/ops/{n}")) for n in file_names(self.spark, f"{self.root}/ops") if n.endswith(".json")]

    def _put(self, **op) -> int:
        while True:
            n = len([x for x in file_names(self.spark, f"{self.root}/ops") if x.endswith(".json")])
            if create_file(self.spark, f"{self.root}/ops/{n:012d}.json", json.dumps(op)):
                return n

    def _topics(self) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for n, op in enumerate(self._ops()):
            if op["op"] == "create" and op["name"] not in out:
                out[op["name"]] = {"topic_id": n, "partitions": op["partitions"], "config": op["config"], "start": {}}
            elif op["op"] == "drop":
                out.pop(op["name"], None)
            elif op["name"] in out and op["op"] == "config":
                config = out[op["name"]]["config"]
                out[op["name"]]["config"] = {k: v for k, v in (config | op["set"]).items() if k not in op["unset"]}
            elif op["name"] in out and op["op"] == "start":
                start = out[op["name"]]["start"]
                for p, at in op["offsets"].items():
                    start[int(p)] = max(at, start.get(int(p), 0))  # the log start only moves forward
        return out

    def _topic(self, name: str) -> dict:
        topic = self._topics().get(name)
        if topic is None:
            raise KeyError(f"unknown topic {name!r}")
        return topic

    def create_topic(self, name: str, partitions: int = 1, config: dict[str, str] | None = None) -> int:
        """Returns the topic's id; refuses bad names, names in use, partitions under 1 and bad settings."""
        if not re.fullmatch(TOPIC_NAME.strip("^$"), name) or name in (".", ".."):
            raise ValueError(f"bad topic name {name!r}")
        if partitions < 1:
            raise ValueError("a topic has at least one partition")
        if name in self._topics():
            raise ValueError(f"topic {name!r} exists")
        for k, v in (config or {}).items():
            check_config(k, v)
        self._put(op="create", name=name, partitions=partitions, config=config or {})
        return self._topic(name)["topic_id"]

    def drop_topic(self, name: str) -> None:
        topic = self._topic(name)
        self._put(op="drop", name=name)
        delete(self.spark, self._folder(topic))

    def alter_config(self, name: str, set_: dict[str, str] | None = None, unset: tuple[str, ...] = ()) -> None:
        self._topic(name)
        for k, v in (set_ or {}).items():
            check_config(k, v)
        self._put(op="config", name=name, set=set_ or {}, unset=list(unset))

    def topics(self) -> DataFrame:
        """topic_id, name, partitions, config: a row per topic."""
        rows = [(t["topic_id"], n, t["partitions"], t["config"]) for n, t in self._topics().items()]
        return self.spark.createDataFrame(rows, "topic_id int, name string, partitions int, config map<string,string>")

    def describe_page(self, cursor: tuple[str, int] = ("", 0), limit: int = 2000) -> DataFrame:
        """The next `limit` partitions at or after the cursor (topic, partition), in that order, and where a further page starts."""
        rows = self.topics().select("name", "topic_id", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
        at = F.struct(F.lit(cursor[0]).alias("name"), F.lit(cursor[1]).alias("partition"))
        page = rows.where(F.struct("name", "partition") >= at).orderBy("name", "partition").limit(limit + 1)
        more = page.agg(F.when(F.count("*") > limit, F.max(F.struct("name", "partition"))).alias("next"))
        return page.orderBy("name", "partition").limit(limit).crossJoin(F.broadcast(more)).select("name", "partition", "topic_id", F.col("next.name").alias("next_name"), F.col("next.partition").alias("next_partition"))

    # produce

    def _folder(self, topic: dict) -> str:
        return f"{self.root}/topic={topic['topic_id']}"

    def markers(self, name: str) -> DataFrame:
        topic = self._topic(name)
        if not file_names(self.spark, f"{self._folder(topic)}/markers"):
            return self.spark.createDataFrame([], _MARKER)
        return self.spark.read.schema(_MARKER).json(f"{self._folder(topic)}/markers")

    def produce(self, name: str, rows: DataFrame, order: list[str], produce_id: str | None = None, batch_records: int = BATCH_RECORDS) -> DataFrame:
        """Appends rows (key, value; timestamp, header_keys, header_values and partition may be there too) and returns partition, first_offset, last_offset.

        Order columns say in which order rows arrive. A produce_id that is already marked returns its offsets and writes
        nothing, so a produce can be repeated after a failure. Refused (ProduceError) as a whole: a batch over
        max.message.bytes, a null key where cleanup.policy has compact.
        """
        topic, spark = self._topic(name), self.spark
        pid = produce_id or uuid.uuid4().hex
        if not re.fullmatch(r"[\w.-]+", pid):
            raise ValueError(f"bad produce id {pid!r}")
        done = self.markers(name).where(F.col("produce") == pid).select("partition", "first_offset", "last_offset")
        if produce_id and not done.isEmpty():
            return done
        part = F.coalesce(partition_for(F.col("key"), topic["partitions"]), F.lit(0)).cast("int")
        have = set(rows.columns)
        rows = rows.withColumns({
            "key": F.col("key").cast("string"), "value": F.col("value").cast("string"), "timestamp": F.col("timestamp").cast("timestamp_ntz") if "timestamp" in have else F.localtimestamp(),
            "header_keys": F.col("header_keys") if "header_keys" in have else F.array().cast("array<string>"), "header_values": F.col("header_values") if "header_values" in have else F.array().cast("array<string>"),
            "partition": F.col("partition").cast("int") if "partition" in have else part,
        })
        wanted = ["key", "value", "timestamp", "header_keys", "header_values", "partition"]
        landed = new_folder(spark, "landed")
        rows = rows.select(*wanted, *[c for c in order if c not in wanted], record_size(F.col("key"), F.col("value")).alias("_bytes"))
        rows.write.parquet(landed)  # partitions are hashed once
        rows = spark.read.parquet(landed)
        headers = [F.coalesce(F.octet_length(F.array_join(c, "", "")), F.lit(0)) for c in ("header_keys", "header_values")]
        config = topic["config"]
        limit, compacted = int(config.get("max.message.bytes", 1048588)), "compact" in config.get("cleanup.policy", "delete")
        outside = (F.col("partition") < 0) | (F.col("partition") >= topic["partitions"])
        total, largest, null_keys, outside = rows.agg(F.sum(F.col("_bytes") + headers[0] + headers[1]), F.max("_bytes"), F.count_if(F.col("key").isNull()), F.count_if(outside)).first()
        if total is None:
            delete(spark, landed)
            return done
        if outside or compacted and null_keys or not fits(batch_records * largest, limit):  # else no batch can be refused
            slim = rows.select("partition", *[c for c in order if c != "partition"], F.col("_bytes").alias("_size"), F.col("key").isNull().alias("_no_key"))
            placed, scratch = number_rows(slim, ["partition"], order, ranges=None)
            batches = placed.groupBy("partition", F.expr(f"place div {batch_records}").alias("batch")).agg(F.sum("_size").alias("bytes"), F.count_if("_no_key").alias("null_keys"))
            bad = validate_produce(batches, limit, compacted).where("error is not null")
            found = {r["error"]: r["n"] for r in bad.groupBy("error").agg(F.count("*").alias("n")).collect()}
            delete(spark, scratch)
            if found or outside:
                delete(spark, landed)
                raise ProduceError(", ".join([f"{e}: {n} batches" for e, n in sorted(found.items())] + ([f"UNKNOWN_PARTITION: {outside} records"] if outside else [])))
        # ranges by bytes in memory: repetitive values are far smaller in a shuffle, by which Spark would cut them
        ranges = max(-(-total // RANGE_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // (RANGE_BYTES // 8))))
        placed, scratch = number_rows(rows, ["partition"], order, ranges=ranges)
        delete(spark, landed)
        # a row per partition of this topic reaches the driver
        mine = placed.groupBy("partition").agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes"), F.max("timestamp").cast("string").alias("max_timestamp")).collect()
        data = f"{self._folder(topic)}/data/produce={pid}"
        placed.select(*wanted, "place").sortWithinPartitions("partition", "place").write.mode("overwrite").options(**PAGES).partitionBy("partition").parquet(data)
        delete(spark, scratch)
        folder = f"{self._folder(topic)}/markers"
        while True:
            n = len(file_names(spark, folder))
            ends = {r["partition"]: r["end"] for r in self.markers(name).groupBy("partition").agg((F.max("last_offset") + 1).alias("end")).collect()}
            lines = [{"produce": pid, "partition": r["partition"], "first_offset": ends.get(r["partition"], 0), "last_offset": ends.get(r["partition"], 0) + r["n"] - 1, "bytes": r["bytes"], "max_timestamp": r["max_timestamp"].replace(" ", "T"), "leader_epoch": 0, "at": n} for r in mine]
            if create_file(spark, f"{folder}/{n:012d}.json", "\n".join(map(json.dumps, lines))):
                return spark.createDataFrame([(x["partition"], x["first_offset"], x["last_offset"]) for x in lines], "partition int, first_offset long, last_offset long")

    # reading

    def partition_offsets(self, name: str) -> DataFrame:
        """partition, log_start_offset, high_watermark, offset_span, leader_epoch, from the markers alone; null marks where nothing was written."""
        parts = self._parts(name)
        return parts.select("partition", "log_start_offset", F.col("next_offset").alias("high_watermark"), (F.col("next_offset") - F.col("log_start_offset")).alias("offset_span"), "leader_epoch")

    def _parts(self, name: str) -> DataFrame:
        topic = self._topic(name)
        every = self.spark.createDataFrame([(topic["topic_id"], p, topic["start"].get(p, 0)) for p in range(topic["partitions"])], "topic_id int, partition int, log_start_offset long")
        ends = self.markers(name).groupBy("partition").agg((F.max("last_offset") + 1).alias("next_offset"), F.max("leader_epoch").alias("leader_epoch"))
        return every.join(F.broadcast(ends), "partition", "left").select("topic_id", "partition", "log_start_offset", F.coalesce("leader_epoch", F.lit(0)).alias("leader_epoch"), "next_offset")

    def stored(self, name: str, partition: int | None = None, from_offset: int | None = None, to_offset: int | None = None, from_time: str | None = None) -> DataFrame:
        """The stored log of a topic; bounds leave out whole produces by their markers, the rest is cut by the reader."""
        topic = self._topic(name)
        marks = self.markers(name)
        if partition is not None:
            marks = marks.where(F.col("partition") == partition)
        if from_offset is not None:
            marks = marks.where(F.col("last_offset") >= from_offset)
        if to_offset is not None:
            marks = marks.where(F.col("first_offset") < to_offset)
        if from_time is not None:
            marks = marks.where(F.col("max_timestamp") >= F.lit(from_time).cast("timestamp_ntz"))
        folder = f"{self._folder(topic)}/data"
        if file_names(self.spark, folder):
            data = self.spark.read.schema(_ROW).option("basePath", folder).parquet(folder)
        else:
            data = self.spark.createDataFrame([], _ROW)
        if partition is not None:
            data = data.where(F.col("partition") == partition)
        none = lambda t: F.lit(None).cast(t)
        rows = data.join(F.broadcast(marks.select("produce", "partition", "first_offset", "leader_epoch", F.col("last_offset").alias("last"))), ["produce", "partition"])
        offset = F.col("first_offset") + F.col("place")
        base = F.col("first_offset") + F.expr(f"place div {BATCH_RECORDS} * {BATCH_RECORDS}")
        return rows.select(
            F.lit(topic["topic_id"]).alias("topic_id"), "partition", offset.alias("record_offset"), "timestamp", F.lit("CreateTime").alias("timestamp_type"), "key", "value", "header_keys", "header_values",
            "leader_epoch", none("long").alias("producer_id"), none("int").alias("producer_epoch"), none("int").alias("sequence"), F.lit(False).alias("is_transactional"), F.lit(False).alias("is_control"),
            base.alias("base_offset"), F.least(base + BATCH_RECORDS - 1, F.col("last")).alias("last_offset"), record_size(F.col("key"), F.col("value")).alias("size_bytes"), "produce",
        )

    def read(self, name: str, partition: int | None = None, from_offset: int | None = None, to_offset: int | None = None, from_time: str | None = None, to_time: str | None = None, max_records: int | None = None) -> DataFrame:
        """Records of finished produces in LOG_COLUMNS, within all bounds."""
        parts = self._parts(name)
        if from_time is None and to_time is None:
            log = self.stored(name, partition, from_offset, to_offset)
        else:
            log = self.stored(name, partition)  # a time bound is an offset found among all records
        aborted = self.spark.createDataFrame([], "topic_id int, partition int, producer_id long, first_offset long, marker_offset long")
        return read_log(log, parts, aborted, aborted.select("topic_id", "partition", "producer_id", "first_offset"), None, partition, from_offset, to_offset, from_time, to_time, "read_uncommitted", max_records)

    def offset_for_time(self, name: str, at: str) -> DataFrame:
        """partition, found: produces that end before the time are not scanned."""
        return find_offsets(self.stored(name, from_time=at), at).select("partition", "found")

    # maintenance

    def delete_records(self, name: str, offsets: dict[int, int]) -> DataFrame:
        """Moves log starts (-1: to the end) and returns partition, error, low_watermark."""
        parts = {r["partition"]: (r["log_start_offset"], r["next_offset"] or 0) for r in self._parts(name).collect()}
        out, moved = [], {}
        for p, at in sorted(offsets.items()):
            start, end = parts.get(p, (0, -1))
            at = end if at == -1 else at
            ok = 0 <= at <= end
            out.append((p, "NONE" if ok else "OFFSET_OUT_OF_RANGE", max(start, at) if ok else start))
            if ok and at > start:
                moved[str(p)] = at
        if moved:
            self._put(op="start", name=name, offsets=moved)
        return self.spark.createDataFrame(out, "partition int, error string, low_watermark long")

    def enforce_retention(self, name: str, retention_ms: int | None = None, retention_bytes: int | None = None, now: str | None = None) -> DataFrame:
        """Drops the oldest produces that are past the time or over the bytes, except the newest of a partition; log starts move with them. Returns partition, dropped, new_log_start.

        Limits default to the topic's retention.ms and retention.bytes; on a topic whose policy is compact alone nothing goes.
        """
        from pyspark.sql import Window

        config = self._topic(name)["config"]
        policy = config.get("cleanup.policy", "delete")
        retention_ms = int(config.get("retention.ms", -1)) if retention_ms is None else retention_ms
        retention_bytes = int(config.get("retention.bytes", -1)) if retention_bytes is None else retention_bytes
        w = Window.partitionBy("partition").orderBy("first_offset")
        starts = self._parts(name).select("partition", "log_start_offset")
        m = self.markers(name).join(F.broadcast(starts), "partition").where("last_offset >= log_start_offset")
        m = m.withColumns({"upto": F.max("max_timestamp").over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("bytes").over(Window.partitionBy("partition")), "newest": F.max("first_offset").over(Window.partitionBy("partition"))})
        gone = F.lit(False)
        if retention_ms >= 0:
            at = F.localtimestamp() if now is None else F.lit(now).cast("timestamp_ntz")
            gone = gone | (F.col("upto") < at - F.make_dt_interval(secs=F.lit(retention_ms / 1000).cast("decimal(18,6)")))
        if retention_bytes >= 0:
            gone = gone | (F.col("before") < F.col("all") - retention_bytes)
        if policy == "compact":
            gone = F.lit(False)
        drop = m.where(gone & (F.col("first_offset") < F.col("newest"))).groupBy("partition").agg(F.count("*").alias("dropped"), (F.max("last_offset") + 1).alias("new_log_start"))
        rows = [tuple(r) for r in drop.collect()]
        if rows:
            self._put(op="start", name=name, offsets={str(p): at for p, _, at in rows})
        return self.spark.createDataFrame(rows, "partition int, dropped long, new_log_start long")

    def archive(self, name: str, target: str) -> DataFrame:
        """Copies finished produces that the archive does not hold, then notes them in its ledger, a file a produce; returns the ones copied."""
        pending = self.markers(name).join(self.archived(target), ["produce", "partition"], "left_anti")
        ids = sorted({r["produce"] for r in pending.select("produce").distinct().collect()})
        folder = f"{self._folder(self._topic(name))}/data"
        for pid in ids:
            self.spark.read.schema(_ROW.replace(", produce string", "")).parquet(f"{folder}/produce={pid}").write.mode("overwrite").partitionBy("partition").parquet(f"{target}/data/produce={pid}")
            lines = [json.dumps({k: (str(v).replace(" ", "T") if k == "max_timestamp" else v) for k, v in r.asDict().items()}) for r in pending.where(F.col("produce") == pid).collect()]
            create_file(self.spark, f"{target}/ledger/{pid}.json", "\n".join(lines))
        return self.archived(target).where(F.col("produce").isin(ids)).select("produce", "partition", "first_offset", "last_offset", "bytes")

    def archived(self, target: str) -> DataFrame:
        if not file_names(self.spark, f"{target}/ledger"):
            return self.spark.createDataFrame([], _MARKER)
        return self.spark.read.schema(_MARKER).json(f"{target}/ledger")
