"""Row changes to topics: mappings, their check and preview, snapshots, and a drain as a stream with a ledger.

A change is a row of CHANGE_SCHEMA: op I, U or D (R in a snapshot), the table, its declared columns, and the new
and old values as text by column name. A mapping says for one table which changes go to which topic, with SQL
expressions over `new`, `old` (structs of the declared columns), `op`, `lsn`, `xid`, `commit_ts` and
`toast_unchanged` (declared columns that an update did not send). A delete's `new` is its before-image.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import CHANGE_SCHEMA
from ..sources.catalog import Catalog
from ..sources.scratch import create_file, delete, file_names, new_folder, read_file

_SOURCE = re.compile(r"[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)?")
_NONE = 2**63 - 1


def valid_source(name: str) -> bool:
    """A table name: letters, digits and underscores with at most one dot inside, 128 characters at most."""
    return len(name) <= 128 and _SOURCE.fullmatch(name) is not None


def _fields(columns: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(columns)]


def _typed(source: str, columns: str):
    return F.struct(*[F.try_element_at(source, F.lit(n)).try_cast(t).alias(n) for n, t in _fields(columns)])


def _in_scope(changes: DataFrame, columns: str) -> DataFrame:
    """Changes with new and old as typed structs, toast_unchanged, and `broken`: a declared column whose text is not of its type."""
    names = F.array(*[F.lit(n) for n, _ in _fields(columns)])
    image = F.when(F.col("op") == "D", F.col("old")).otherwise(F.col("new"))
    rows = changes.withColumns({"_image": image, "toast_unchanged": F.when(F.col("new").isNotNull(), F.array_except(names, F.map_keys("new"))).otherwise(F.array().cast("array<string>"))})
    rows = rows.withColumns({"_new": _typed("_image", columns), "_old": _typed("old", columns)})
    broken = [F.when(F.try_element_at("_image", F.lit(n)).isNotNull() & F.col("_new").getField(n).isNull(), F.lit(f"{n} is no {t}")) for n, t in _fields(columns)]
    return rows.withColumn("broken", F.coalesce(*broken)).withColumns({"new": F.col("_new"), "old": F.col("_old")}).drop("_image", "_new", "_old")


def render(changes: DataFrame, mapping: dict) -> DataFrame:
    """lsn, end_lsn, seq, xid, op, key, value, error of the changes that a mapping takes; a change with an error has no key and value."""
    rows = _in_scope(changes.where((F.col("table") == mapping["source"]) | (F.concat("schema", F.lit("."), "table") == mapping["source"])), mapping["columns"])
    rows = rows.where(F.col("broken").isNotNull() | F.coalesce(F.expr(mapping["filter"]), F.lit(False)))
    text = lambda e: F.when(F.col("broken").isNull(), F.expr(e).cast("string"))
    return rows.select("lsn", "end_lsn", "seq", "xid", "op", text(mapping["key"]).alias("key"), text(mapping["value"]).alias("value"), F.col("broken").alias("error"))


def change_rows(rows: DataFrame, table: str, op: str, key_columns: list[str] | None = None, schema: str = "public") -> DataFrame:
    """Rows of a table as changes of one kind, without a place in any commit: what a snapshot (op R) sends."""
    if key_columns is not None and not key_columns:
        raise ValueError(f"{table} has no key: a snapshot could not be repeated or resumed")
    names = rows.columns
    pairs = [x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    image = F.create_map(*pairs)
    cols = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(rows.schema[c].dataType.simpleString()).alias("type")) for c in names])
    none = F.lit(None)
    return rows.select(
        none.cast("long").alias("lsn"), none.cast("long").alias("end_lsn"), none.cast("long").alias("seq"), none.cast("long").alias("xid"), none.cast("timestamp_ntz").alias("commit_ts"),
        F.lit(op).alias("op"), F.lit(schema).alias("schema"), F.lit(table).alias("table"), cols.alias("cols"), (none.cast("map<string,string>") if op == "D" else image).alias("new"),
        (image if op == "D" else none.cast("map<string,string>")).alias("old"),
    )


def snapshot_changes(before: DataFrame, after: DataFrame, table: str, key_columns: list[str]) -> DataFrame:
    """Changes that lead from one state of a table to another: a full outer join on the key, one commit, ordered by key."""
    if not key_columns:
        raise ValueError(f"{table} has no key")
    names = after.columns
    whole = lambda df, n: df.select(F.struct(*key_columns).alias("k"), F.struct(*names).alias(n))
    both = whole(before, "o").join(whole(after, "n"), "k", "full").where(~F.col("o").eqNullSafe(F.col("n")))
    as_map = lambda s: F.when(F.col(s).isNotNull(), F.create_map(*[x for c in names for x in (F.lit(c), F.col(s).getField(c).cast("string"))]))
    op = F.when(F.col("o").isNull(), "I").when(F.col("n").isNull(), "D").otherwise("U")
    cols = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(after.schema[c].dataType.simpleString()).alias("type")) for c in names])
    return both.select("k", op.alias("op"), F.lit("public").alias("schema"), F.lit(table).alias("table"), cols.alias("cols"), as_map("n").alias("new"), as_map("o").alias("old"))


class ChangeMappings:
    """Mappings of one change stream, their ledger and dead letters, under `root`."""

    def __init__(self, catalog: Catalog, root: str):
        self.catalog, self.spark, self.root = catalog, catalog.spark, root.rstrip("/")

    def _ops(self, kind: str) -> list[dict]:
        return [json.loads(line) for n in file_names(self.spark, f"{self.root}/{kind}") if n.endswith(".json") for line in read_file(self.spark, f"{self.root}/{kind}/{n}").splitlines()]

    def _put(self, kind: str, rows: list[dict], name: str | None = None) -> bool:
        while True:
            n = name or f"{len([x for x in file_names(self.spark, f'{self.root}/{kind}') if x.endswith('.json')]):012d}"
            if create_file(self.spark, f"{self.root}/{kind}/{n}.json", "\n".join(map(json.dumps, rows))):
                return True
            if name:
                return False

    def mappings(self) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for n, op in enumerate(self._ops("mappings")):
            if op["op"] == "add":
                out[op["name"]] = op | {"version": n}
            else:
                out.pop(op["name"], None)
        return out

    def add_mapping(self, name: str, source: str, topic: str, columns: str, value: str, key: str | None = None, filter: str | None = None, on_error: str = "stall") -> None:
        """Adds or redefines a mapping. It is planned over no rows first, so a wrong expression is refused here; no key means null, no filter means every change.

        Redefining a mapping forgets its place in the ledger.
        """
        if not valid_source(source):
            raise ValueError(f"bad table name {source!r}")
        if on_error not in ("stall", "skip"):
            raise ValueError("on_error is stall or skip")
        self.catalog._topic(topic)
        mapping = {"op": "add", "name": name, "source": source, "topic": topic, "columns": columns, "value": value, "key": key or "CAST(NULL AS STRING)", "filter": filter or "true", "on_error": on_error}
        render(self.spark.createDataFrame([], CHANGE_SCHEMA), mapping).schema  # analysed here
        self._put("mappings", [mapping])

    def remove_mapping(self, name: str) -> None:
        if name in self.mappings():
            self._put("mappings", [{"op": "remove", "name": name}])

    def preview(self, name: str, table: DataFrame, predicate: str = "true") -> DataFrame:
        """key, value that the mapping would send for the table's current rows that fit the predicate (over new), as inserts."""
        mapping = self.mappings()[name]
        rows = change_rows(table, mapping["source"].split(".")[-1], "I")
        rows = rows.withColumns({"schema": F.lit(mapping["source"].split(".")[0]), "old": F.col("new")})
        return render(rows, mapping | {"filter": f"({mapping['filter']}) AND ({predicate})"}).where("error is null").select("key", "value")

    def snapshot(self, name: str, table: DataFrame, key_columns: list[str]) -> DataFrame:
        """Sends every row of the table once (op R), in the order of its key; a table without a key is refused. Repeating it after a failure sends nothing twice."""
        mapping = self.mappings()[name]
        rows = change_rows(table, mapping["source"].split(".")[-1], "R", key_columns)
        rows = _in_scope(rows, mapping["columns"]).where(F.col("broken").isNull() & F.coalesce(F.expr(mapping["filter"]), F.lit(False)))
        sent = rows.select(F.expr(mapping["key"]).cast("string").alias("key"), F.expr(mapping["value"]).cast("string").alias("value"), *[F.col("new").getField(c).alias(f"_k{i}") for i, c in enumerate(key_columns)])
        return self.catalog.produce(mapping["topic"], sent, [f"_k{i}" for i in range(len(key_columns))], produce_id=f"snapshot-{name}-{mapping['version']}")

    # the drain

    def ledger(self) -> dict[str, tuple[int, int]]:
        """Place (end_lsn, seq) up to which each mapping has delivered."""
        out: dict[str, tuple[int, int]] = {}
        versions = {n: m["version"] for n, m in self.mappings().items()}
        for op in self._ops("ledger"):
            if versions.get(op["name"]) == op["version"]:
                out[op["name"]] = max(out.get(op["name"], (-1, -1)), (op["end_lsn"], op["seq"]))
        return out

    def holds(self) -> dict[str, int]:
        """The commit (end_lsn) that stops each stalled mapping."""
        versions, places = {n: m["version"] for n, m in self.mappings().items()}, self.ledger()
        rows = [op for op in self._ops("holds") if versions.get(op["name"]) == op["version"] and op["hold"] > places.get(op["name"], (-1, -1))[0]]
        return {op["name"]: op["hold"] for op in rows}

    def _deliver(self, changes: DataFrame, batch_id: int) -> None:
        places, held = self.ledger(), self.holds()
        for name, mapping in self.mappings().items():
            at = places.get(name, (-1, -1))
            if batch_id >= 0 and name in held:
                continue  # stalled: what comes later waits for redeliver
            # rendered rows are stored, not kept in memory: changes are many times larger there than in their files
            folder = new_folder(self.spark, "rendered")
            due = render(changes, mapping).where(F.struct("end_lsn", "seq") > F.struct(F.lit(at[0]).cast("long").alias("end_lsn"), F.lit(at[1]).cast("long").alias("seq")))
            due.select("end_lsn", "seq", "key", "value", "error").write.parquet(folder)
            rows = self.spark.read.schema("end_lsn long, seq long, key string, value string, error string").parquet(folder)
            hold = _NONE
            if mapping["on_error"] == "stall":
                hold = rows.where("error is not null").agg(F.coalesce(F.min("end_lsn"), F.lit(_NONE))).first()[0]
            good = rows.where(F.col("error").isNull() & (F.col("end_lsn") < hold))
            last = rows.where(F.col("end_lsn") < hold).agg(F.max(F.struct("end_lsn", "seq")).alias("m")).first()["m"]
            if last is not None:
                tag = f"{name}-{mapping['version']}-{last['end_lsn']}-{last['seq']}"
                self.catalog.produce(mapping["topic"], good.select("key", "value", "end_lsn", "seq"), ["end_lsn", "seq"], produce_id=tag)
                if mapping["on_error"] == "skip":
                    bad = rows.where("error is not null").select(F.lit(name).alias("mapping"), "end_lsn", "seq", "error")
                    bad.write.mode("overwrite").parquet(f"{self.root}/dead/batch={tag}")
                self._put("ledger", [{"name": name, "version": mapping["version"], "end_lsn": last["end_lsn"], "seq": last["seq"]}], name=tag)
            delete(self.spark, folder)
            if hold != _NONE:
                self._put("holds", [{"name": name, "version": mapping["version"], "hold": hold}], name=f"{name}-{mapping['version']}-{hold}")

    def drain(self, folder: str, checkpoint: str | None = None) -> None:
        """Delivers all changes in the Parquet files of `folder` that are new since the last drain, each file as a whole commit range in order.

        A mapping that stalls keeps its place just before the commit it cannot render; changes behind it
        stay undelivered until `redeliver` runs after the mapping is mended. A batch that runs again after a failure
        finds its produces and ledger entries by name and delivers nothing twice.
        """
        stream = self.spark.readStream.schema(CHANGE_SCHEMA).parquet(folder)
        query = stream.writeStream.option("checkpointLocation", checkpoint or f"{self.root}/stream").trigger(availableNow=True).foreachBatch(self._deliver).start()
        query.awaitTermination()

    def redeliver(self, folder: str) -> None:
        """One pass over everything in `folder` from the ledger's places on."""
        self._deliver(self.spark.read.schema(CHANGE_SCHEMA).parquet(folder), -1)

    def dead_letters(self) -> DataFrame:
        schema = "mapping string, end_lsn long, seq long, error string"
        if not file_names(self.spark, f"{self.root}/dead"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/dead").select("mapping", "end_lsn", "seq", "error")

    def status(self, changes: DataFrame) -> DataFrame:
        """mapping, end_lsn, seq, pending, dead: the place of every mapping, and its changes behind that."""
        places, out = self.ledger(), []
        for name, mapping in self.mappings().items():
            at = places.get(name, (-1, -1))
            behind = render(changes, mapping).where(F.struct("end_lsn", "seq") > F.struct(F.lit(at[0]).cast("long").alias("end_lsn"), F.lit(at[1]).cast("long").alias("seq")))
            out.append(behind.agg(F.count("*").alias("pending")).select(F.lit(name).alias("mapping"), F.lit(at[0]).cast("long").alias("end_lsn"), F.lit(at[1]).cast("long").alias("seq"), "pending"))
        dead = self.dead_letters().groupBy("mapping").agg(F.count("*").alias("dead"))
        rows = reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "mapping string, end_lsn long, seq long, pending long")
        return rows.join(dead, "mapping", "left").withColumn("dead", F.coalesce("dead", F.lit(0).cast("long")))

    def slot_target(self, changes: DataFrame) -> int:
        """How far the source may forget: the least place of a mapping that has changes pending, else the end of what was seen."""
        status = self.status(changes)
        held = status.where("pending > 0").agg(F.min("end_lsn").alias("least")).first()["least"]
        end = changes.agg(F.max("end_lsn").alias("m")).first()["m"]
        return end if held is None else held


def commit_summaries(changes: DataFrame, upto: int | None = None) -> DataFrame:
    """xid, end_lsn, event_count, data_collections (changes by table) of each commit that ended by `upto`: what the transaction source sends after a commit's changes."""
    rows = changes if upto is None else changes.where(F.col("end_lsn") <= upto)
    by = rows.groupBy("xid", "end_lsn", F.concat("schema", F.lit("."), "table").alias("t")).agg(F.count("*").alias("n"))
    return by.groupBy("xid", "end_lsn").agg(F.sum("n").alias("event_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("data_collections"))


def deliverable(changes: DataFrame, hold: int) -> DataFrame:
    """The whole commits that ended at or before `hold`."""
    return changes.where(F.col("end_lsn") <= hold)


def numbered(changes: DataFrame, order: list[str]) -> DataFrame:
    """seq of each change within its commit, from 0, in the given order."""
    return changes.withColumn("seq", F.row_number().over(Window.partitionBy("end_lsn").orderBy(*order)).cast("long") - 1)


__all__ = ["ChangeMappings", "change_rows", "commit_summaries", "deliverable", "numbered", "render", "snapshot_changes", "valid_source"]
