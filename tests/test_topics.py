"""Topics, produces, settings and mappings where SQL has nothing to say: refusals, restarts, races, pruning."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fluxledger.operators import configs as cfg
from fluxledger.operators import isolation as iso
from fluxledger.sources import Catalog, ProduceError
from fluxledger.sources.scratch import create_file, file_names, new_folder
from fluxledger.streaming import ChangeMappings, change_rows

ROWS = "key string, value string, n int"


@pytest.fixture
def catalog(spark):
    return Catalog(spark, new_folder(spark, "catalog"))


def test_create_and_drop(catalog):
    catalog.create_topic("a", 2)
    for bad in ("", "..", "a b", "x" * 250, "a\n"):
        with pytest.raises(ValueError):
            catalog.create_topic(bad)
    with pytest.raises(ValueError):
        catalog.create_topic("a")
    with pytest.raises(ValueError):
        catalog.create_topic("b", config={"retention.ms": "-2"})
    catalog.drop_topic("a")
    with pytest.raises(KeyError):
        catalog.read("a")
    catalog.create_topic("a", 1)
    assert catalog.read("a").count() == 0 and catalog.partition_offsets("a").first()["high_watermark"] is None


def test_produce_is_whole_or_nothing(spark, catalog):
    catalog.create_topic("t", 1, {"cleanup.policy": "compact", "max.message.bytes": "1000"})
    good = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], ROWS)
    catalog.produce("t", good, ["n"])
    with pytest.raises(ProduceError, match="INVALID_RECORD"):
        catalog.produce("t", good.union(spark.createDataFrame([(None, "3", 3)], ROWS)), ["n"])
    with pytest.raises(ProduceError, match="MESSAGE_TOO_LARGE"):
        catalog.produce("t", spark.createDataFrame([("c", "x" * 2000, 1)], ROWS), ["n"])
    with pytest.raises(ProduceError, match="UNKNOWN_PARTITION"):
        catalog.produce("t", good.withColumn("partition", F.lit(5)), ["n"])
    assert [(r["record_offset"], r["key"]) for r in catalog.read("t").orderBy("record_offset").collect()] == [(0, "a"), (1, "b")]


def test_repeated_and_racing_produces(spark, catalog, monkeypatch):
    catalog.create_topic("t")
    rows = spark.createDataFrame([("a", "1", 1)], ROWS)
    catalog.produce("t", rows, ["n"], "once")
    assert catalog.produce("t", rows, ["n"], "once").collect()[0]["first_offset"] == 0
    # another produce takes the next marker first
    from fluxledger.sources import catalog as module

    def slow(session, path, text, real=create_file):
        monkeypatch.setattr(module, "create_file", real)
        Catalog(spark, catalog.root).produce("t", rows, ["n"], "fast")
        return real(session, path, text)

    monkeypatch.setattr(module, "create_file", slow)
    assert catalog.produce("t", rows, ["n"], "slow").collect()[0]["first_offset"] == 2
    assert sorted(r["record_offset"] for r in catalog.read("t").collect()) == [0, 1, 2]
    assert catalog.produce("t", rows.limit(0), ["n"]).count() == 0


def test_bounds_prune_produces(spark, catalog):
    catalog.create_topic("t")
    for i in range(4):
        catalog.produce("t", spark.createDataFrame([(str(j), "v", j) for j in range(10)], ROWS), ["n"])
    assert catalog.stored("t", from_offset=20, to_offset=30).select("produce").distinct().count() == 1
    assert [r["record_offset"] for r in catalog.read("t", from_offset=18, to_offset=22).orderBy("record_offset").collect()] == [18, 19, 20, 21]
    assert [r["record_offset"] for r in catalog.read("t", max_records=3).collect()] == [0, 1, 2]


def test_settings(spark):
    rows = [("retention.ms", "-1", None), ("retention.ms", " 5 ", None), ("retention.ms", "x", "BAD_VALUE"), ("retention.ms", None, "BAD_VALUE"), ("retention.ms", "99999999999999999999", "BAD_VALUE"), ("cleanup.policy", "", "BAD_VALUE"), ("cleanup.policy", " compact ,delete", None), ("cleanup.policy", "compact,compact", "BAD_VALUE"), ("min.insync.replicas", " 1 ", None), ("min.insync.replicas", "2", "READ_ONLY"), ("nope", "1", "UNKNOWN_CONFIG"), ("max.message.bytes", "8388609", "BAD_VALUE")]
    got = [(r["name"], r["value"], r["error"]) for r in cfg.judge_settings(spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, name string, value string")).orderBy("i").collect()]
    assert got == rows
    for name, value, error in rows:
        if value is not None:
            if error:
                with pytest.raises(ValueError):
                    cfg.check_config(name, value)
            else:
                cfg.check_config(name, value)


def test_mapping_refusals(spark, catalog):
    catalog.create_topic("t")
    m = ChangeMappings(catalog, f"{catalog.root}/m")
    for source in (".orders", "a.b.c", "or ders", "x" * 129, ""):
        with pytest.raises(ValueError):
            m.add_mapping("x", source, "t", "id int", "new.id")
    with pytest.raises(AnalysisException):
        m.add_mapping("x", "orders", "t", "id int", "new.missing")
    with pytest.raises(KeyError):
        m.add_mapping("x", "orders", "no-topic", "id int", "new.id")
    assert m.mappings() == {}
    m.add_mapping("x", "orders", "t", "id int", "new.id")
    with pytest.raises(ValueError):
        m.snapshot("x", spark.createDataFrame([(1,)], "id int"), [])


def test_drain_goes_on_after_mending(spark, catalog):
    """A stalled mapping keeps its place over drains; redefined, it delivers everything from the start."""
    catalog.create_topic("t")
    m, folder = ChangeMappings(catalog, f"{catalog.root}/m"), f"{catalog.root}/changes"
    m.add_mapping("x", "orders", "t", "id int", "new.id", "new.id")

    def land(values):
        rows = spark.createDataFrame([(v, n) for v, n in values], "id string, n long")
        out = change_rows(rows.select("id"), "orders", "I").withColumns({"end_lsn": F.lit(None).cast("long")})
        lsn = dict(values)
        pairs = F.create_map(*[x for v, n in lsn.items() for x in (F.lit(v), F.lit(n))])
        out.withColumns({"end_lsn": F.try_element_at(pairs, F.col("new")["id"]).cast("long"), "seq": F.lit(0).cast("long")}).write.mode("append").parquet(folder)
        m.drain(folder)

    land([("1", 10), ("2", 20)])
    land([("bad", 30), ("4", 40)])
    land([("5", 50)])
    values = lambda: [r["value"] for r in catalog.read("t").orderBy("record_offset").collect()]
    assert values() == ["1", "2"] and m.holds() == {"x": 30} and m.ledger() == {"x": (20, 0)}
    m.redeliver(folder)
    assert values() == ["1", "2"]
    m.add_mapping("x", "orders", "t", "id string", "new.id", "new.id")
    m.redeliver(folder)
    assert values() == ["1", "2", "1", "2", "bad", "4", "5"] and m.holds() == {}


def test_reading_does_not_shuffle_by_partition(spark, catalog):
    """A topic of one partition would come into one task."""
    catalog.create_topic("t")
    catalog.produce("t", spark.createDataFrame([("a", "1", 1)], ROWS), ["n"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a log whose bounds Spark cannot size
    try:
        plan = catalog.read("t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_drain_holds_no_changes_in_memory(spark, catalog, monkeypatch):
    """Files of changes are many times smaller than their rows, so a task that caches its files' rows reads far more than its share."""
    catalog.create_topic("t")
    m, folder = ChangeMappings(catalog, f"{catalog.root}/m"), f"{catalog.root}/changes"
    m.add_mapping("x", "orders", "t", "id int", "new.id", "new.id", on_error="skip")
    rows = change_rows(spark.range(40).select(F.when(F.col("id") == 7, "bad").otherwise(F.col("id").cast("string")).alias("id")), "orders", "I")
    rows = rows.withColumns({"end_lsn": F.lit(1).cast("long"), "seq": F.monotonically_increasing_id()})
    rows.write.parquet(folder)
    monkeypatch.setattr(type(rows), "persist", lambda *_: pytest.fail("persisted"))
    m.redeliver(folder)
    assert [r["value"] for r in catalog.read("t").orderBy("record_offset").collect()] == [str(i) for i in range(40) if i != 7]
    assert m.dead_letters().count() == 1


def test_produce_sorts_bounded_ranges(spark, catalog, monkeypatch):
    """Repetitive values make many ranges; offsets follow the order over all of them, and a refused produce writes no data."""
    from fluxledger.sources import catalog as module

    monkeypatch.setattr(module, "RANGE_BYTES", 1 << 14)
    seen = []
    monkeypatch.setattr(module, "number_rows", lambda *a, real=module.number_rows, **k: seen.append(k["ranges"]) or real(*a, **k))
    catalog.create_topic("t", 3, {"max.message.bytes": "20000"})
    rows = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.repeat(F.lit("x"), F.lit(1000)).alias("value"), (F.col("id") % 250).alias("n"), "id")
    catalog.produce("t", rows, ["n", "id"])
    got = catalog.read("t").select("partition", "record_offset", "key").collect()
    assert seen[0] >= 1000 * 1061 // (1 << 14) and len(got) == 1000
    for p in range(3):
        keys = [int(r["key"]) for r in sorted((r for r in got if r["partition"] == p), key=lambda r: r["record_offset"])]
        assert keys == sorted(keys, key=lambda k: (k % 250, k)) and sorted(r["record_offset"] for r in got if r["partition"] == p) == list(range(len(keys)))
    before = file_names(spark, f"{catalog.root}/topic=0/data")
    monkeypatch.setattr(module, "delete", lambda *_: None)
    with pytest.raises(ProduceError, match="MESSAGE_TOO_LARGE"):
        catalog.produce("t", rows.withColumn("value", F.repeat("value", F.lit(3))), ["n", "id"])
    assert file_names(spark, f"{catalog.root}/topic=0/data") == before


def test_aborted_spans_by_bins(spark, monkeypatch):
    """Spans over many bins, in one bin and at their borders, against every pair of batch and span; a batch looks at its own bin only."""
    monkeypatch.setattr(iso, "BIN", 16)
    batches = [(1, p, pid, b, b + 7 - b % 3, b % 5 != 0, False) for p in (0, 1) for pid in (1, 2, None) for b in range(0, 400, 8)]
    spans = [(1, p, pid, f, f + n) for p, pid, f, n in ((0, 1, 3, 100), (0, 1, 120, 0), (0, 1, 143, 1), (0, 1, 160, 16), (0, 2, 16, 300), (0, 2, 40, 2), (1, 1, 390, 900), (1, 2, -5, 4), (1, 2, 79, 1))]
    log = spark.createDataFrame(batches, "topic_id int, partition int, producer_id long, base_offset long, last_offset long, is_transactional boolean, is_control boolean")
    aborted = spark.createDataFrame(spans, "topic_id int, partition int, producer_id long, first_offset long, marker_offset long")
    shown = iso.visible(log, aborted)
    left = [b for b in batches if not (b[5] and any(s[1:3] == b[1:3] and s[3] <= b[4] and s[4] >= b[3] for s in spans))]
    assert sorted(map(tuple, shown.collect()), key=repr) == sorted(left, key=repr) and 0 < len(left) < len(batches)
    assert iso._abort_bins(log, aborted).groupBy("partition", "producer_id", "bin").count().agg(F.max("count")).first()[0] <= 4
