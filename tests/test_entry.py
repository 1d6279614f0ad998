"""The driver contract, and queries against their oracle SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fluxledger import fixtures as fx

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return int(v) if type(v).__name__ == "Decimal" and v == int(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["repeats", "customers", "cents", "first_at", "last_at"]


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    same(spark, duck, name)


def test_headers_of_all_partitions(spark):
    log = fx.events_log(spark, SF)
    rows = entry.queries()["log_headers_unnest_all"](spark, SF)
    per_partition = lambda df, n: {r["partition"]: r["n"] for r in df.groupBy("partition").agg(n.alias("n")).collect()}
    got = per_partition(rows, F.count("*"))
    assert got == per_partition(log, F.sum(F.size("header_keys"))) and len(got) == 6
