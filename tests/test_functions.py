"""Scalar functions against fixed vectors."""

import pytest
from pyspark.sql import functions as F

from fluxledger.functions import anchored, group_slot, lsn_format, lsn_parse, murmur2, pack_producer_id, partition_for, seq_add, seq_follows, unpack_producer_id, valid_topic_name


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


# fixed values: public test vectors of the hash
@pytest.mark.parametrize(("key", "want"), [
    ("21", -973932308), ("foobar", -790332482), ("a-little-bit-long-string", -985981536), ("a-little-bit-longer-string", -1486304829),
    ("lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8", -58897971), ("abc", 479470107), ("", 275646681),
])
def test_murmur2(spark, key, want):
    assert one(spark, murmur2(F.lit(key)), partition_for(F.lit(key), 6)) == (want, (want & 0x7FFFFFFF) % 6)


def test_null_key(spark):
    assert one(spark, partition_for(F.lit(None).cast("string"), 6)) == (0,)


def test_sequences(spark):
    top = F.lit(2147483647)
    assert one(spark, seq_add(top, 1), seq_add(F.lit(-1), 5), seq_follows(top, F.lit(0)), seq_follows(F.lit(3), F.lit(5))) == (0, None, True, False)


def test_positions(spark):
    assert one(spark, lsn_format(lsn_parse(F.lit("16/B374D848")))) == ("16/B374D848",)


def test_producer_ids(spark):
    parts = unpack_producer_id(pack_producer_id(F.lit(3), F.lit(7), F.lit(123456789)))
    assert tuple(one(spark, parts)[0]) == (3, 7, 123456789)
    assert one(spark, unpack_producer_id(F.lit(5).cast("long"))) == (None,)


def test_names(spark):
    got = spark.createDataFrame([("a.b-c_1",), ("..",), ("",), ("a b",), (None,)], "n string").select(valid_topic_name(F.col("n"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]
    assert anchored("(?i)abc") == "(?i)^(?:abc)$"
    assert one(spark, group_slot(F.lit("polygenelubricants"))) == (0,)
