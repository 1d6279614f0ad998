"""Transaction visibility: stable offsets, the abort index, marker-backed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PLACE = ["topic_id", "partition"]
#: Offsets in which a batch looks for spans.
BIN = 1024


def stable_offsets(parts: DataFrame, open_txns: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Adds stable_offset: the least of the log end, the first offsets of ongoing transactions and of pending produces."""
    first = open_txns.select(*_PLACE, "first_offset")
    if pending is not None:
        first = first.unionByName(pending.select(*_PLACE, F.col("base_offset").alias("first_offset")))
    low = first.groupBy(*_PLACE).agg(F.min("first_offset").alias("first_open"))
    return parts.join(low, _PLACE, "left").withColumn("stable_offset", F.when(F.col("next_offset").isNotNull(), F.least("next_offset", F.coalesce("first_open", "next_offset")))).drop("first_open")


def overlapping_aborts(log: DataFrame, aborted: DataFrame) -> DataFrame:
    """Abort index rows that overlap a transactional batch of their producer: the interval join."""
    b = log.where("is_transactional").select(*_PLACE, "producer_id", "base_offset", "last_offset").distinct().alias("b")
    a = aborted.alias("a")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*_PLACE, "producer_id")]
    return b.join(a, [*on, F.col("a.first_offset") <= F.col("b.last_offset"), F.col("a.marker_offset") >= F.col("b.base_offset")]).select("b.*", "a.first_offset", "a.marker_offset")


def _abort_bins(log: DataFrame, aborted: DataFrame) -> DataFrame:
    """The abort index by bin of offsets: spans under the bin of their first offset, and for every bin with batches the furthest marker of spans from earlier bins.

    A batch overlaps a span when the furthest marker among spans that begin by its end reaches its base, so its own bin is all it has to look at.
    """
    key = [*_PLACE, "producer_id", "bin"]
    spans = aborted.select(*_PLACE, "producer_id", F.expr(f"first_offset div {BIN}").alias("bin"), "first_offset", "marker_offset")
    ends = spans.groupBy(*key).agg(F.max("marker_offset").alias("m"))
    seen = log.where("is_transactional").select(*_PLACE, "producer_id", F.expr(f"last_offset div {BIN}").alias("bin")).distinct()
    earlier = Window.partitionBy(*_PLACE, "producer_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = ends.unionByName(seen.withColumn("m", F.lit(None).cast("long"))).groupBy(*key).agg(F.max("m").alias("m"))
    carried = bins.withColumn("marker_offset", F.max("m").over(earlier)).where(F.col("marker_offset").isNotNull())
    return spans.unionByName(carried.select(*key, (F.col("bin") * BIN - 1).alias("first_offset"), "marker_offset"))


def visible(log: DataFrame, aborted: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Committed records: no control records, none of an aborted span, and of SQL produces (negative epoch) only those with a marker."""
    data = log.where("not is_control")
    a = _abort_bins(data, aborted).select(*[F.col(c).alias(f"a_{c}") for c in (*_PLACE, "producer_id", "bin", "first_offset", "marker_offset")])
    hidden = (
        (F.col("topic_id") == F.col("a_topic_id")) & (F.col("partition") == F.col("a_partition")) & (F.col("producer_id") == F.col("a_producer_id")) & (F.expr(f"last_offset div {BIN}") == F.col("a_bin"))
        & F.col("is_transactional") & (F.col("a_first_offset") <= F.col("last_offset")) & (F.col("a_marker_offset") >= F.col("base_offset"))
    )
    rows = data.join(a, hidden, "left_anti")
    return marker_backed(rows, markers) if markers is not None else rows


def marker_backed(log: DataFrame, markers: DataFrame) -> DataFrame:
    """Drops batches of SQL produces that no marker confirms."""
    m = markers.select(*_PLACE, "base_offset", F.lit(True).alias("confirmed")).distinct()
    rows = log.join(m, [*_PLACE, "base_offset"], "left")
    needs = F.col("is_transactional") & (F.coalesce("producer_epoch", F.lit(0)) < 0)
    return rows.where(~needs | F.coalesce("confirmed", F.lit(False))).drop("confirmed")
