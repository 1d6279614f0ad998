"""What an archive holds of a log, and whether restored state fits the log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACE = ["topic_id", "partition"]


def archive_status(sealed: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: archived, archived_bytes, pending, pending_bytes, oldest_pending of sealed pieces (topic_id, partition, first_offset, bytes, at) and the archive's ledger."""
    keys = [*_PLACE, "first_offset"]
    done = ledger.agg(F.count("*").alias("archived"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("archived_bytes"))
    left = sealed.join(ledger.select(*keys), keys, "left_anti")
    left = left.agg(F.count("*").alias("pending"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("pending_bytes"), F.min("at").alias("oldest_pending"))
    return done.crossJoin(F.broadcast(left))  # one row each


def restore_check(ends: DataFrame, markers: DataFrame, epochs: DataFrame, noted: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """topic_id, partition, finding, n: where restored state and log contradict each other.

    ends: log_end as read from the log itself; markers: base_offset of finished produces; epochs: start_offset of
    leader epochs; noted: log_end that was noted before; ledger and files: first_offset of archived pieces as noted and as found.
    """
    at = lambda df, *c: df.select(*_PLACE, *c).join(ends.select(*_PLACE, "log_end"), _PLACE)
    found = lambda df, what: df.groupBy(*_PLACE).agg(F.count("*").alias("n")).select(*_PLACE, F.lit(what).alias("finding"), "n")
    return reduce(DataFrame.unionByName, [
        found(at(markers, "base_offset").where("base_offset >= log_end"), "markers past the log end"),
        found(at(epochs, "start_offset").where("start_offset > log_end"), "epochs past the log end"),
        found(at(noted.withColumnRenamed("log_end", "noted"), "noted").where("log_end < noted"), "log went back"),
        found(noted.join(ends, _PLACE, "left_anti"), "log is gone"),
        found(ledger.join(files, [*_PLACE, "first_offset"], "left_anti"), "archived piece is missing"),
    ])
