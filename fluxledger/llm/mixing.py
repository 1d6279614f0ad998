"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (operator 5).

Words of a source are laid end to end in (id, size, text hash) order and cut into blocks of `block_words`.
A source's target is turned into an exact number of block draws, at most `max_repeats` per block:
whole epochs plus the first part of one more permuted epoch, so its words come within a block of
the target. A binary tree over the output shards splits the vector of draws: each node gives its
left half as many draws as its shards need, divided among sources by a multivariate
hypergeometric draw, and the rest goes right. Every node is seeded by its path, so each shard
finds its quotas alone by walking down from the root and reruns agree; nothing is gathered.
Shards then own disjoint ranges of each source's permuted draws. `write_shards` lands them, each one
shuffled locally; their number follows the square root of the draws, so shards and their size both
grow with the input.

A source's permutation is a four-round Feistel network with cycle walking, computed from block
numbers; no sort of blocks takes place, and a hot source is spread over all tasks. One row a source
reaches the driver.

Defined results: null text counts 0 words and is never drawn; null source is a source of its own,
last in order; repeated rows are separate documents; rows equal in source, id, size and text share
their places in any order; columns of other names are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, drop_written, load, written

BLOCK_WORDS = 64
MAX_REPEATS = 3
SEED = 20240229
#: Populations from here on are beyond numpy's sampler.
NUMPY_DRAW = 900_000_000


def water_fill(sizes: list[int], weights: list[int], cap: int = MAX_REPEATS) -> list[float]:
    """Targets by weight that share the sum of all sizes, none above cap times its size; excess is reshared by weight."""
    total, capped = sum(sizes), set()
    while True:
        room = total - sum(cap * sizes[i] for i in capped)
        w = sum(x for i, x in enumerate(weights) if i not in capped)
        over = {i for i, x in enumerate(weights) if i not in capped and room * x > cap * sizes[i] * w}
        if not over:
            return [float(cap * sizes[i]) if i in capped else room * x / w for i, x in enumerate(weights)]
        capped |= over


def _permuted(block: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Place of each block in its source's permutation of n blocks."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = block.astype(np.uint64), np.ones(len(block), bool)
    while todo.any():
        h, m, s = half[todo], mask[todo], seed[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = (right + s + np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def _rng(seed: int, lo: int, hi: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{lo}:{hi}".encode()).digest()[:8], "big"))


def _log_factorial(k: int) -> np.longdouble:
    """By Stirling's series, in extended precision; counts from 0."""
    if k < 16:
        return np.log(np.longdouble(math.factorial(k)))
    x = np.longdouble(k)
    return (x + 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi * np.longdouble(1)) + 1 / (12 * x) - 1 / (360 * x**3)


def large_hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """A hypergeometric draw at any size by ratio-of-uniforms rejection (Stadlober 1990)."""
    total, few, many = good + bad, min(good, bad), max(good, bad)
    m = min(take, total - take)
    p = few / total
    middle, spread = m * p + 0.5, math.sqrt((total - m) * (take / (total - 1)) * p * (1 - p) + 0.5)
    # fixed values: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e)
    width = 1.7155277699214135 * spread + 0.8989161620588988
    mode = (m + 1) * (few + 1) // (total + 2)
    weigh = lambda z: _log_factorial(z) + _log_factorial(few - z) + _log_factorial(m - z) + _log_factorial(many - m + z)
    top, end = weigh(mode), min(min(m, few) + 1, math.floor(middle + 16 * spread))
    while True:
        x, y = 1 - rng.random(), rng.random()
        w = middle + width * (y - 0.5) / x
        if not 0 <= w < end or m - many > w:
            continue
        z = math.floor(w)
        if 2 * math.log(x) <= top - weigh(z):
            break
    z = m - z if good > bad else z
    return good - z if m < take else z


def split_draws(colors: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw of `take` from the counts in `colors`."""
    out, rest, left = np.zeros_like(colors), int(colors.sum()), int(take)
    for i, c in enumerate(map(int, colors)):
        rest -= c
        if left and c:
            if rest == 0:
                got = left
            elif c + rest < NUMPY_DRAW:
                got = int(rng.hypergeometric(c, rest, left))
            else:
                got = large_hypergeometric(c, rest, left, rng)
            out[i], left = got, left - got
    return out


def shard_quotas(draws: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first draw, draws) of every source for one shard: the walk from the root to its leaf."""
    here, start, lo, hi = draws.astype(np.int64), np.zeros(len(draws), np.int64), 0, shards
    while hi - lo > 1:
        mid, total = (lo + hi) // 2, int(here.sum())
        left = split_draws(here, total * (mid - lo) // (hi - lo), _rng(seed, lo, hi))
        if shard < mid:
            here, hi = left, mid
        else:
            start, here, lo = start + left, here - left, mid
    return start, here


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents with size and first word number within their source, sources with size and order)."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("th"))
    sizes = written(sizes, "mix-counted")
    # a range per task cuts a hot source into many; places follow from sums per range
    ranged = written(sizes.repartitionByRange("source", "id", "size", "th").withColumn("range", F.spark_partition_id()), "mix-sizes")
    drop_written(sizes)
    part = ranged.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0))).drop("in_range")
    within = Window.partitionBy("source", "range").orderBy("id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    on = local["source"].eqNullSafe(part["source"]) & (local["range"] == part["range"])
    placed = local.join(part, on).select("id", local["source"], "size", "th", (F.col("before") + F.col("local")).alias("first_word"))
    return placed, ranged.groupBy("source").agg(F.sum("size").alias("source_size"))


def plan_sources(sources: DataFrame, weights=lambda i: (i - 1) % 3 + 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, source_no, source_size, target, blocks, draws: one row a source, made on the driver."""
    rows = sources.orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [r["source_size"] for r in rows]
    targets = water_fill(sizes, [weights(i + 1) for i in range(len(rows))]) if sum(sizes) else [0.0] * len(rows)
    blocks = [-(-s // block_words) for s in sizes]
    draws = [min(MAX_REPEATS * b, round(t * b / s)) if s else 0 for t, b, s in zip(targets, blocks, sizes)]
    out = [(r["source"], i, s, float(t), b, d) for i, (r, s, t, b, d) in enumerate(zip(rows, sizes, targets, blocks, draws))]
    return sources.sparkSession.createDataFrame(out, "source string, source_no int, source_size long, target double, blocks long, draws long")


def mix(placed: DataFrame, plan: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mixture as pieces: shard, shuffle_key, id, source_no, first_word, piece_start (word of the document), piece_words, epoch."""
    spark = placed.sparkSession
    rows = plan.orderBy("source_no").collect()
    draws = np.array([r["draws"] for r in rows], np.int64)
    shards = shards or max(1, math.isqrt(int(draws.sum())) // 4)
    span = np.maximum(1, -(-draws // shards))  # draws per bucket of the range join

    def quotas(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                start, count = shard_quotas(draws, int(shard), shards, seed)
                used = np.flatnonzero(count)
                lo, hi = start[used], start[used] + count[used]
                first, last = lo // span[used], (hi - 1) // span[used]
                row = np.repeat(np.arange(len(used)), last - first + 1)
                bucket = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
                yield pd.DataFrame({"shard": np.int64(shard), "source_no": used[row].astype(np.int32), "q_from": lo[row], "q_to": hi[row], "bucket": bucket})

    owned = spark.range(0, shards, 1, min(shards, 200)).mapInPandas(quotas, "shard long, source_no int, q_from long, q_to long, bucket long")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.reset_index(drop=True)
            first, size, b = (part[c].to_numpy(np.int64) for c in ("first_word", "size", "blocks"))
            lo, hi = first // block_words, (first + size - 1) // block_words
            for a in range(0, len(part), 4096):
                n = (hi - lo + 1)[a : a + 4096]
                row = np.repeat(np.arange(a, a + len(n)), n)
                block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
                begin = np.maximum(first[row], block * block_words)
                words = np.minimum(first[row] + size[row], (block + 1) * block_words) - begin
                no, total = part["source_no"].to_numpy()[row], part["draws"].to_numpy(np.int64)[row]
                for epoch in range(MAX_REPEATS):
                    salt = (no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * MAX_REPEATS + epoch)) * np.uint64(0xD1342543DE82EF95)
                    room = total - epoch * b[row]
                    if not (room > 0).any():
                        break
                    draw = epoch * b[row] + _permuted(block, b[row], salt)
                    ok = draw < total
                    r = row[ok]
                    yield pd.DataFrame({"id": part["id"].iloc[r].array, "source_no": no[ok], "first_word": first[r], "piece_start": (begin - first[row])[ok], "piece_words": words[ok], "epoch": np.int32(epoch), "draw": draw[ok], "bucket": draw[ok] // span[no[ok]]})

    known = placed.where("size > 0").join(F.broadcast(plan) if len(rows) <= 10_000 else plan, placed["source"].eqNullSafe(plan["source"])).select("id", "source_no", "size", "first_word", "blocks", "draws")
    id_type = placed.schema["id"].dataType.simpleString()
    pieces = known.mapInPandas(cut, f"id {id_type}, source_no int, first_word long, piece_start long, piece_words long, epoch int, draw long, bucket long")
    on = ["source_no", "bucket"]
    dealt = pieces.join(owned, on).where((F.col("draw") >= F.col("q_from")) & (F.col("draw") < F.col("q_to")))
    return dealt.select("shard", F.xxhash64(F.lit(seed), "source_no", "draw").alias("shuffle_key"), "id", "source_no", "first_word", "piece_start", "piece_words", "epoch")


def write_shards(pieces: DataFrame) -> DataFrame:
    """Lands the pieces of mix(), every shard whole in one file and in its own random order (`place`), and reads them back."""
    shuffled = pieces.repartition("shard").sortWithinPartitions("shard", "shuffle_key", "source_no", "first_word", "piece_start")
    return written(shuffled.withColumn("place", F.monotonically_increasing_id()).drop("shuffle_key"), "mix-shards")


def mixed_sizes(docs: DataFrame, **names: str) -> DataFrame:
    """id, source, size, source_size, target, taken and th (a hash of the text) for every document; taken is counted in the shards written."""
    placed, sources = measured(docs, **names)
    plan = plan_sources(sources)
    taken = write_shards(mix(placed, plan)).groupBy("id", "source_no", "first_word").agg(F.sum("piece_words").alias("taken"))
    p, small = plan.select("source", "source_no", "source_size", "target"), plan.count() <= 10_000
    rows = placed.join(F.broadcast(p) if small else p, placed["source"].eqNullSafe(p["source"])).select("id", placed["source"], "source_no", "size", "th", "first_word", "source_size", "target")
    t = taken.withColumnRenamed("id", "t_id").withColumnRenamed("source_no", "t_no").withColumnRenamed("first_word", "t_first")
    on = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("source_no") == F.col("t_no")) & (F.col("first_word") == F.col("t_first")) & (F.col("size") > 0)
    return rows.join(t, on, "left").select("id", "source", "size", "th", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("source", "th")
