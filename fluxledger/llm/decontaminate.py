"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 7, DataFrame functions only).

Words are runs of letters and digits of the lower-cased text, shingles are `k` consecutive words,
and a window is as many shingles long as a benchmark item (the whole document if that is shorter).
A document holds an item if any window of it reaches `threshold`. The steps:

1. Documents are shingled inside one code-generated stage and probed against the benchmark's
   shingles. Two exact bounds say which of all item-sized windows can be the best one. A window of w
   shingles that reaches the threshold with an item of m holds at least t * (m + w) / (1 + t) places
   whose shingle is in an item of that size; and moving a window's start past a place that is not in
   the item loses nothing, so the best windows start at such a place, or end where the document ends. All
   other windows are skipped, none that could match.
2. Every window laid and every item gets a 64-bit SimHash over its shingles (weight: occurrences).
3. Multi-index Hamming: fingerprints are cut into `radius` + 1 blocks, so two within the radius
   agree in at least one whole block. The join is on (window length, block, bits) and a pair is
   kept only at its first common block, then checked against the radius.
4. Surviving pairs are verified by exact weighted Jaccard similarity, sum of minima over sum of
   maxima of shingle counts.

At similarity 0.8 windows of equal size differ in about 10 of 64 bits (standard deviation 3). The default radius of 24
lies five standard deviations above, which makes blocks short (2 or 3 bits): a fingerprint of 64 bits cannot be
selective at 0.8, so blocks and radius find the items of a window among those of its length, and step 1 is what
keeps windows few.

The benchmark is broadcast only while its shingles take at most `broadcast_bytes`; beyond that the join
shuffles narrow rows (document, place, shingle), linear in the text. Defined results: null or short texts (under
`k` words) match nothing, and so do items under `k` words; rows that repeat an id are judged apart and reported under
the id once per item, with their best window; among equally good windows the first is reported; a null id is an id
like any other; long texts are judged whole; other columns, whatever their names, are not read; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOOM, load, spark_conf, written

K = 5
THRESHOLD = 0.8
RADIUS = 24


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle(ws: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(ws, at + i) for i in range(k)])


def _shingles(ws: Column, k: int) -> Column:
    """array<long> of the k-word shingle hashes of an array of at least k words."""
    return F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: _shingle(ws, i, k))


def simhash(hashes: Column, most: int) -> Column:
    """64-bit SimHash of an array of at most `most` hashes; occurrences weigh by standing in the array more than once. A tie gives a 0 bit.

    All 64 counters run side by side: the longs p0, p1, ... hold their bits of weight 1, 2, ..., and a hash is added with carry.
    """
    planes = range(max(1, most.bit_length()))

    def add(acc: Column, h: Column) -> Column:
        out, carry = [], h
        for k in planes:
            p = acc[f"p{k}"]
            out.append(p.bitwiseXOR(carry).alias(f"p{k}"))
            carry = p.bitwiseAND(carry)
        return F.struct(*out)

    def above_half(acc: Column) -> Column:
        """Bits whose counter is over half the array, compared from the highest plane down."""
        above, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for k in reversed(planes):
            half = F.when(F.getbit((F.size(hashes) / 2).cast("long"), F.lit(k)) == 1, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
            above = above.bitwiseOR(equal.bitwiseAND(acc[f"p{k}"]).bitwiseAND(F.bitwise_not(half)))
            equal = equal.bitwiseAND(F.bitwise_not(acc[f"p{k}"].bitwiseXOR(half)))
        return above

    counters = F.aggregate(hashes, F.struct(*[F.lit(0).cast("long").alias(f"p{k}") for k in planes]), add)
    return F.get(F.transform(F.array(counters), above_half), 0)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks that cover 64 bits."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be from 0 to 63")
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block_keys(fp: Column, radius: int) -> Column:
    return F.array(*[F.struct(F.lit(j).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND((1 << n) - 1 if n < 64 else -1).alias("bits")) for j, (a, n) in enumerate(blocks(radius))])


def _first_common(xor: Column, radius: int) -> Column:
    return F.coalesce(*[F.when(F.shiftrightunsigned(xor, a).bitwiseAND((1 << n) - 1 if n < 64 else -1) == 0, F.lit(j)) for j, (a, n) in enumerate(blocks(radius))])


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of hashes as multisets."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def _starts(places: Column, need: Column, width: Column, n: Column) -> Column:
    """Of windows of `width` shingles that start at one of the (ascending) places or end with the document's last of n shingles, the starts of those with `need` places."""
    last = F.size(places) - need
    at = F.transform(F.sequence(F.lit(0), last), lambda i: F.when((F.get(places, i) + width <= n) & (F.get(places, i + need - 1) < F.get(places, i) + width), F.get(places, i)))
    end = F.when(F.get(places, last) >= n - width, n - width)
    return F.when(last >= 0, F.array_distinct(F.array_compact(F.concat(at, F.array(end)))))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row per document and item it holds: id, item, similarity and start (shingle number) of the best window, its Hamming distance."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") >= k)
    most, n_shingles = items.agg(F.coalesce(F.max(F.size("w") - k + 1), F.lit(0)), F.coalesce(F.sum(F.size("w") - k + 1), F.lit(0))).first()
    items = written(items.select("item", _shingles(F.col("w"), k).alias("ih")).withColumn("size", F.size("ih")).withColumn("ifp", simhash(F.col("ih"), most)), "bench-items")
    # a seed holds a shingle and a size, 16 bytes and what a hashed row costs besides
    small = n_shingles * 40 <= broadcast_bytes
    seeds = items.select("size", F.explode("ih").alias("h")).distinct()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    rows = texts.select("id", "th", words(F.col("text")).alias("w")).where(F.size("w") >= k)
    spots = rows.select("id", "th", (F.size("w") - k + 1).alias("n"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("pos"))
    spots = spots.select("id", "th", "n", "pos", _shingle(F.col("w"), F.col("pos"), k).alias("h"))
    found = spots.join(F.broadcast(seeds) if small else seeds, "h").groupBy("id", "th", "n", "size").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    width = F.least("size", "n")
    need = F.ceil(F.lit(threshold) * (F.col("size") + width) / (1 + threshold) - 1e-9).cast("int")
    found = found.select("id", "th", "size", width.alias("width"), _starts(F.col("places"), need, width, F.col("n")).alias("starts"))
    found = written(found.where(F.size("starts") > 0), "bench-starts")

    # a text is shuffled and sorted once, as text, and hashed once; the id is compared besides the join key, so that grouping by the key needs no second shuffle
    known = found.where(F.size("starts") > 0).select(F.xxhash64("id", "th").alias("f_key"), F.col("id").alias("f_id"), "size", "width", "starts")
    same = (F.col("key") == F.col("f_key")) & ((F.col("id") <= F.col("f_id")) & (F.col("id") >= F.col("f_id")) | (F.col("id").isNull() & F.col("f_id").isNull()))
    near = texts.select(F.xxhash64("id", "th").alias("key"), "id", "text").join(known, same, "left_semi").dropDuplicates(["key", "id"])
    near = near.select("key", "id", words(F.col("text")).alias("w")).select("key", "id", _shingles(F.col("w"), k).alias("h")).join(known, same)
    laid = near.select("id", "size", "width", "h", F.explode("starts").alias("start"))
    windows = laid.select("id", "size", "start", F.slice("h", F.col("start") + 1, F.col("width")).alias("wh"))
    with spark_conf(docs.sparkSession, BLOOM):
        windows = written(windows.withColumn("wfp", simhash(F.col("wh"), most)), "bench-windows")

    left = windows.select("*", F.explode(_block_keys(F.col("wfp"), radius)).alias("key")).select("*", "key.block", "key.bits")
    right = items.select("*", F.explode(_block_keys(F.col("ifp"), radius)).alias("key")).select("item", "ih", "ifp", "size", "key.block", "key.bits")
    fits = n_shingles * 8 * (radius + 1) <= broadcast_bytes
    xor = F.col("wfp").bitwiseXOR(F.col("ifp"))
    pairs = left.join(F.broadcast(right) if fits else right, ["size", "block", "bits"]).where((_first_common(xor, radius) == F.col("block")) & (F.bit_count(xor) <= radius))
    scored = pairs.select("id", "item", "start", F.bit_count(xor).alias("hamming"), weighted_jaccard(F.col("wh"), F.col("ih")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("id", "item").agg(F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start"), F.min("hamming").alias("hamming"))
    return best


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"))


#: Brute force over all item-sized windows of every document that shares a shingle with the item, without bounds or fingerprints.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, len(w) - 4 AS n, unnest(range(1, len(w) - 3)) AS p, array_to_string(w[p:p+4], ' ') AS s FROM dw WHERE len(w) >= 5
), i AS (
  SELECT item_id, len(w) - 4 AS size, unnest(range(1, len(w) - 3)) AS p, array_to_string(w[p:p+4], ' ') AS s FROM iw WHERE len(w) >= 5
), ic AS (
  SELECT item_id, size, s, count(*) AS c FROM i GROUP BY ALL
), hit AS (
  SELECT ds.doc_id, ic.item_id, ds.n, ic.size, ds.p, ds.s, ic.c FROM ds JOIN ic USING (s)
), pair AS (
  SELECT DISTINCT doc_id, item_id, n, size FROM hit
), win AS (
  SELECT doc_id, item_id, size, least(size, n) AS width, unnest(range(1, greatest(1, n - size + 1) + 1)) AS start FROM pair
), wc AS (
  SELECT win.doc_id, win.item_id, win.start, win.size, win.width, hit.s, least(count(*), any_value(hit.c)) AS c
  FROM win JOIN hit ON hit.doc_id = win.doc_id AND hit.item_id = win.item_id AND hit.p >= win.start AND hit.p < win.start + win.width GROUP BY ALL
), common AS (
  SELECT doc_id, item_id, size, width, sum(c) AS k FROM wc GROUP BY doc_id, item_id, start, size, width
)
SELECT doc_id, item_id, round(max(CAST(k AS DOUBLE) / CAST(width + size - k AS DOUBLE)), 6) AS similarity
FROM common WHERE CAST(k AS DOUBLE) / CAST(width + size - k AS DOUBLE) >= 0.8 GROUP BY doc_id, item_id
"""
