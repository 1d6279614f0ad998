"""Repeated substrings by longest previous factors over anchored suffixes (operator 4).

A byte goes if a `min_len`-byte string that covers it also starts elsewhere (keep="none") or
starts earlier (keep="first", in the order of id and position; the first copy stays).

A suffix array over all bytes of 100 TB cannot be held, and only previous factors of at least
`min_len` matter, so suffixes are compared on their first `min_len` bytes, and only those that can
have a match are compared at all:

1. Every window of `min_len` bytes has an anchor: its leftmost smallest `gram`-byte hash. Equal
   windows have equal anchors at equal offsets, so one row per anchor (about 0.7 % of positions)
   stands for a run of neighbouring suffixes. Where a text repeats with a short period, equal runs lie
   side by side and are one row with their number. Anchors that occur once have no match and go.
2. Runs whose whole context occurs again are matched as they are (counted with map-side
   combination, so a group of copies is never gathered).
3. Runs that share an anchor but differ in context (the edges of shared passages) are opened into
   their single suffixes, one run per distinct context, inside a task per anchor. There the suffixes are
   sorted by their bytes (prefix doubling), and in that order the previous and the next smaller place of
   each suffix give its longest previous factor, on places counted backwards its longest next factor.
   A suffix goes if that length reaches `min_len`. Anchors with more than `task_contexts` contexts are opened
   into rows instead and grouped by anchor and prefix, where of equal prefixes all but the first have a previous factor.

Factors are compared on bytes in 3; whole contexts (2) and prefixes of crowded anchors by two 64-bit
hashes together, that of the anchor and that of the bytes, so a wrong match among n runs has odds of about
n ** 2 / 2 ** 129 (3e-14 at 10 ** 12 runs). Texts are hashed in pieces of 1 MB and
only affected texts move; a bitmap of fixed size (1 MB) filters these before the exact join.
Defined results: null is the empty text; texts under `min_len` bytes are kept whole; rows that
repeat an id are separate documents (equal ones are copies of each other); other columns, whatever their names,
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bounded_batches, drop_written, has_bit, load, written
from .shingles import _BYTES, _Tables, mixed

MIN_LEN = 400
GRAM = 100
PIECE = 1 << 20
BITMAP = 1 << 23
TASK_CONTEXTS = 4096


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that make ranges comparable."""
    power, inverse = _Tables.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def _range_hash(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((sums[b] - sums[a]) * inverse[a])


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, min_len: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, lo, hi, key, context) of all runs of windows with one anchor in texts data[begin:end].

    lo and hi are the first and last window of a run, as places in `data` (at most 2 ** 21 bytes).
    """
    n, w = len(data), min_len - gram + 1
    none = np.zeros(0, np.int64)
    if n < min_len:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums, inverse = _sums(data)
    at = np.arange(n - gram + 1)
    grams = _range_hash(sums, inverse, at, at + gram)
    # the smallest hash of every w neighbouring grams, leftmost on ties: block-wise running minima
    ranked = (grams & ~np.uint64((1 << 21) - 1)) | at.astype(np.uint64)
    rows = -(-len(ranked) // w)
    table = np.full(rows * w, np.iinfo(np.uint64).max)
    table[: len(ranked)] = ranked
    table = table.reshape(rows, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1]).ravel()
    count = n - min_len + 1
    best = (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & np.uint64((1 << 21) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    fit = end - begin >= min_len
    np.add.at(inside, begin[fit], 1)
    np.add.at(inside, end[fit] - min_len + 1, -1)
    idx = np.flatnonzero(np.cumsum(inside)[:count])
    if not len(idx):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = best[idx]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(idx)]]) - 1
    lo, hi, a = idx[first], idx[last], place[first]
    text = np.searchsorted(begin, lo, side="right") - 1
    context = mixed(_range_hash(sums, inverse, lo, hi + min_len) + ((a - lo) * 4096 + (hi - lo)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, lo, hi, grams[a], context


def stretches(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of anchors() that do not continue an equal run right before them, and the number of those that do after each."""
    goes_on = np.zeros(len(lo), bool)
    goes_on[1:] = (text[1:] == text[:-1]) & (lo[1:] == hi[:-1] + 1) & (key[1:] == key[:-1]) & (context[1:] == context[:-1])
    first = np.flatnonzero(~goes_on)
    return first, np.diff(np.append(first, len(lo))) - 1


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _anchor_rows(min_len: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch.column("text"))
            # pieces (text, first byte, last byte): texts over PIECE are cut, with windows assigned by their start
            pieces = [(i, s, min(b, s + PIECE + min_len - 1)) for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())) if b - a >= min_len for s in range(a, b - min_len + 1, PIECE)]
            pack, size = [], 0
            for j, piece in enumerate(pieces):
                pack.append(piece)
                size += piece[2] - piece[1]
                if size >= PIECE // 2 or j == len(pieces) - 1:
                    who, s, e = (np.array(x, np.int64) for x in zip(*pack))
                    joined = np.concatenate([data[x:y] for x, y in zip(s.tolist(), e.tolist())])
                    begin = np.concatenate([[0], np.cumsum(e - s)[:-1]])
                    text, lo, hi, key, context = anchors(joined, begin, begin + e - s, min_len, gram)
                    first, more = stretches(text, lo, hi, key, context)
                    text, lo, hi, key, context = (x[first] for x in (text, lo, hi, key, context))
                    shift = (s - begin - offsets[who])[text]
                    take = pa.array(who[text])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "rk", "th")), pa.array((lo + shift).astype(np.int64)), pa.array((hi + shift).astype(np.int64)), pa.array(more.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(context.view(np.int64))], ["id", "rk", "th", "lo", "hi", "more", "key", "context"])
                    pack, size = [], 0

    return run


def _context_rows(min_len: int):
    """Cuts the marked runs out of their texts: one row per run with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch.column("text"))
            who, keys, los, raws = [], [], [], []

            def flush() -> pa.RecordBatch:
                take = pa.array(who, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(batch.column(c).take(take) for c in ("id", "rk", "th")), pa.array(los, pa.int64()), pa.array(raws, pa.binary())], ["key", "id", "rk", "th", "lo", "raw"])

            for i, marks in enumerate(batch.column("marks").to_pylist()):
                for m in marks:
                    who.append(i)
                    keys.append(m["key"])
                    los.append(m["lo"])
                    raws.append(data[offsets[i] + m["lo"] : offsets[i] + m["hi"] + min_len].tobytes())
                if len(who) > 5000:
                    yield flush()
                    who, keys, los, raws = [], [], [], []
            yield flush()

    return run


def _suffixes(raw: bytes, min_len: int) -> np.ndarray:
    """Fingerprints of the first min_len bytes of every suffix of a run."""
    data = np.frombuffer(raw, np.uint8)
    sums, inverse = _sums(data)
    a = np.arange(len(data) - min_len + 1)
    return _range_hash(sums, inverse, a, a + min_len)


def suffix_order(data: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of `data` in the order of their suffixes' first `depth` bytes (ties by place), and the ranks by 1, 2, 4, ... bytes.

    A suffix stops at end[place], where its text ends. Prefix doubling on the bytes themselves.
    """
    place = np.arange(len(data))
    ranks, width = [data.astype(np.int64) + 1], 1
    while True:
        rank = ranks[-1]
        after = np.zeros(len(data), np.int64)
        inside = place + width < end
        after[inside] = rank[place[inside] + width]
        pair = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(pair, kind="stable")
        width *= 2
        if width >= depth:
            return order, ranks
        new = np.cumsum(np.concatenate([[True], pair[order][1:] != pair[order][:-1]])) if len(data) else order
        rank = np.empty(len(data), np.int64)
        rank[order] = new
        ranks.append(rank)


def common_prefixes(a: np.ndarray, b: np.ndarray, end: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a[i] and b[i], at most 2 ** len(ranks) - 1, by descending powers of two."""
    a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    stop_a, stop_b = end[a], end[b]
    for i in range(len(ranks) - 1, -1, -1):
        fits = (a + (1 << i) <= stop_a) & (b + (1 << i) <= stop_b)
        same = np.zeros(len(a), bool)
        same[fits] = ranks[i][a[fits]] == ranks[i][b[fits]]
        step = same.astype(np.int64) << i
        a, b, length = a + step, b + step, length + step
    return length


def _factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each entry of a suffix order; lcp[i] belongs to entries i - 1 and i.

    The previous and the next smaller place in the order are the nearest entries that start earlier in the text; the
    longer common prefix of the two is the longest previous factor.
    """
    lpf = [0] * len(order)
    stack: list[tuple[int, int, int]] = []  # entry, its place, common prefix with the entry below it (its previous smaller place)
    for i, (here, common) in enumerate(zip(order.tolist(), lcp.tolist())):
        while stack and stack[-1][1] > here:
            entry, _, below = stack.pop()  # `here` is its next smaller place
            lpf[entry] = max(lpf[entry], below, common)
            common = min(common, below)
        if stack:
            lpf[i] = common
        stack.append((i, here, common if stack else 0))
    return np.array(lpf, np.int64)


def previous_and_next(data: np.ndarray, end: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of `data` whether its longest previous and its longest next factor reach `min_len`.

    Only stretches of the suffix order whose neighbours share `min_len` bytes are walked; elsewhere every
    factor is shorter. Lengths count up to 2 ** bits - 1 >= min_len.
    """
    earlier, later = np.zeros(len(data), bool), np.zeros(len(data), bool)
    order, ranks = suffix_order(data, end, min_len + 1)
    order = order[order + min_len <= end[order]]
    if len(order) < 2:
        return earlier, later
    lcp = np.concatenate([[0], common_prefixes(order[:-1], order[1:], end, ranks)])
    near = lcp >= min_len
    walk = near | np.append(near[1:], False)
    order, lcp = order[walk], np.where(near, lcp, 0)[walk]
    earlier[order] = _factors(order, lcp) >= min_len
    # the same on places counted from the end: longest next factors
    later[order] = _factors(len(data) - order, lcp) >= min_len
    return earlier, later


def _matched_runs(min_len: int, keep: str):
    """Contexts sorted by (key, place) to the runs of suffixes that have a match under the same anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows, last = 0, None

        def flush() -> pa.RecordBatch:
            length = np.array([len(raw) for *_, raw in held], np.int64)
            data = np.frombuffer(b"".join(raw for *_, raw in held), np.uint8)
            begin = np.cumsum(length) - length
            earlier, later = previous_and_next(data, np.repeat(begin + length, length), min_len)
            hit = earlier if keep == "first" else earlier | later
            # places that are windows of their run
            sizes = length - min_len + 1
            hit = hit[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] if len(held) else hit
            row = np.repeat(np.arange(len(held)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            idx = np.flatnonzero(hit)
            cut = np.flatnonzero((np.diff(idx) != 1) | (np.diff(row[idx]) != 0)) + 1 if len(idx) else np.zeros(0, np.int64)
            first, end = idx[np.concatenate([[0], cut]).astype(np.int64)] if len(idx) else idx, idx[np.concatenate([cut, [len(idx)]]).astype(np.int64) - 1] if len(idx) else idx
            base = np.array([h[2] for h in held], np.int64)
            who = row[first]
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in who], pa.int64()), pa.array([held[i][1] for i in who], pa.int64()), pa.array(base[who] + at[first] if len(who) else [], pa.int64()), pa.array(base[who] + at[end] if len(who) else [], pa.int64())], ["rk", "th", "lo", "hi"])

        for batch in batches:
            for key, rk, th, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "rk", "th", "lo", "raw"))):
                if key != last and windows > 200_000:  # whole groups only; equal prefixes share their anchor
                    yield flush()
                    held, windows = [], 0
                held.append((rk, th, lo, raw))
                windows += len(raw) - min_len + 1
                last = key
        yield flush()

    return run


def _suffix_rows(min_len: int):
    """Contexts to one row per suffix, for anchors with too many contexts for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            for a in range(0, len(raws), 1000):
                prints = [_suffixes(raw, min_len) for raw in raws[a : a + 1000]]
                sizes = np.array([len(p) for p in prints], np.int64)
                take = pa.array(np.repeat(np.arange(a, a + len(prints)), sizes))
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("key", "id", "rk", "th")), pa.array(batch.column("lo").to_numpy()[a : a + len(prints)].repeat(sizes) + at), pa.array(np.concatenate(prints).view(np.int64))], ["key", "id", "rk", "th", "pos", "h"])

    return run


def _cut(min_len: int, with_bytes: bool):
    """Texts with the runs of suffixes to remove (null: none) to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch.column("text"))
            removed, spans, digests, kept = [], [], [], []
            for i, runs in enumerate(batch.column("runs")):
                raw = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(raw), bool)
                if runs.is_valid:
                    change = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(change, runs.values.field("lo").to_numpy(), 1)
                    np.add.at(change, runs.values.field("hi").to_numpy() + min_len, -1)
                    gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                rest = raw[~gone].tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_bytes else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, gram: int = GRAM, keep: str = "first", with_bytes: bool = False, task_contexts: int = TASK_CONTEXTS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if with_bytes) for every row.

    `task_contexts`: anchors with more distinct contexts are matched by grouping single suffixes
    instead of inside one task; the results are the same.
    """
    if keep not in ("first", "none") or not 1 <= gram <= min_len <= 4096:
        raise ValueError("keep is first or none, and 1 <= gram <= min_len <= 4096")
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows are known by two hashes, of the text and of id and text: rows equal in both are equal rows
    texts = texts.withColumns({"rk": F.xxhash64(F.lit("row"), "id", "text"), "th": F.xxhash64("text")})
    long_texts = texts.where(F.octet_length("text") >= min_len).select("id", "rk", "th", "text")
    found = written(long_texts.mapInArrow(_anchor_rows(min_len, gram), f"id {id_type}, rk long, th long, lo long, hi long, more long, key long, context long"), "lpf-anchors")
    # key tables are written before they are joined: a join of two plain shuffles lets Spark split a hot anchor
    # a row stands for 1 + more equal runs side by side
    number = F.sum(F.col("more") + 1)
    again = written(found.groupBy("key").agg(number.alias("places")).where("places > 1").select("key"), "lpf-again")
    shared = written(found.join(again, "key"), "lpf-shared")
    drop_written(found, again)
    place = F.struct("id", "th", "rk", "lo", "hi")
    kinds = written(shared.groupBy("key", "context").agg(number.alias("copies"), F.min(place).alias("first")), "lpf-kinds")

    runs = shared.join(kinds.where("copies > 1"), ["key", "context"])
    begin, size = F.col("lo"), F.col("hi") - F.col("lo") + 1
    if keep == "first":
        later = F.struct("id", "th", "rk", "lo") > F.struct("first.id", "first.th", "first.rk", "first.lo")
        runs = runs.where(later | (F.col("more") > 0))
        begin = F.when(later, begin).otherwise(begin + size)
    runs = runs.select("rk", "th", begin.alias("lo"), (F.col("hi") + F.col("more") * size).alias("hi"))

    bit = F.pmod("rk", F.lit(BITMAP)).cast("int")

    def met(marked: DataFrame) -> Column:
        """Whether a row may be among the marked ones, by bitmap: true for all of these and few others."""
        bits_b = spark.sparkContext.broadcast(bitmap(marked.select(bit.alias("bit")), BITMAP))

        @F.arrow_udf("boolean")
        def test(bits: pa.Array) -> pa.Array:
            return pa.array(has_bit(bits_b.value, bits.to_numpy(zero_copy_only=False)))

        return test(bit)

    mixed_keys = written(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "lpf-mixed")
    opened = kinds.join(mixed_keys, "key").select("key", "kinds", F.col("first.rk").alias("rk"), F.col("first.th").alias("th"), F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"))
    marks = written(opened.groupBy("rk", "th").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("marks")), "lpf-marks")
    # rows equal in both hashes are opened once
    contexts = long_texts.where(met(marks)).join(marks, ["rk", "th"]).dropDuplicates(["rk", "th"]).mapInArrow(_context_rows(min_len), f"key long, id {id_type}, rk long, th long, lo long, raw binary")
    crowded = written(mixed_keys.where(F.col("kinds") > task_contexts).select("key"), "lpf-crowded")
    alone = crowded.isEmpty()
    contexts = contexts if alone else written(contexts, "lpf-contexts")
    few = contexts if alone else contexts.join(crowded, "key", "left_anti")
    matched = few.repartition("key").sortWithinPartitions("key", "id", "th", "rk", "lo").mapInArrow(_matched_runs(min_len, keep), "rk long, th long, lo long, hi long")
    if not alone:
        suffixes = written(contexts.join(crowded, "key", "left_semi").mapInArrow(_suffix_rows(min_len), f"key long, id {id_type}, rk long, th long, pos long, h long"), "lpf-suffixes")
        least = [F.min(F.struct("id", "th", "rk", "pos")).alias("least")] if keep == "first" else []
        again = written(suffixes.groupBy("key", "h").agg(F.count("*").alias("n"), *least).where("n > 1"), "lpf-repeated")
        hits = suffixes.join(again, ["key", "h"])
        if keep == "first":
            hits = hits.where(F.struct("id", "th", "rk", "pos") > F.col("least"))
        matched = matched.unionByName(hits.select("rk", "th", F.col("pos").alias("lo"), F.col("pos").alias("hi")))
    cover = written(runs.unionByName(matched).groupBy("rk", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "lpf-cover")
    drop_written(shared, kinds, mixed_keys, marks)
    # texts that meet no mark are whole and stay where they are; only the others are shuffled and cut
    touched = met(cover)
    cut = texts.where(touched).join(cover, ["rk", "th"], "left").mapInArrow(_cut(min_len, with_bytes), f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    zero = F.lit(0).cast("long")
    whole = texts.where(~touched).select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    out = cut.unionByName(whole)
    return out if with_bytes else out.drop("kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and kept_text, what is left as text: a character whose bytes are only partly removed reads as U+FFFD there."""
    out = remove_repeats(load(spark, sf_dir, "documents"), keep="none", with_bytes=True).withColumnRenamed("id", "doc_id")
    return out.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
