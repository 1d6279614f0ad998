"""N-gram Jaccard join by prefix tree (operator 9).

Two documents link when 100 * |intersection| >= `percent` * |union| of their word-shingle sets.

1. Documents with equal sets form a class at once (digest of the set, grouped with map-side
   combination); all that follows works on classes.
2. Sets are put in one global order, that of the shingle hashes, and stored as a tree of paths: the
   order is cut at fixed places, and what lies between two cuts is one edge. Sizes fall into bands,
   whose cuts lie so close that a set of the band has more edges than a partner may differ in
   tokens; two linked sets then share whole edges. Each set stores a prefix of its edges, longest
   first, which is long enough to meet every partner (the prefix lemma over edges: H + 1 edges,
   H being the most tokens in which partners of its size differ). A set with too few edges (equal cuts
   fall together by chance) also stores edges of finer cuts, at last single tokens.
3. Tasks collapse equal edges of their own documents, then edges meet by ranges of their hash; an
   edge of a single class goes no further. A hot edge costs a row per task, not per document.
4. Each class is paired with two pivots of its edges. Pairs are verified by walking prefix trees:
   the sets of one probe's partners, in the global order, are a trie in depth-first order, where a
   shared path's overlap is counted once and a subtree is left when overlap plus the remaining
   lengths cannot reach the threshold.
5. Edges whose classes are not yet in one component may hold further links. Such edges with classes in common make a
   group, whose paths follow a common trunk as far as they are alike:
   classes are joined on what their paths leave out of the trunk or add to
   it, of which two that link must share more the farther both are from the trunk. These pairs are
   verified in the same way, so no link between components is missed, and no group is expanded into all its pairs.

Probes with many partners are dealt out in chunks; sets of partners move once per pair, texts are
not shuffled. Broadcast: a bitmap of candidate documents (1 MB, fixed size). Defined results: null,
empty or word-less texts have empty sets and link with nothing; repeated ids are separate documents;
component_id is the smallest non-null id in the component; other columns, whatever their names, are not
read; ids are cast to long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bounded_batches, components, drop_written, has_bit, load, written
from .shingles import mixed, shingle_sets

K = 3
PERCENT = 90
BITMAP = 1 << 23
CHUNK = 512
#: Edges a task holds before it sends them off.
HELD = 1 << 20
_SALT = 0x9E3779B97F4A7C15


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _survey(k: int):
    """Per document: size and digest of its set, and the digest's first eight bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                digests.append(_digest(s))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([_key(d) for d in digests], pa.int64())], ["id", "n", "digest", "d"])

    return run


def bands(percent: int) -> np.ndarray:
    """Largest set size of each band; a band spans the lengths of two steps of partners."""
    out, lo = [], 1
    while lo < 1 << 40:
        out.append(max(lo, lo * 10_000 // (percent * percent)))
        lo = out[-1] + 1
    return np.array(out, np.int64)


def stored_edges(s: np.ndarray, percent: int, tops: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the edges that a set (sorted, distinct) stores, for its own band and those of smaller partners."""
    n = len(s)
    own = int(np.searchsorted(tops, n))
    for band in range(own, -1, -1):
        top = int(tops[band])
        if band < own and 100 * top < percent * n:
            break
        # tokens in which a partner may differ; a pair meets in the band of the smaller set
        partner = 100 * n // percent if band == own else top
        h = (100 - percent) * (n + partner) // (100 + percent)
        cuts = 1 + 13 * (1 + (100 - percent) * top // percent) // 10
        for level, m in enumerate((cuts, 4 * cuts, None)):
            salt = np.uint64(_SALT * (3 * band + level + 1) & 0xFFFFFFFFFFFFFFFF)
            tokens = mixed(s ^ salt)
            if m is None:
                edges = tokens[: h + 1]  # the lemma on single tokens, in the order of the hashes
                more = False
            else:
                place = (s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                edges = mixed(np.add.reduceat(tokens, first) + salt)
                more = len(edges) <= h
                if not more:
                    size = np.diff(np.append(first, n))
                    edges = edges[np.lexsort((edges, -size))[: h + 1]]
            yield edges
            if not more:
                break


def _grouped(edges: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(edges in order, keys, first place of every run, smallest key of the run, whether the run has two keys)."""
    order = np.argsort(edges, kind="stable")
    edges, keys = edges[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], edges[1:] != edges[:-1]]))
    low = np.minimum.reduceat(keys, first)
    return edges, keys, first, low, low != np.maximum.reduceat(keys, first)


def _member_rows(edges: np.ndarray, keys: np.ndarray, first: np.ndarray, low: np.ndarray, several: np.ndarray) -> np.ndarray:
    """(edge, key, smallest key) of the runs with several keys, as rows of int64."""
    sizes = np.diff(np.append(first, len(edges)))
    inside = np.repeat(several, sizes)
    return np.stack([edges.view(np.int64)[inside], keys[inside], np.repeat(low, sizes)[inside]], 1)


def _blobs(ranges: np.ndarray, rows: np.ndarray, name: str) -> pa.RecordBatch:
    """One binary value per range of the rows, which are in order of their range."""
    first = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
    width = rows.shape[1] * 8
    offsets = (np.append(first, len(rows)) * width).astype(np.int64)
    data = pa.py_buffer(np.ascontiguousarray(rows))
    values = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), data]).cast(pa.binary())
    empty = pa.nulls(len(first), pa.binary())
    columns = [values, empty] if name == "entries" else [empty, values]
    return pa.RecordBatch.from_arrays([pa.array(ranges[first], pa.int32()), *columns], ["range", "entries", "members"])


def _edges(k: int, percent: int, bits: int):
    """Texts to blobs of (edge, class) by range of the edge hash; edges that several classes of one task share go out once, with their members apart."""

    def flush(edges: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e, key, first, low, several = _grouped(np.concatenate(edges), np.concatenate(keys))
        ranges = (e >> np.uint64(64 - bits)).astype(np.int32)
        once = np.stack([e[first].view(np.int64), low], 1)
        step = 1 << 18
        for a in range(0, len(once), step):
            yield _blobs(ranges[first][a : a + step], once[a : a + step], "entries")
        inside = np.repeat(several, np.diff(np.append(first, len(e))))
        members = _member_rows(e, key, first, low, several)
        for a in range(0, len(members), step):
            yield _blobs(ranges[inside][a : a + step], members[a : a + step], "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = bands(percent)
        edges, keys, held = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), k):
                if not len(s):
                    continue
                d = _key(_digest(s))
                for e in stored_edges(s, percent, tops):
                    edges.append(e)
                    keys.append(np.full(len(e), d, np.int64))
                    held += len(e)
                if held >= HELD:
                    yield from flush(edges, keys)
                    edges, keys, held = [], [], 0
        if held:
            yield from flush(edges, keys)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs in order of their range to (edge, d, pivot) of every class on an edge of several classes; pivot: the smallest class seen there."""

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[a : a + (1 << 17)].T], ["edge", "d", "pivot"])

    held, size, last = [], 0, None
    for batch in batches:
        for at, entries, members in zip(batch.column("range").to_pylist(), batch.column("entries"), batch.column("members")):
            if at != last and size > 1 << 23:  # whole ranges only
                both = np.concatenate(held)
                yield from out(_member_rows(*_grouped(both[:, 0].view(np.uint64), both[:, 1].copy())))
                held, size = [], 0
            last = at
            if members.is_valid:
                yield from out(np.frombuffer(members.as_buffer(), np.int64).reshape(-1, 3))
            else:
                held.append(np.frombuffer(entries.as_py(), np.int64).reshape(-1, 2))
                size += held[-1].nbytes
    if held:
        both = np.concatenate(held)
        yield from out(_member_rows(*_grouped(np.ascontiguousarray(both[:, 0]).view(np.uint64), both[:, 1].copy())))


def _full_sets(k: int, bitmap_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").filter(pa.array(has_bit(bitmap_b.value, batch.column("bit").to_numpy(zero_copy_only=False))))
            digests, sets, held = [], [], 0

            def made() -> pa.RecordBatch:
                lengths = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sets).view(np.int64)))], ["digest", "tokens"])

            for s in shingle_sets(texts, k):
                if len(s):
                    digests.append(_digest(s))
                    sets.append(s)
                    held += len(s)
                if held > 1 << 18:
                    yield made()
                    digests, sets, held = [], [], 0
            if sets:
                yield made()

    return run


def trie_partners(probe: np.ndarray, sets: list[np.ndarray], order: np.ndarray, percent: int) -> list[int]:
    """Numbers of the sets that link with the probe.

    All arrays hold token ranks of the global order, ascending. Sorted as sequences the sets are a
    trie in depth-first order: what a set shares with the one before it is a common path, and its
    overlap is taken over. `order` sorts them.
    """
    nx = len(probe)
    size = 1 + int(max([probe[-1], *(s[-1] for s in sets)]))
    inside = np.zeros(size + 1, np.int32)
    inside[probe + 1] = 1
    upto = np.cumsum(inside)  # probe tokens of rank < r
    sizes = np.array([len(s) for s in sets])
    needed = -(-percent * (nx + sizes) // (100 + percent))
    least, longest = int(needed.min()), int(sizes.max())
    found, path, overlap, dead = [], np.zeros(0, np.int64), np.zeros(1, np.int64), None
    for i in order:
        s = sets[i]
        m = min(len(path), len(s))
        differ = np.flatnonzero(path[:m] != s[:m])
        common = int(differ[0]) if len(differ) else m
        if dead is not None and common >= dead:
            continue  # in a subtree that cannot reach the threshold
        dead = None
        here = np.empty(len(s) + 1, np.int64)
        here[: common + 1] = overlap[: common + 1]
        here[common + 1 :] = overlap[common] + np.cumsum(inside[s[common:] + 1])
        path, overlap = s, here
        if here[-1] >= needed[i]:
            found.append(i)
            continue
        # the bound along the path: overlap so far plus what both sides still have
        depth = np.arange(1, len(s) + 1)
        bound = here[1:] + np.minimum(longest - depth, nx - upto[s + 1])
        low = np.flatnonzero(bound < least)
        dead = int(low[0]) + 1 if len(low) else None
    return found


def _verified(percent: int):
    """Rows (probe, chunk, is_probe, cls, tokens), sorted so that a probe's own row leads its chunk, to links."""

    def links(probe: int, own: np.ndarray, classes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        tokens = np.unique(np.concatenate([own, *sets]))  # ranks follow the hashes, the global order
        ranked = [np.searchsorted(tokens, s) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        return [(probe, classes[i]) for i in trie_partners(np.searchsorted(tokens, own), ranked, order, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, classes, sets = None, None, [], []
        for batch in batches:
            out = []
            values = batch.column("tokens")
            flat, at = values.values.to_numpy().view(np.uint64), values.offsets.to_numpy()
            rows = zip(batch.column("probe").to_pylist(), batch.column("chunk").to_pylist(), batch.column("is_probe").to_pylist(), batch.column("cls").to_pylist(), at[:-1], at[1:])
            for probe, chunk, is_probe, cls, a, b in rows:
                if (probe, chunk) != key:
                    if sets and own is not None:
                        out += links(key[0], own, classes, sets)
                    key, own, classes, sets = (probe, chunk), None, [], []
                if is_probe:
                    own = np.array(flat[a:b])
                else:
                    classes.append(cls)
                    sets.append(np.array(flat[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        if sets and own is not None:
            out = links(key[0], own, classes, sets)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the written pairs (probe, cls), as a written table."""
    # written first, so that Spark can split a hot probe in the join
    chunks = written(pairs.groupBy("probe").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "ngram-chunks")
    dealt = pairs.join(chunks, "probe").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks"))).select("probe", "chunk", "cls")
    partners = dealt.join(sets, "cls").select("probe", "chunk", F.lit(False).alias("is_probe"), "cls", "tokens")
    own = chunks.select("probe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    own = own.join(sets, F.col("probe") == F.col("cls")).select("probe", "chunk", F.lit(True).alias("is_probe"), "cls", "tokens")
    rows = partners.unionByName(own).repartition("probe", "chunk").sortWithinPartitions("probe", "chunk", F.desc("is_probe"))
    links = written(rows.mapInArrow(_verified(percent), "a long, b long"), "ngram-links")
    drop_written(chunks)
    return links


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Least intersection of two sets of these sizes that link."""
    return F.ceil(F.lit(percent) * (n + m) / (100 + percent))


def _near(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _sets_of(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, tokens) of the wanted classes (digest, cls, first_id); other texts are dropped by bitmap before any shuffle."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP)).cast("int")
    bitmap_b = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select(bit("first_id").alias("bit")), BITMAP))
    sets = texts.select("text", bit("id").alias("bit")).mapInArrow(_full_sets(k, bitmap_b), "digest binary, tokens array<long>")
    sets = written(sets.join(wanted, "digest").groupBy("digest", "cls").agg(F.first("tokens").alias("tokens")).select("cls", "tokens"), "ngram-sets")
    bitmap_b.destroy()
    return sets


def _star(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (probe, cls) of every class with the pivot it meets on most edges and its smallest pivot."""
    met = members.where("d <> pivot").groupBy("d", "pivot").agg(F.count("*").alias("c"))
    best = met.groupBy("d").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("most"), F.min("pivot").alias("least"))
    pairs = best.select("d", F.explode(F.array_distinct(F.array("most", "least"))).alias("pivot"))
    named = pairs.join(classes.select("d", "cls"), "d").join(classes.select(F.col("d").alias("pivot"), F.col("cls").alias("probe")), "pivot")
    return written(named.select("probe", "cls"), "ngram-star")


_MARKS = [f"marks{i}" for i in range(4)]


def _marks(tokens: str) -> list[Column]:
    """A 256-bit mark of an array of tokens, as four longs."""
    return [F.expr(f"aggregate({tokens}, 0L, (m, x) -> m | if((shiftright(x, 8) & 3) = {i}, shiftleft(1L, cast(shiftright(x, 10) & 63 as int)), 0L))").alias(m) for i, m in enumerate(_MARKS)]


def _picked(many: DataFrame, count: int) -> DataFrame:
    """Up to `count` classes of each pivot, by hash: (pivot, cls)."""
    picks = many.groupBy("pivot").agg(F.array_distinct(F.array(*[F.min_by("cls", F.xxhash64(F.lit(i), "cls")) for i in range(count)])).alias("picks"))
    return picks.select("pivot", F.explode("picks").alias("cls"))


def _trunks(many: DataFrame, sets: DataFrame, count: int = 16) -> DataFrame:
    """A path near the middle of each group, the trunk: tokens that most of `count` classes of it hold. Any path would give right results."""
    picked = written(_picked(many, count), "ngram-picked")
    of = written(picked.groupBy("pivot").agg(F.count("*").alias("of")), "ngram-picks")
    tokens = picked.join(sets, "cls").select("pivot", F.explode("tokens").alias("token")).groupBy("pivot", "token").agg(F.count("*").alias("n"))
    trunks = written(tokens.join(of, "pivot").where("2 * n > of").groupBy("pivot").agg(F.collect_list("token").alias("trunk")), "ngram-trunks")
    drop_written(picked, of)
    return trunks


def _deviations(many: DataFrame, sets: DataFrame) -> DataFrame:
    """How the path of each row (pivot, cls, comp) leaves the trunk of its group: n and t tokens, `a` of the trunk left out, dev: what is left out or added."""
    many = written(many, "ngram-groups")
    trunks = _trunks(many, sets)
    d = many.join(trunks, "pivot", "left").withColumn("trunk", F.coalesce("trunk", F.array().cast("array<long>"))).join(sets, "cls")
    d = d.select("pivot", "cls", "comp", F.size("tokens").alias("n"), F.size("trunk").alias("t"), F.array_except("trunk", "tokens").alias("out"), F.transform(F.array_except("tokens", "trunk"), F.bitwise_not).alias("new"))
    d = written(d.select("pivot", "cls", "comp", "n", "t", F.size("out").alias("a"), F.concat("out", "new").alias("dev")).select("*", F.size("dev").alias("d"), *_marks("dev")), "ngram-deviations")
    drop_written(many, trunks)
    return d


def _nearest(d: DataFrame, percent: int) -> DataFrame:
    """Pairs (probe, cls) of every row with the row of its group that leaves the trunk least, see _trunk_pairs."""
    least = d.groupBy("pivot").agg(F.min_by(F.struct("cls", "comp"), F.struct(F.lit(percent) * F.col("n") + (100 + percent) * F.col("a"), "cls")).alias("near"))
    return d.select("pivot", "cls", "comp").join(written(least, "ngram-nearest"), "pivot").where("comp <> near.comp").select(F.col("near.cls").alias("probe"), "cls")


def _shared(percent: int) -> Column:
    """Deviations that rows x and y of one pivot must share to link; at least 1, see _trunk_pairs."""
    return F.greatest(F.lit(1), _needed(F.col("x.n"), F.col("y.n"), percent) - F.col("x.t") + F.col("x.a") + F.col("y.a"))


def _may_link(percent: int) -> Column:
    """By sizes and marks: a mark of one side that the other lacks is a deviation they do not share."""
    lacks = lambda u, v: sum((F.bit_count(F.col(f"{u}.{m}").bitwiseAND(F.bitwise_not(f"{v}.{m}"))) for m in _MARKS), F.lit(0))
    most = F.least(F.col("x.d") - lacks("x", "y"), F.col("y.d") - lacks("y", "x"))
    return (F.col("x.comp") != F.col("y.comp")) & _near(F.col("x.n"), F.col("y.n"), percent) & (most >= _shared(percent))


def _more_pivots(d: DataFrame, percent: int, count: int = 8) -> DataFrame:
    """Pairs (probe, cls) of every row with up to `count` classes of its group, if they may link; settles dense groups before any cross pairs."""
    picked = _picked(d.select("pivot", "cls"), count).join(d.drop("dev"), ["pivot", "cls"])
    x, y = d.drop("dev").alias("x"), written(picked, "ngram-picked").alias("y")
    pairs = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.cls") != F.col("y.cls")) & _may_link(percent))
    return pairs.select(F.col("y.cls").alias("probe"), F.col("x.cls").alias("cls"))


def _trunk_pairs(d: DataFrame, percent: int) -> DataFrame:
    """Pairs (probe, cls) across components among the rows of _deviations.

    The paths of a group leave its trunk of t tokens. If x and y leave out a and b of them, their overlap is
    t - a - b plus the deviations they share. Pairs that link without sharing any have f(x) + f(y) <= t with
    f = a + percent * n / (100 + percent); then the row of least f links with both (_nearest), and they are in one
    component already. All other pairs must share needed - (t - a - b) >= 1 deviations, and a prefix of the
    deviations shows every such pair: any order of them gives right results. A sample says which ones are frequent
    in the group; these come last, the others by hash. Marks of fixed size bound what two classes can
    share, so the join makes few rows that are not links.
    """
    part = F.lit(percent) / (100 + percent)
    # the least f among the classes of other components, and the least a
    own = d.groupBy("pivot", "comp").agg(F.min(part * F.col("n") + F.col("a")).alias("f"), F.min("a").alias("a"), F.count("*").alias("members"))
    own = written(own, "ngram-least")
    best = own.groupBy("pivot").agg(F.min(F.struct("f", "comp")).alias("best"), F.min("a").alias("least_a"), F.sum("members").alias("members"))
    best = written(best, "ngram-best")
    second = own.join(best, "pivot").where("comp <> best.comp").groupBy("pivot").agg(F.min("f").alias("second"))
    known = written(best.join(second, "pivot"), "ngram-bounds")  # groups of one component have no second and are settled
    sample = d.join(known, "pivot").where(F.pmod(F.xxhash64(F.lit(7), "cls"), F.greatest(F.lit(8), F.ceil(F.col("members") / 512))) == 0)
    seen = sample.select("pivot", F.explode("dev").alias("token")).groupBy("pivot", "token").agg(F.count("*").alias("f")).where("f > 1")
    frequent = seen.groupBy("pivot").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda x: x["token"]).alias("frequent"))
    frequent = written(frequent, "ngram-frequent")

    d = d.join(known, "pivot").join(frequent, "pivot", "left").withColumn("frequent", F.coalesce("frequent", F.array().cast("array<long>")))
    least = F.when(F.col("comp") == F.col("best.comp"), F.col("second")).otherwise(F.col("best.f"))
    near = part * (F.col("n") + F.ceil(F.lit(percent) * F.col("n") / 100)) + F.col("least_a")
    d = d.withColumn("shared", F.greatest(F.lit(1), F.ceil(F.greatest(part * F.col("n") + least, near) - 1e-6) - F.col("t") + F.col("a")).cast("int"))
    d = d.where(F.col("shared") <= F.col("d"))
    listed = F.concat(F.array_sort(F.array_except("dev", "frequent")), F.array_intersect("frequent", "dev"))
    kept = [F.col(c) for c in ("pivot", "cls", "comp", "n", "t", "a", "d", *_MARKS)]
    at = d.select(*kept, F.slice(listed, F.lit(1), F.col("d") - F.col("shared") + 1).alias("head"))
    at = at.select(*kept, F.posexplode("head").alias("i", "token")).withColumn("left", F.col("d") - F.col("i")).drop("i")
    at = written(at, "ngram-branches")
    x, y = at.alias("x"), at.alias("y")
    shared, rest = _shared(percent), F.least("x.left", "y.left")
    on = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") > F.col("y.cls"))
    pairs = x.join(y, on & (rest >= shared) & _may_link(percent))
    pairs = pairs.groupBy(F.col("x.pivot").alias("pivot"), F.col("x.cls").alias("probe"), F.col("y.cls").alias("cls")).agg(F.count("*").alias("c"), F.min(rest).alias("rest"), F.first(shared).alias("shared"))
    pairs = written(pairs.where(F.col("c") + F.col("rest") - 1 >= F.col("shared")).select("probe", "cls"), "ngram-cross")
    drop_written(own, best, known, frequent, at)
    return pairs


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id for every row of `docs`."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    watch = Observation()
    survey = texts.mapInArrow(_survey(k), "id long, n long, digest binary, d long").withColumn("row", F.monotonically_increasing_id())
    survey = written(survey, "ngram-survey", watch, F.sum("n").alias("tokens"))
    classes = written(survey.where("n > 0").groupBy("digest").agg(F.max("d").alias("d"), F.max("n").alias("n"), F.min("row").alias("cls"), F.min("id").alias("first_id")), "ngram-classes")

    # a range of edges is to hold some 50,000; at least 64 ranges, at most 2 ** 20
    bits = min(20, max(6, ((watch.get["tokens"] or 0) * (100 - percent) // (50_000 * percent)).bit_length()))
    edges = texts.select("text").mapInArrow(_edges(k, percent, bits), "range int, entries binary, members binary")
    members = written(edges.repartition("range").sortWithinPartitions("range").mapInArrow(_met, "edge long, d long, pivot long"), "ngram-members")
    sets = _sets_of(texts, members.select("d").distinct().join(classes, "d").select("digest", "cls", "first_id"), k)

    star = _star(members, classes)
    links = _verify(star, sets, percent)
    comp = components(links)
    held = members.select("edge", "d").distinct().join(classes.select("d", "cls", "n"), "d").select("edge", "cls", "n")
    held = held.join(comp.withColumnRenamed("id", "cls"), "cls", "left").select("edge", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    held = written(held, "ngram-held")
    drop_written(members)
    unsettled = held.groupBy("edge").agg(F.min("comp").alias("main"), F.max("comp").alias("other"), F.min("cls").alias("pivot")).where("main <> other").select("edge", "pivot")
    unsettled = written(unsettled, "ngram-unsettled")
    many = written(held.join(unsettled, "edge").select("pivot", "cls", "comp").distinct(), "ngram-open")
    drop_written(held, unsettled)
    # edges with classes in common make one group, so that a class is in one group only
    group = components(many.select(F.col("cls").alias("a"), F.col("pivot").alias("b"))).select(F.col("id").alias("cls"), F.col("component").alias("pivot"))
    far = _deviations(many.select("cls", "comp").distinct().join(group, "cls"), sets)
    drop_written(many)
    seen = star.select(F.greatest("probe", "cls").alias("probe"), F.least("probe", "cls").alias("cls")).distinct()
    new = lambda pairs: pairs.select(F.greatest("probe", "cls").alias("probe"), F.least("probe", "cls").alias("cls")).distinct().join(seen, ["probe", "cls"], "left_anti")
    second = written(new(_more_pivots(far, percent).unionByName(_nearest(far, percent))), "ngram-second")
    more = _verify(second, sets, percent)
    links = written(links.unionByName(more), "ngram-links")
    comp = components(links)
    now = comp.select(F.col("id").alias("cls"), F.col("component").alias("now"))
    cross = _trunk_pairs(far.join(now, "cls", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now"), percent)
    last = written(new(cross).join(second, ["probe", "cls"], "left_anti"), "ngram-last")
    if not last.isEmpty():
        final = _verify(last, sets, percent)
        links = written(links.unionByName(final), "ngram-links")
        comp = components(links)
    drop_written(star, far, second, more, cross, last, sets, links)

    named = classes.join(comp, F.col("cls") == F.col("id"), "left").select("digest", F.coalesce("component", "cls").alias("component"), "first_id")
    named = written(named, "ngram-named")
    least = written(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "ngram-least")
    named = written(named.join(least, "component").select("digest", "component_id"), "ngram-names")
    out = survey.select("id", "n", "digest").join(named, "digest", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
