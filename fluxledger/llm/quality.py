"""Quality classification by weak labels (operator 3).

Heuristic labellers vote good, bad or nothing on every whole document. The combinations of votes
are counted over all documents (at most 3 ** labellers rows), expectation-maximisation estimates
how each labeller votes on good and on bad documents, and the posterior of a combination labels
its documents. A linear scorer over hashed byte n-grams is then trained on the posteriors of at
most about `max_training_docs` distinct texts, half of them from the less common side where it has
enough (this is the only bounded sample): each text counts for good by its posterior and for bad by
the rest. The scorer scores every whole text.

Defined results: null, empty or word-less texts get posterior and score 0 and are not kept; equal
texts get equal scores, repeated rows count in the vote counts and once in the sample; a posterior of
exactly 0.5 counts as good; a score equal to the threshold is kept; other columns, labels too, are not read and
not returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, load
from .langid import DIMS, features, svm
from .shingles import word_hashes

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = (
    "the of and to in is that for it was on are as with by at be this from or an "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au avec "
    "el los del se las por con no una su para al lo como más o"
).split()
_STOP = np.unique(word_hashes(pa.array([" ".join(FUNCTION_WORDS)]))[0])
LABELLERS = ("symbols", "capitals", "repeated_words", "exclamations", "table_bars", "function_words", "word_length", "line_ends")
GOOD, BAD, NONE = 2, 1, 0
#: Documents that the prior votes of each labeller on each side are worth, whatever the size of the table.
PRIOR_DOCS = 40


def _vote(value: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def votes(raw: np.ndarray, words: np.ndarray) -> int:
    """All labellers' votes on a text (its bytes and word hashes) as one base-3 number."""
    n = len(words)
    if n == 0:
        return 0
    hist = np.bincount(raw, minlength=256)
    letters = hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum() / 2
    symbols = hist[[35, 36, 37, 38, 42, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]].sum() / n
    capitals = hist[65:91].sum() / max(1, letters)
    repeated = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
    shouts, bars = hist[33] / n, hist[124] / n
    stop = np.isin(words, _STOP).mean()
    length = (len(raw) - hist[32] - hist[10]) / n
    ends = np.flatnonzero(raw == 10)
    lines = np.append(ends, len(raw)) - 1
    lines = lines[lines >= 0]
    closed = np.isin(raw[lines], [33, 34, 46, 58, 59, 63]).mean() if len(lines) else 0.0
    said = (
        _vote(symbols, symbols < 0.02, symbols > 0.2),
        _vote(capitals, capitals < 0.15, capitals > 0.3),
        _vote(repeated, repeated < 0.05, repeated > 0.2),
        _vote(shouts, shouts < 0.05, shouts > 0.3),
        _vote(bars, bars < 0.02, bars > 0.15),
        _vote(stop, stop > 0.2, n >= 20 and stop < 0.1),
        _vote(length, 3 <= length <= 8, length > 12),
        _vote(closed, closed > 0.7, closed < 0.3),
    )
    return int(sum(v * 3**i for i, v in enumerate(said)))


def label_model(counts: dict[int, int], rounds: int = 200, prior_good: float = 0.8) -> dict[int, float]:
    """Posterior of good for each combination of votes, by expectation-maximisation from a majority start."""
    codes = np.array(sorted(counts), np.int64)
    weight = np.array([counts[c] for c in codes], float)
    said = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    for_, against = (said == GOOD).sum(1), (said == BAD).sum(1)
    # a start in which any objection counts: labellers see different faults
    post = np.where(against > 0, 0.5 ** against * 0.5, np.where(for_ > 0, 0.95, prior_good))
    # a labeller's objection is rare on good documents; bad ones need not trip most labellers
    prior = np.array([[0.2, 0.002, 0.798], [0.35, 0.25, 0.4]])
    for _ in range(rounds):
        share = [np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99) for p in (post, 1 - post)]
        log = np.zeros((len(codes), 2))
        for side, p in enumerate((post, 1 - post)):
            mass = weight * p
            for j in range(len(LABELLERS)):
                seen = np.array([mass[said[:, j] == v].sum() for v in (NONE, BAD, GOOD)]) + prior[side] * PRIOR_DOCS
                log[:, side] += np.log(seen / seen.sum())[said[:, j]]
            log[:, side] += np.log(share[side])
        new = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -60, 60)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return {int(c): float(p) if c else 0.0 for c, p in zip(codes, post)}


def _scored(raw: bytes, words: np.ndarray) -> np.ndarray:
    """Features of the scorer: hashed byte n-grams, then how much words repeat."""
    n = max(1, len(words))
    return np.append(features(raw), [(words[1:] == words[:-1]).sum() / n, len(np.unique(words)) / n])


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, int]]:
    texts = batch.column("text").fill_null("")
    words, first = word_hashes(texts)
    for v, a, b in zip(texts, first[:-1], first[1:]):
        raw = v.as_py().encode()
        yield raw, words[a:b], votes(np.frombuffer(raw, np.uint8), words[a:b])


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_training_docs: int = 2000, threshold: float = 0.5) -> DataFrame:
    """id, votes, posterior, score and kept for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = np.unique(np.array([v for *_, v in _documents(batch)], np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(n, pa.int64())], ["votes", "n"])

    ballots = texts.select("text").mapInArrow(cast, "votes int, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    counts = {r["votes"]: r["n"] for r in ballots.collect()}
    posterior = label_model(counts) if counts else {}
    bad = sum(n for c, n in counts.items() if posterior[c] < 0.5 and c)
    good = sum(n for c, n in counts.items() if posterior[c] >= 0.5)
    half = max_training_docs // 2
    rate = {side: min(1.0, half / n) if n else 0.0 for side, n in ((True, good), (False, bad))}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(posterior.get(v, 0.5), _scored(raw, words).astype(np.float16).tobytes()) for (raw, words, v), u in zip(_documents(batch), batch.column("u").to_pylist()) if v and u < rate[posterior.get(v, 0.5) >= 0.5]]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.float64()), pa.array([b for _, b in out], pa.binary())], ["p", "f"])

    most = max(rate.values())
    u = F.pmod(F.xxhash64(F.lit("quality"), "text"), F.lit(1 << 30)) / (1 << 30)
    got = texts.select("text", u.alias("u")).where(F.col("u") < most).dropDuplicates(["u"]).mapInArrow(sample, "p double, f binary").collect()
    got.sort(key=lambda r: (r["p"], bytes(r["f"])))
    w, b = np.zeros(DIMS + 2), 0.0
    if got and bad and good:
        x = np.stack([np.frombuffer(r["f"], np.float16) for r in got]).astype(np.float32)
        p = np.array([r["p"] for r in got])
        mean, sd = x.mean(0), x.std(0) + 1e-5
        scale = sd * np.sqrt(x.shape[1])
        z = ((x - mean) / scale).astype(np.float32)
        w, b = svm(np.concatenate([z, z]), np.repeat([1.0, -1.0], len(z)), share=np.concatenate([p, 1 - p]))
        w, b = w / scale, b - float((w / scale) @ mean)
    elif good:
        b = 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, scores = [], []
            for raw, words, v in _documents(batch):
                said.append(v)
                scores.append(1 / (1 + np.exp(-np.clip(3 * (_scored(raw, words) @ w + b), -30, 30))) if v else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(said, pa.int32()), pa.array([posterior.get(v, 0.5) if v else 0.0 for v in said], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores])], ["id", "votes", "posterior", "score", "kept"])

    return texts.mapInArrow(run, f"id {id_type}, votes int, posterior double, score double, kept boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
