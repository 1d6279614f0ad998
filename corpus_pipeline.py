"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and its result is
written as Parquet and read again as the next stage's docs. Columns beyond those of `documents`
pass through the filtering stages untouched, whatever their names.

Rows are known by `row_key`, a hash of all their columns together with doc_id, never by doc_id alone:
rows that repeat an id but differ anywhere are separate documents, and rows equal in every column are
interchangeable. Defined results, the same for every stage: an empty table gives no rows; a null
doc_id is an id like any other, smaller than all others for exact copies and larger for near copies;
null and empty texts have no language and leave in the first stage, and where a stage is used alone
they are copies of each other in `exact_copies`, kept by `near_copies` and `decontaminated`, and never
drawn by `mixture`; texts are judged whole at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxledger.llm.common import load, written
from fluxledger.llm.decontaminate import contaminated
from fluxledger.llm.exact_dedup import exact_dedup
from fluxledger.llm.langid import held_out, identify, train
from fluxledger.llm.mixing import mixed_sizes
from fluxledger.llm.ngram_join import jaccard_components

KEY = "_row_key"


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of a whole row."""
    return F.xxhash64(*_all(docs))


def _one_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs that `rows` (KEY, k_id) names, one of those equal in all columns."""
    named = rows.select(F.col(KEY).alias("_key"), F.col("k_id").alias("_id")).distinct()
    keyed = docs.withColumn(KEY, row_key(docs))
    # the id is compared besides the join key, so that grouping by the key needs no second shuffle
    same = keyed.join(named, (F.col(KEY) == F.col("_key")) & ((F.col("doc_id") <= F.col("_id")) & (F.col("doc_id") >= F.col("_id")) | (F.col("doc_id").isNull() & F.col("_id").isNull())), "left_semi")
    return same.dropDuplicates([KEY, "doc_id"]).drop(KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or neither the family nor the pair machines give it even odds.

    Rows are judged one by one, so repeated rows all stay or all go.
    """
    model = train(docs.where(~held_out()))
    said = identify(docs.select(*[F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns]), model, text_col="_text")
    return said.where("lang_pred <> 'und' and odds >= 0.5").select(*[F.col(f"`_{c}`").alias(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case, one row stays: the largest doc_id, and among equal ids the largest row key."""
    key = row_key(docs)
    judged = exact_dedup(docs.withColumn(KEY, key), carry=[KEY]).where("kept")
    best = judged.groupBy("text_sha256").agg(F.max(F.struct("id", KEY)).alias("best"))
    return _one_each(docs, best.select(f"best.{KEY}", F.col("best.id").alias("k_id")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, one row stays: the smallest
    doc_id, and among equal ids the smallest row key. Equal rows are one document; texts without words are kept row by row key."""
    keyed = docs.withColumn(KEY, row_key(docs))
    linked = written(jaccard_components(keyed, id_col=KEY, k=5, percent=80).select(F.col("id").alias(KEY), F.col("component_id").alias("component")).distinct(), "near-linked")
    ids = keyed.select(KEY, F.col("doc_id").alias("k_id")).distinct()
    first = linked.join(ids, KEY).groupBy("component").agg(F.min(F.struct(F.col("k_id").isNull().alias("last"), "k_id", KEY)).alias("first"))
    return _one_each(docs, first.select(f"first.{KEY}", "first.k_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; rows are judged one by one, so repeated rows all stay or all go."""
    keyed = docs.withColumn(KEY, row_key(docs))
    hits = contaminated(keyed, load(spark, sf_dir, "benchmark"), id_col=KEY).select(F.col("id").alias("_hit")).distinct()
    hits = written(hits, "leaks")
    return keyed.join(hits, F.col(KEY) == F.col("_hit"), "left_anti").select(*_all(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn into the mixture, with size, source_size, target and the words taken of each.

    Columns of these names are replaced. Equal rows are separate documents, each with its own share.
    """
    keyed = docs.withColumn(KEY, row_key(docs))
    drawn = mixed_sizes(keyed, id_col=KEY).where("taken > 0").select(F.col("id").alias("_key"), "size", "source_size", "target", "taken")
    drawn = written(drawn, "mix-drawn")
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    # a row of `drawn` stands for one of the rows with its key, which are equal in all columns
    one = keyed.dropDuplicates([KEY]).select(KEY, *[F.col(f"`{c}`") for c in kept])
    return one.join(drawn, F.col(KEY) == F.col("_key")).drop(KEY, "_key")


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("mixture", mixture),
]

#: Language identification is trained, so the rows of run() have no SQL; tests/llm/test_pipeline.py holds them
#: against a brute-force version, with a fixed language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
