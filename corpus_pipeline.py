"""A corpus pipeline over the operators of evidentia.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import jaccard_join, mixing, packing, toxicity
from evidentia.llm.shared import apart, documents, small_batches, stored

#: Near duplicates: shingles of five words, four fifths in common.
WORDS, NUM, DEN = 5, 80, 100
#: What tells rows apart in the near-duplicates stage.
KEY, HASH = "__row", "__hash"
#: Words whose ids a packing worker keeps: few, for workers of earlier stages still hold memory.
CACHED = 200_000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled ones, doesn't reject.

    Null and empty texts stay; repeated rows stay or go together; without
    labels nothing goes; an empty table stays empty.
    """
    small_batches(spark)
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the smallest doc_id.

    Documents without words link with nothing and stay. Of rows with equal
    doc_id that with the smallest hash of its columns counts as smaller, a null
    doc_id as largest; of rows equal in every column one stays. An empty table
    stays empty.
    """
    rows = docs.withColumn(HASH, F.xxhash64(*docs.columns))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(HASH).alias("h"))
    groups = jaccard_join.jaccard_components(spark, rows.withColumn(KEY, key), key=KEY, words=WORDS, num=NUM, den=DEN)
    parts = groups.select(F.col(f"{KEY}.id").alias("__id"), F.col(f"{KEY}.h").alias("__h"), "n_shingles", F.col(KEY).eqNullSafe(F.col("component_id")).alias("first"))
    gone = parts.where("not first").select("__id", "__h")
    # few rows go: a filter of fixed size tells which may, and only the texts of those are joined
    sure, others = apart(rows, F.xxhash64("doc_id", HASH), gone.select(F.xxhash64("__id", "__h").alias("h")))
    same = others["doc_id"].eqNullSafe(F.col("__id")) & (others[HASH] == F.col("__h"))
    kept = sure.unionByName(others.join(gone, same, "left_anti")).select(*docs.columns)
    # only rows that repeat in every column need more: of such with words one stays
    again = parts.where("first and n_shingles > 0").groupBy("__id", "__h").agg(F.count("*").alias("n")).where("n > 1").select("__id", "__h")
    if again.isEmpty():
        return kept
    whole = kept.withColumn(HASH, F.xxhash64(*docs.columns))
    same = whole["doc_id"].eqNullSafe(F.col("__id")) & (whole[HASH] == F.col("__h"))
    once = whole.join(again, same, "left_semi").select(*docs.columns).dropDuplicates()
    return whole.join(again, same, "left_anti").select(*docs.columns).unionByName(once)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Null texts have no words; null sources are one source; repeated rows are
    drawn one by one; an empty table stays empty.
    """
    return mixing.mixed(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences.

    A null or empty text is its end id alone; repeated rows are packed each; an
    empty table gives no pieces.
    """
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), cached=CACHED)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has neither the field's marginals nor the walk; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs, _ = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
