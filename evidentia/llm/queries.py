"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard_join, licenses, media, mixing, packing, sharding, suffix_tree, toxicity, urls
from .shared import documents, scratch


ARRIVALS = 5


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(spark, documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.url_filter(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.default_entries(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, arrived in ARRIVALS parts, read back from the compacted version of a sharded table."""
    table = sharding.ShardedTable(spark, scratch(spark, "shards"))
    docs = documents(spark, sf_dir)
    for part in range(ARRIVALS):
        table.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == part))
    table.compact()
    return table.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(spark, documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score_toxicity(docs, model)
    held, hit = F.coalesce(toxicity.remainder("doc_id") == 1, F.lit(False)).alias("held_out"), (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return out.select("doc_id", held, "score", hit, F.size("spans").cast("long").alias("n_spans"), F.to_json("spans").alias("spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(spark, documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(spark, documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.sniff_media(media.store_media(documents(spark, sf_dir)))
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return out.select(*first, "true_type", "corrected", F.size("embedded").cast("long").alias("n_embedded"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(documents(spark, sf_dir))
    return out.withColumns({"licenses": F.array_join("licenses", ","), "best_dice": F.round("best_dice", 9)})


def op10_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_passages(documents(spark, sf_dir))
    return out.withColumns({"licenses": F.array_join("licenses", ","), "best_dice": F.round("best_dice", 9)})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_url_filter": op2_url_filter,
    "op3_sharding": op3_sharding,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_media": op9_media,
    "op10_licenses": op10_licenses,
    "op10_license_passages": op10_license_passages,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": urls.SQL,
    "op3_sharding": OP3_SQL,
    "op10_licenses": licenses.SQL,
}
