"""One query per operator, over the whole ``documents`` table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    byte_bpe, fingerprints, inner_products, language_id, lexical, license_scan, merkle, mixing, near_dedup,
    quality_rules, sharding, substring_dedup, token_counts,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_temperature_mixing(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "block", "slot")


@query
def op2_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), form="words")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op3_byte_bpe(spark, sf_dir):
    coded = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), decoded=True, keep_text=False)
    return byte_bpe.digests(coded)


@query
def op4_balanced_shards(spark, sf_dir):
    placed = sharding.balanced_shards(documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_token_counts(spark, sf_dir):
    counted = token_counts.count_by_section(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select("doc_id", "section", "start", "end", "n_tokens", "n_crossing")


@query
def op6_license_scan(spark, sf_dir):
    found = license_scan.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.withColumn("base", F.expr("filter(hits, h -> h.exact)")).selectExpr(
        "doc_id", "n_words", "cast(size(base) as long) as n_base",
        "array_min(base.first_word) as first_word", "array_max(base.first_word) as last_word",
        "array_join(sort_array(array_distinct(base.label)), ',') as base_labels",
        "array_join(sort_array(array_distinct(hits.label)), ',') as labels", "score")


@query
def op7_fingerprints(spark, sf_dir):
    return fingerprints.edited_neighbours(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op8_quality_rules(spark, sf_dir):
    judged = quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.OWN)


@query
def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    dictionaries = language_id.fit(docs.filter(~out))
    found = language_id.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_setsketch_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op11_norm_sorted_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return inner_products.top_inner_products(vectors, "vec_id % 100 = 0", k=10)


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle.tampered_documents(documents(spark, sf_dir).select(*merkle.FIELDS))


@query
def op13_ranked_search(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return lexical.ranked_search(documents(spark, sf_dir).select("doc_id", "text"), items, k=20)
