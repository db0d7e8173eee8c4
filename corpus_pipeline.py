"""From raw documents to token ids: five stages, each over everything that its predecessor kept.

Stage functions take ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.  ``run`` writes
every stage as Parquet in the shared folder and reads it back, so a stage that is lost starts from files.

Mixing may leave documents out (their source is above its weight) and repeat others (below it); the language stage
drops only texts it cannot tell, and near-dedup keeps the smallest id of each group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, language_id, mixing, near_dedup, substring_dedup, support
from riskloom.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH_BYTES = 2 << 20  # of rows on their way to Python: an executor and its workers hold several of these a task


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` with batches of at most ``BATCH_BYTES`` and a row, in place of 10,000 texts of any length.

    The setting stays, because what a stage returns is computed later.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return language_id.keep_identified(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, resemblance 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that occur earlier; ``n_chars`` follows the text."""
    cut = substring_dedup.remove_repeats(docs)
    length = F.when(cut["n_removed"] > 0, F.length("text")).otherwise(F.col("n_chars")).cast(
        docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", length).select(*[support.col(n) for n in docs.columns])


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, in its block order, with as many tokens as came in."""
    return mixing.mixed_documents(docs)


@in_small_batches
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding."""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded=True, keep_text=False)
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids",
                        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

# language identification, sketches and BPE have no SQL form; the stages are tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
