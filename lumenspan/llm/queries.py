"""The operators of this subpackage as queries over the test tables, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, line_dedup, mixing, near_dedup, pii, quality, search, secrets, toxicity
from .common import materialise



def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.summary(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices in all documents."""
    return licenses.summary(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a lexicon learned from the labels that aren't held out."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by weak supervision."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, plain and disguised."""
    return pii.summary(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by capped water-filling takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that are spread over ten sites or more."""
    cleaned = line_dedup.remove_spread_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, among all documents."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.search(materialise(search.build(docs), "index"), asked, 10)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of all documents."""
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), finish=bpe.DIGESTS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secrets, op2_licenses, op3_toxicity, op4_quality_rules, op5_personal_data,
        op6_source_mixing, op7_near_duplicates, op8_line_dedup, op9_topk_search, op10_bpe,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return {name: SQL[name] for name in queries() if name in SQL}
