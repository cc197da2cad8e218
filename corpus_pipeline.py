"""The corpus pipeline: five operators of ``lumenspan.llm`` on the documents, one after the other.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet and read again by whoever runs the stages. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from lumenspan.llm.common import materialise
from lumenspan.llm.queries import table, tokenizer_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from the labels judges toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are spread over ten sources or more go; n_chars follows the text.

    Documents of such lines alone are copies of each other: they stay whole for the next stage, which keeps one.
    """
    cleaned = line_dedup.remove_spread_lines(docs, spare_copies=True)
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed.cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: documents as often as it takes them."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and decoded text of each document."""
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), finish=bpe.DIGESTS)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", boilerplate_lines),
    ("near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("bpe", tokens),
]

#: No SQL: a learned lexicon and a tokenizer are not expressible; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
