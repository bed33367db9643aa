"""The corpus pipeline: documents through five stages, each written and read again.

Null ids, texts and sources pass through as the operators define; further columns of the documents,
whatever their names, are carried by all stages but the last. An empty table gives an empty table in
each stage. Repeated rows are rows of their own until the near duplicates, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from walletlens.llm.common import table
from walletlens.llm.line_dedup import without_spread_lines
from walletlens.llm.minhash_dedup import without_near_duplicates
from walletlens.llm.mixing import mixed_rows
from walletlens.llm.packing import pack, pieces
from walletlens.llm.quality_rules import accepted, fit
from walletlens.sources.work import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier accept; null and empty texts are not."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that spread over many sites; n_chars, where the table has it, is that of the rest."""
    rest = without_spread_lines(docs)
    if "n_chars" not in docs.columns:
        return rest
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; those without words are groups of their own."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as before, with the weights of the sources tempered; documents without a source are one source."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences; a null text is an empty one."""
    cut_up = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut_up)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

# A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
