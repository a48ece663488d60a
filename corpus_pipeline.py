"""From raw documents to packed training sequences: five stages, each of them one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.jaccard import dedup_groups
from heliograph.llm.lines import dedup_lines
from heliograph.llm.packing import pack
from heliograph.llm.quality import quality_filter
from heliograph.llm.scratch import discard, stash
from heliograph.llm.substrings import dedup_substrings


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them null, empty and blank texts. Repeated rows are judged each
    for itself; other columns pass through; an empty table stays empty."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go, in each of them; each row is a document. A null text becomes an empty
    one; other columns pass through but for n_chars, which follows the text; an empty table stays empty."""
    return _counted(dedup_lines(docs, least=10))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; texts without words all stay. Rows,
    not ids, are compared: a doc_id used twice loses no text, and repeated rows are copies. An empty table stays empty."""
    return dedup_groups(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of fifty that start earlier elsewhere go; all rows stay, repeated ones being judged alike. Null and
    empty texts stay as they are; other columns pass through but for n_chars; an empty table stays empty."""
    return _counted(dedup_substrings(docs, k=50))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids, as one row for each piece of a document. A null or empty text is one id; repeated rows are
    packed each for itself; a null doc_id stays null; an empty table gives no rows."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Tokenizing and connected components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
