"""The corpus pipeline: language ID, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.

In all stages an empty table gives an empty one, texts are read whole however long they are, and other columns
are carried whatever their names, though the last stage returns its own. Rows that repeat are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.llm import language, near_dedup, packing, quality
from siltmill.llm.text import count_words
from siltmill.session import use_repo, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; their lang column is what was declared, their source the host.

    Each row is judged by itself, null ids and repeated ones too. A null or empty text stays where its declaration
    and host tell the language; of equally likely languages the first by name counts."""
    use_repo(spark)
    return language.keep_known(docs, declared=F.col("lang"), host=F.col("source"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat themselves too much. Null and empty texts repeat nothing and stay, as do null
    ids; a text at a limit stays."""
    use_repo(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id. Null ids stay, as no group can name
    them, and so do texts that are null or without words; a pair at the threshold is near."""
    use_repo(spark)
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in bins of 2048 words: a row for each document's piece. Texts that are null or without words
    give none; null ids are packed; equal lengths take their bins by the ids' hashes."""
    use_repo(spark)
    return packing.pack(docs, length=count_words(F.col("text")))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: No stage of these is within SQL's reach; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
