"""The training-data operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.llm import fingerprints, grammar, language, near_dedup, packing, pieces, quality, token_counts, toxicity, url_filter
from siltmill.llm.text import count_words


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), length=count_words(F.col("text")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_documents(_read(spark, sf_dir, "documents"))


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_read(spark, sf_dir, "documents"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, body, told, host) of raw pages: their text, the html tag's lang, and the URL's host."""
    html = F.col("html")
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "), r"&[A-Za-z0-9#]+;", " ")
    told = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return pages.select("page_id", body.alias("body"), F.when(told != "", told).alias("told"), language.host_of(F.col("url")).alias("host"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages: what their markup declares, their hosts, domains and suffixes. The text model is fitted on the
    labels of documents, which are apart from what pages declare."""
    model = language.fit_text_model(_read(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    pages = page_evidence(_read(spark, sf_dir, "pages"))
    return language.identify(pages, "page_id", "body", declared=F.col("told"), host=F.col("host"), model=model)


def langid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, as in the pipeline: their lang column is what was declared, their source the host."""
    return language.identify(_read(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.write_shards(_read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), decoded=True)


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith(("op", "langid_"))}


def oracle_sql() -> dict[str, str]:
    return {"op2_simhash": fingerprints.ORACLE_SQL, "op9_url_filter": url_filter.ORACLE_SQL}
