"""Exact duplicates of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_copies(df: DataFrame, text: str = "text", index: str = "__INDEX__", out: str = "duplicate") -> DataFrame:
    """df with a flag that is set on every row whose text a row of a lesser index has.

    Texts meet by a 256-bit digest and their length, and the least index of each is pre-aggregated, so copies of
    one text are no burden to a task; rows are joined to the flags by their index. A null text is no copy.
    """
    keys = df.where(F.col(text).isNotNull()).select(F.col(index).alias("__at__"), F.sha2(text, 256).alias("__digest__"), F.length(text).alias("__size__"))
    first = keys.groupBy("__digest__", "__size__").agg(F.min("__at__").alias("__first__"), F.count("*").alias("__n__")).where("__n__ > 1")
    copies = keys.join(first, ["__digest__", "__size__"]).where("__at__ != __first__").select("__at__", F.lit(True).alias("__copy__"))
    joined = df.drop(out).join(copies, F.col(index) == F.col("__at__"), "left")
    return joined.withColumn(out, F.coalesce("__copy__", F.lit(False))).drop("__at__", "__copy__")


def keep_first(df: DataFrame, text: str = "text", index: str = "__INDEX__", out: str = "duplicate") -> DataFrame:
    """The rows that aren't flagged, with the flag."""
    return flag_copies(df, text, index, out).where(~F.col(out))
