"""Byte spans: merging, cutting at document boundaries, and cutting them out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(spans: DataFrame, keys: list[str], strategy: str = "longest") -> DataFrame:
    """(keys, start, stop) of the spans of each key, merged.

    'longest' drops spans that another one holds; 'overlapping' fuses those that meet or overlap.
    """
    order = Window.partitionBy(*keys).orderBy("start", F.desc("stop"))
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select(*keys, "start", "stop").distinct().withColumn("reach", reach)
    if strategy == "longest":
        return rows.where(F.col("reach").isNull() | (F.col("stop") > F.col("reach"))).drop("reach")
    if strategy != "overlapping":
        raise ValueError(f"unknown strategy {strategy}")
    island = F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(order)
    return rows.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def boundaries(docs: DataFrame, text: str = "text", index: str = "__INDEX__", group: int = 10_000) -> DataFrame:
    """(index, begin, end): where each document's bytes lie when all are put one after another.

    Sums run within ranges of the index and over the ranges' totals, so no window holds the whole table.
    """
    size = docs.select(F.col(index), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size")).withColumn("range", F.expr(f"`{index}` div {group}"))
    totals = size.groupBy("range").agg(F.sum("size").alias("total"))
    before = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("range").orderBy(index))
    end = size.withColumn("inside", inside).join(before, "range").withColumn("end", F.col("before") + F.col("inside"))
    return end.select(index, (F.col("end") - F.col("size")).alias("begin"), "end")


def restore(spans: DataFrame, bounds: DataFrame, index: str = "__INDEX__") -> DataFrame:
    """(index, start, stop): global spans cut at document boundaries, counted from each document's begin.

    Spans and documents meet by the blocks of bytes that they touch, which makes the range join an
    equi-join; of the common blocks the first one keeps the pair.
    """
    block = 1 << 16
    touch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(b) - 1) / block)))
    left = spans.where("start < stop").select("start", "stop").withColumn("block", touch("start", "stop"))
    right = bounds.where("begin < end").withColumn("block", touch("begin", "end"))
    met = left.join(right, "block").where("start < end AND stop > begin")
    met = met.where(F.col("block") == F.floor(F.greatest("start", "begin") / block))
    return met.select(index, (F.greatest("start", "begin") - F.col("begin")).alias("start"), (F.least("stop", "end") - F.col("begin")).alias("stop"))


def restore_and_merge(spans: DataFrame, bounds: DataFrame, least: int, strategy: str = "longest", index: str = "__INDEX__") -> DataFrame:
    """restore(), without spans shorter than least, merged."""
    cut = restore(spans, bounds, index).where(F.col("stop") - F.col("start") >= least)
    return merge_intervals(cut, [index], strategy)


def total_size(spans: DataFrame) -> DataFrame:
    """One row, size: the bytes of all spans; those that overlap count each by itself."""
    return spans.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0).cast("long")).alias("size"))


def cut_out(text: Column | str, spans: Column | str) -> Column:
    """The text without the bytes of its spans (array of start, stop); broken UTF-8 at the cuts is dropped.

    Null spans leave the text as it is, and a null text stays null."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for t, s in zip(texts.to_pylist(), lists.to_pylist()):
                if t is not None and s:
                    data, parts, at = t.encode(), [], 0
                    for span in sorted(s, key=lambda x: (x["start"], x["stop"])):
                        parts.append(data[at : max(at, span["start"])])
                        at = max(at, span["stop"])
                    t = (b"".join(parts) + data[at:]).decode("utf-8", "ignore")
                out.append(t)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, F.col(spans) if isinstance(spans, str) else spans)
