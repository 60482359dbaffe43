"""Reading corpora, numbering their rows, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "__INDEX__"


class NotATable(TypeError):
    """What was loaded is no table."""


def check_table(x: object) -> DataFrame:
    if not isinstance(x, DataFrame):
        raise NotATable(f"a DataFrame is needed, not {type(x).__name__}")
    return x


def number_rows(df: DataFrame, order: list[str] | None = None, index: str = INDEX) -> DataFrame:
    """df with dense numbers from 0: by the order columns, or else in the order of the input's partitions.

    By order: rows are range-partitioned, counted by partition, and numbered within it; there is no
    window over the whole table."""
    if order is None:
        marked = _keep(df.withColumn("at_", F.monotonically_increasing_id()))
        marked = marked.withColumn("part_", F.shiftright("at_", 33))
        before = _before(marked)
        return marked.join(F.broadcast(before), "part_").withColumn(index, (F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("part_", "at_", "before_")
    ranged = df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    ranged = _keep(ranged)
    before = _before(ranged)
    local = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return ranged.withColumn("at_", local).join(F.broadcast(before), "part_").withColumn(index, (F.col("before_") + F.col("at_")).cast("long")).drop("part_", "at_", "before_")


def _before(df: DataFrame) -> DataFrame:
    """(part_, before_): how many rows the partitions before hold; a row for each partition."""
    counts = df.groupBy("part_").agg(F.count("*").alias("n_"))
    return counts.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))


def _keep(df: DataFrame) -> DataFrame:
    from siltmill.session import written

    return written(df)  # partition numbers must not change between the count and the numbering


def load(spark: SparkSession, path: str, file_type: str = "parquet", split: str | None = None, order: list[str] | None = None, index: str = INDEX, **options: str) -> DataFrame:
    """A corpus with its row numbers. split: 'train', 'train[:1000]' or 'train[:10%]', a prefix by number."""
    df = number_rows(check_table(spark.read.format(file_type).options(**options).load(path)), order, index)
    return take_split(df, split, index)


def take_split(df: DataFrame, split: str | None, index: str = INDEX) -> DataFrame:
    if not split or "[" not in split:
        return df
    low, _, high = split[split.index("[") + 1 : split.rindex("]")].partition(":")
    n = df.count()

    def at(x: str, default: int) -> int:
        if not x:
            return default
        k = round(n * float(x[:-1]) / 100) if x.endswith("%") else int(x)
        return k + n if k < 0 else k

    return df.where((F.col(index) >= at(low, 0)) & (F.col(index) < at(high, n)))


def save(df: DataFrame, path: str, clusters: DataFrame | None = None, index: str = INDEX, cluster: str = "__CLUSTER__", keep_index: bool = False, keep_cluster: bool = False, save_clusters: bool = False) -> None:
    """Write the rows, without the index and the cluster unless they are to be kept.

    With save_clusters the mapping is written to path/clusters, and both columns are kept, as the mapping
    can't be read without them."""
    if save_clusters and clusters is not None:
        clusters.write.mode("overwrite").parquet(f"{path}/clusters")
        keep_index = keep_cluster = True
    drop = [c for c, keep in ((index, keep_index), (cluster, keep_cluster)) if not keep and c in df.columns]
    df.drop(*drop).write.mode("overwrite").parquet(f"{path}/data")
