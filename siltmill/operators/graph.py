"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmill.session import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Each node u joins neighbours to the least id m of its closed neighbourhood:
    the larger neighbours in a large star, the smaller ones and u itself in a small star."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m0"))
    near = both.join(least, "u").withColumn("m", F.least("u", "m0"))
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            near.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


#: Edges up to so many are joined on the driver, which gives the same components without rounds of jobs.
FEW = 100_000


def _joined(edges: pa.Table) -> pa.Table:
    """(id, component) of few edges, by a forest whose roots are the least ids."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(edges.column(0).to_pylist(), edges.column(1).to_pylist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    ids = list(root)
    kind = edges.schema.field(0).type
    return pa.table({"id": pa.array(ids, kind), "component": pa.array([find(x) for x in ids], kind)})


def connected_components(edges: DataFrame, left: str = "left", right: str = "right", few: int = FEW) -> DataFrame:
    """(id, component): the least id that is reachable, for each id that an edge names.

    Null ends and self-loops are ignored, repeated edges count once, and an empty table gives an
    empty one. Every round writes its edges to the shared folder; rounds grow with the logarithm
    of the largest component, and no step gathers anything on the driver but one count, and edges where there
    are few of them.
    """
    cur = written(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
    )
    if cur.count() <= few:
        made = written(cur.sparkSession.createDataFrame(_joined(cur.toArrow()), T.StructType([T.StructField("id", cur.schema["u"].dataType), T.StructField("component", cur.schema["u"].dataType)])))
        discard(cur)
        return made
    mark = None
    while True:
        nxt = written(_star(_star(cur, True), False))
        found = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        discard(cur)
        cur = nxt
        if (found.n, found.h) == mark:
            break
        mark = (found.n, found.h)
    members = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionAll(members.select(F.col("component").alias("id"), "component")).distinct()
