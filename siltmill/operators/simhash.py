"""SimHash: signatures, near pairs by blocks, clusters, verification, removal."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmill.functions import hashing, text as T
from siltmill.operators import within
from siltmill.operators.graph import connected_components
from siltmill.operators.unionfind import UnionFind
from siltmill.session import spread, written


@dataclass(frozen=True)
class SimHash:
    """Parameters. f is 64 or 128; more blocks than bit_diff are needed."""

    ngram: int = 3
    f: int = 64
    bit_diff: int = 3
    num_bucket: int = 4
    min_length: int = 5
    hash_func: str = "xxh3"
    jaccard_threshold: float = 0.5
    text_column: str = "text"
    index_column: str = "__INDEX__"
    cluster_column: str = "__CLUSTER__"

    def __post_init__(self):
        if self.f not in (64, 128):
            raise ValueError("f is 64 or 128")
        if self.num_bucket <= self.bit_diff:
            raise ValueError("there must be more buckets than bits that may differ")


def grams(c: SimHash) -> Column:
    return T.ngram_set(c.text_column, c.ngram, c.min_length, "simhash")


def signatures(df: DataFrame, c: SimHash) -> DataFrame:
    """(id, hi, lo): the bits that more than half of the n-grams' hashes set; zero for no n-grams.

    hi is 0 where f is 64. A null text has no row.
    """
    one, width = hashing.hash_text(c.hash_func, c.f), c.f // 8
    many = hashing.hash_texts(c.hash_func, c.f) if c.f <= 64 else None

    n, least = c.ngram, c.min_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                yield sign(whole.slice(at, 500))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(batch.column(1).is_valid())
        ids, col = batch.columns
        sets = [T.word_runs(t, n, least, "simhash") for t in col.to_pylist()]
        count = np.fromiter(map(len, sets), np.int64, len(sets))
        each = (x.encode() for g in sets for x in g)
        raw = many(each).astype(">u8").tobytes() if many else b"".join([one(x).to_bytes(width, "big") for x in each])
        bytes_ = np.frombuffer(raw, np.uint8).reshape(-1, width)
        out = np.zeros((len(col), width), np.uint8)
        ends = np.cumsum(count)
        for i in np.flatnonzero(count).tolist():
            ones = np.unpackbits(bytes_[ends[i] - count[i] : ends[i]], axis=1).sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > count[i])
        halves = out.view(">i8").astype(np.int64)
        hi = halves[:, 0].copy() if width == 16 else np.zeros(len(col), np.int64)
        return pa.RecordBatch.from_arrays([ids, pa.array(hi), pa.array(halves[:, -1].copy())], ["id", "hi", "lo"])

    kind = df.schema[c.index_column].dataType.simpleString()
    made = df.select(F.col(c.index_column).alias("id"), F.col(c.text_column).alias("text"))
    return spread(made).mapInArrow(run, f"id {kind}, hi long, lo long")


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63 & 1)


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.hi").bitwiseXOR(F.col(f"{b}.hi"))) + F.bit_count(F.col(f"{a}.lo").bitwiseXOR(F.col(f"{b}.lo")))


def near_signatures(distinct: DataFrame, c: SimHash) -> DataFrame:
    """(left, right, distance): near pairs of a table (id, hi, lo) of distinct signatures, by id."""
    masks = [(i, _signed(m >> 64), _signed(m & (1 << 64) - 1)) for i, m in enumerate(hashing.block_keys(c.f, c.num_bucket, c.bit_diff))]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("hi").bitwiseAND(F.lit(h)).alias("kh"), F.col("lo").bitwiseAND(F.lit(lo)).alias("kl")) for i, h, lo in masks]))
    rows = distinct.select("id", "hi", "lo", keys.alias("k")).select("id", "hi", "lo", "k.*")
    pairs = rows.alias("a").join(rows.alias("b"), ["t", "kh", "kl"]).where(F.col("a.id") < F.col("b.id"))
    near = pairs.where(distance("a", "b") <= c.bit_diff)
    return near.select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), distance("a", "b").cast("long").alias("distance")).distinct()


def edges(sigs: DataFrame, c: SimHash) -> DataFrame:
    """(left, right): each signature's least document to its others, and to those of near signatures."""
    least = sigs.groupBy("hi", "lo").agg(F.min("id").alias("first"))
    same = sigs.join(least, ["hi", "lo"]).where("id != first").select(F.col("first").alias("left"), F.col("id").alias("right"))
    return same.unionAll(near_signatures(least.withColumnRenamed("first", "id"), c).select("left", "right"))


def near_pairs(df: DataFrame, c: SimHash) -> DataFrame:
    """(left, right, distance): all pairs of documents within bit_diff, left < right."""
    sigs = written(signatures(df, c))
    least = sigs.groupBy("hi", "lo").agg(F.min("id").alias("id"))
    owner = sigs.withColumnRenamed("id", "doc").join(least, ["hi", "lo"]).select("id", "doc")
    reps = near_signatures(least, c).unionAll(least.select("id", "id", F.lit(0).cast("long")))
    both = reps.join(owner.toDF("left", "a"), "left").join(owner.toDF("right", "b"), "right")
    return both.where((F.col("left") != F.col("right")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "distance")


def clusters(df: DataFrame, c: SimHash, roots: str = "least") -> DataFrame:
    """(id, cluster) of every document that isn't its cluster's root.

    roots: 'least' takes the least id; 'replay' the root that union by rank gives when documents come in
    order of their ids and meet earlier ones bucket by bucket. Both give the same clusters.
    """
    sigs = written(signatures(df, c))
    found = connected_components(edges(sigs, c))
    if roots == "replay":
        found = found.join(sigs, "id").groupBy("component").applyInPandas(_replay(c), "id long, component long")
    return found.where("id != component").select("id", F.col("component").alias("cluster"))


def _replay(c: SimHash):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        widths = hashing.block_widths(c.f, c.num_bucket)
        ends = list(itertools.accumulate(widths))
        each = [((1 << w) - 1) << (c.f - e) for w, e in zip(widths, ends)]
        masks = [sum(each[i] for i in p) for p in itertools.permutations(range(c.num_bucket), c.num_bucket - c.bit_diff)]
        forest, buckets = UnionFind(), {}
        group = group.sort_values("id")
        for doc, hi, lo in zip(group.id.tolist(), group.hi.tolist(), group.lo.tolist()):
            sig = (hi % (1 << 64)) << 64 | lo % (1 << 64)
            for mask in masks:
                # documents of one signature are one set once they have met, so the first stands for them
                bucket = buckets.setdefault((mask, sig & mask), {})
                for other_sig, other in bucket.items():
                    if other != doc and (sig ^ other_sig).bit_count() <= c.bit_diff:
                        forest.union(doc, other)
                bucket.setdefault(sig, doc)
        return pd.DataFrame([(x, forest.find(x)) for x in group.id.tolist()], columns=["id", "component"])

    return run


def assign(df: DataFrame, found: DataFrame, c: SimHash) -> DataFrame:
    """df with the cluster, its own index for roots and others, and a flag on those that aren't roots; columns of other names stay."""
    own = found.select(F.col("id").alias(c.index_column), F.col("cluster").alias("__found__"))
    joined = df.drop(c.cluster_column).join(own, c.index_column, "left")
    return joined.withColumn(c.cluster_column, F.coalesce("__found__", c.index_column)).withColumn("__duplicate__", F.col("__found__").isNotNull()).drop("__found__")


def _candidates(found: DataFrame, with_root: bool) -> DataFrame:
    return found.unionAll(found.select("cluster", "cluster").distinct()) if with_root else found


def verification_report(df: DataFrame, found: DataFrame, c: SimHash, with_root: bool = True) -> DataFrame:
    """One row: clusters, candidate_pairs, false_positives, true_positives, true_clusters.

    False positives are the flagged documents that verification leaves in no cluster or makes a root.
    """
    n = _candidates(found, with_root).groupBy("cluster").agg(F.count("*").alias("n"))
    before = n.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("candidate_pairs"))
    flagged = found.agg(F.count("*").alias("flagged"))
    after = verified(df, found, c, with_root).agg(F.count("*").alias("true_positives"), F.countDistinct("cluster").alias("true_clusters"))
    both = before.crossJoin(flagged).crossJoin(after)  # one row each
    return both.select("clusters", "candidate_pairs", (F.col("flagged") - F.col("true_positives")).alias("false_positives"), "true_positives", "true_clusters")


def verified(df: DataFrame, found: DataFrame, c: SimHash, with_root: bool = True) -> DataFrame:
    """(id, cluster) after comparing n-gram sets within clusters, without roots.

    with_root: the root takes part, so that a cluster of two can hold; without, only flagged documents
    are compared. Components are those of the pairs that pass.
    """
    texts = df.select(F.col(c.index_column).alias("id"), F.col(c.text_column).alias("text")).join(_candidates(found, with_root), "id")
    sets, one = within.compared(texts, c.ngram, c.min_length, "simhash")
    near = within.near_edges(sets, one, c.jaccard_threshold)
    if c.jaccard_threshold <= 1:
        near = near.unionAll(within.copy_edges(sets, one))
    return connected_components(near).where("id != component").select("id", F.col("component").alias("cluster"))


def remove(df: DataFrame) -> DataFrame:
    """The rows that carry no flag."""
    return df.where(~F.col("__duplicate__"))
