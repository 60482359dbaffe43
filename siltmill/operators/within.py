"""n-gram sets compared within clusters: best matches, and edges that hold near ones together.

A cluster's distinct sets are cut into blocks of bounded size, and each two blocks make a tile, which is one task's
work at most. So a large cluster is compared by many tasks, none of which holds more than two blocks, and a tile
returns a row for each set, not for each pair. Shared n-grams are counted by a product of matrices where many sets
have them, and by pairs where few do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmill.functions import text as T
from siltmill.session import spread, written

#: What a block holds: n-grams, and so many more for each set, so that there are at most BLOCK / EACH sets.
BLOCK, EACH = 1 << 19, 1 << 8


def hashed_sets(texts: DataFrame, n: int, min_length: int, flavour: str = "minhash") -> DataFrame:
    """(id, cluster, k, size, g) of a table (id, cluster, text): g is the text's n-gram set as sorted 64-bit hashes, k
    a 128-bit hash of g. A null text has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [T.word_runs(t, n, min_length, flavour) for t in part.column(2).to_pylist()]
                g = [np.sort(np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in s), np.uint64, len(s)).view(np.int64)) for s in sets]
                ends = np.cumsum([0, *map(len, g)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(g)))
                keys = pa.array([xxhash.xxh3_128_digest(x) for x in g], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), keys, pa.array(np.diff(ends)), lists], ["id", "cluster", "k", "size", "g"])

    kinds = dict(texts.dtypes)
    return spread(texts.select("id", "cluster", "text")).mapInArrow(run, f"id {kinds['id']}, cluster {kinds['cluster']}, k binary, size long, g array<long>")


def distinct_sets(sets: DataFrame) -> DataFrame:
    """(cluster, k, id, n, size): the least id and the number of members of each distinct set of a cluster."""
    return sets.groupBy("cluster", "k").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("size").alias("size"))


def _tiles(sets: DataFrame, one: DataFrame, threshold: float, block: int, *more: str) -> DataFrame:
    """(cluster, i, j, right, k, id, g, more columns of sets), the rows of a tile together; tiles of too different sizes are left out."""
    order = Window.partitionBy("cluster").orderBy("size", "k")
    filled = F.sum(F.col("size") + EACH).over(order.rowsBetween(Window.unboundedPreceding, 0))
    others = F.count("*").over(Window.partitionBy("cluster"))
    rows = one.where("cluster IS NOT NULL").withColumn("b", F.floor((filled - 1) / block)).withColumn("others", others).where("others > 1")
    rows = written(rows.select("cluster", "id", "k", "b", "size"))
    ranges = rows.groupBy("cluster", "b").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    x, y = ranges.alias("x"), ranges.alias("y")
    fit = F.col("x.most") >= F.col("y.least") * (threshold - 1e-9)
    met = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.b") <= F.col("y.b")) & fit)
    met = met.select(F.col("x.cluster").alias("cluster"), F.col("x.b").alias("i"), F.col("y.b").alias("j"))
    sides = met.select("cluster", F.col("i").alias("b"), F.struct("i", "j", F.lit(False).alias("right")).alias("t")).unionAll(met.where("i < j").select("cluster", F.col("j").alias("b"), F.struct("i", "j", F.lit(True).alias("right")).alias("t")))
    places = sides.groupBy("cluster", "b").agg(F.collect_list("t").alias("tiles"))
    placed = rows.join(places, ["cluster", "b"]).select("cluster", "k", "id", "tiles")
    each = sets.join(placed, ["cluster", "k", "id"]).select("cluster", F.explode("tiles").alias("t"), "k", "id", "g", *more).select("cluster", "t.*", "k", "id", "g", *more)
    return each.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "right")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first three columns, from rows sorted by these."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(c).to_pylist() for c in range(3))))
        if held and key != keys[0]:  # noqa: F821 - set with held
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for to in range(1, len(keys)):
            if keys[to] != keys[at]:
                yield pa.Table.from_batches([*held, b.slice(at, to - at)])
                held, at = [], to
        held.append(b.slice(at))
        key = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def shared(flat: np.ndarray, sizes: np.ndarray, left: int) -> np.ndarray:
    """How many values each of the first so many sets shares with each of the others; with each of all where left is all.

    flat holds the sets' values one set after another."""
    whole = left == len(sizes)
    na, nb = left, len(sizes) if whole else len(sizes) - left
    out = np.zeros((na, nb), np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64)
    if not len(flat):
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    f, o = flat[order], owner[order]
    starts = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
    freq = np.diff(np.append(starts, len(f)))
    fa = freq if whole else np.add.reduceat(o < left, starts)
    fb = freq if whole else freq - fa
    live = (freq > 1) & (fa > 0) & (fb > 0)
    if whole:
        out[np.arange(na), np.arange(na)] = sizes
    many = live & (fa * fb * 16 > na * nb)
    cols = np.flatnonzero(many)
    step = 1024
    for at in range(0, len(cols), step):
        some = cols[at : at + step]
        n = freq[some]
        col = np.repeat(np.arange(len(some)), n)
        row = o[np.repeat(starts[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        x = np.zeros((len(sizes), len(some)), out.dtype)
        x[row, col] = 1
        if whole:
            part = x @ x.T
            part[np.arange(na), np.arange(na)] = 0
            out += part
        else:
            out += x[:left] @ x[left:].T
    cols = np.flatnonzero(live & ~many)
    # each value of a few sets: the left ones stand before the right ones, as the order is stable
    work = np.cumsum(fa[cols] * fb[cols])
    at = 0
    while at < len(cols):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + (1 << 21), "right")))
        some = cols[at:to]
        a, b = fa[some], fb[some]
        n = a * b
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide, first = np.repeat(b, n), np.repeat(starts[some], n)
        x, y = o[first + k // wide], o[first + k % wide + (0 if whole else np.repeat(a, n))] - (0 if whole else left)
        if whole:
            x, y = x[x != y], y[x != y]
        out += np.bincount(x * nb + y, minlength=na * nb).reshape(na, nb)
        at = to
    return out


def _similar(t: pa.Table) -> tuple[np.ndarray, int]:
    """(similarities, how many rows are on the left); a set with itself has -1."""
    g = t.column("g").combine_chunks()
    g = g.chunk(0) if isinstance(g, pa.ChunkedArray) else g
    sizes = pc.list_value_length(g).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = t.column("i")[0] == t.column("j")[0]
    left = len(sizes) if whole else int(len(sizes) - pc.sum(t.column("right")).as_py())
    both = shared(g.flatten().to_numpy(zero_copy_only=False), sizes, left).astype(np.float64)
    union = sizes[:left, None] + (sizes if whole else sizes[left:])[None, :] - both
    out = np.divide(both, union, out=np.ones_like(both), where=union > 0)
    if whole:
        out[np.arange(left), np.arange(left)] = -1.0
    return out, left


def best_matches(sets: DataFrame, one: DataFrame, threshold: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(cluster, k, best): for each distinct set of a cluster its greatest Jaccard similarity to another one; below the
    threshold it may be less than that, or missing. Copies of a set aren't counted.

    sets is a written table of hashed_sets(), one its distinct_sets()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            j, left = _similar(t)
            best = j.max(1) if left == t.num_rows else np.concatenate([j.max(1), j.max(0)])
            for b in t.select(["cluster", "k"]).append_column("best", pa.array(best)).to_batches():
                yield b

    made = _tiles(sets, one, threshold, block).mapInArrow(run, f"cluster {dict(sets.dtypes)['cluster']}, k binary, best double")
    return made.groupBy("cluster", "k").agg(F.max("best").alias("best"))


def near_edges(sets: DataFrame, one: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(left, right): ids of distinct sets of a cluster, at most one edge for each set of a tile, that join what pairs of
    a similarity from the threshold on join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            j, left = _similar(t)
            near = j >= threshold
            if left < t.num_rows:  # as one square matrix
                n = t.num_rows
                square = np.zeros((n, n), bool)
                square[:left, left:], square[left:, :left] = near, near.T
                near = square
            root = _roots(near)
            some = np.flatnonzero(root != np.arange(len(root)))
            if len(some):
                ids = t.column("id").combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(root[some])), ids.take(pa.array(some))], ["left", "right"])

    kind = dict(sets.dtypes)["id"]
    return _tiles(sets, one, threshold, block).mapInArrow(run, f"left {kind}, right {kind}")


def pairs(sets: DataFrame, threshold: float, meet: Callable[[np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(left, right, jaccard), left < right: all pairs of members of a cluster whose sets have such a similarity at least
    and that meet. Similarities are found once for two sets, and their members paired where they are found.

    sets: (cluster, k, id, n, size, g, s, ids), written, a row for each distinct set with its members' ids. meet makes a
    matrix of keys from that of the sets' s; two sets meet where they agree in a column."""
    kind = dict(sets.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            j, left = _similar(t)
            whole = left == t.num_rows
            keys = meet(np.array(t.column("s").to_pylist(), np.int64))
            met = np.zeros(j.shape, bool)
            for c in range(keys.shape[1]):
                met |= keys[:left, c, None] == keys[None, 0 if whole else left :, c]
            met &= j >= threshold
            x, y = np.nonzero(np.triu(met, 1) if whole else met)
            yield from _members_paired(t.column("ids"), x, y if whole else y + left, j[x, y])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = pa.chunked_array([b.column(0).slice(i, 1).flatten()])
                for at in range(len(ids)):  # each member with the later ones
                    n = len(ids) - at - 1
                    if n:
                        yield _ordered(ids.take(pa.array(np.full(n, at))), ids.slice(at + 1), np.ones(n))

    out = f"left {kind}, right {kind}, jaccard double"
    apart = _tiles(sets, sets.select("cluster", "k", "id", "n", "size"), threshold, block, "s", "ids").mapInArrow(run, out)
    return apart.unionAll(sets.where("n > 1").select("ids").mapInArrow(same, out)) if threshold <= 1 else apart


def _ordered(a: pa.ChunkedArray, b: pa.ChunkedArray, similar: np.ndarray) -> pa.RecordBatch:
    later = pc.less(b, a)
    one = lambda x: (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)
    return pa.RecordBatch.from_arrays([one(pc.if_else(later, b, a)), one(pc.if_else(later, a, b)), pa.array(similar)], ["left", "right", "jaccard"])


#: Pairs of members in a batch, if one set's members are no more.
_PAIRS = 1 << 16


def _members_paired(lists: pa.ChunkedArray, x: np.ndarray, y: np.ndarray, similar: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All members of the sets x with those of the sets y, in batches of bounded size."""
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    start, ids = np.cumsum(n) - n, pc.list_flatten(lists)
    # a member of x with all of y is a row, and rows are cut by how many pairs they are
    first = np.repeat(start[x], n[x]) + np.arange(n[x].sum()) - np.repeat(np.cumsum(n[x]) - n[x], n[x])
    of = np.repeat(np.arange(len(x)), n[x])
    done = np.cumsum(n[y[of]])
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + _PAIRS, "right")))
        width = n[y[of[at:to]]]
        a = np.repeat(first[at:to], width)
        b = np.repeat(start[y[of[at:to]]], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        yield _ordered(ids.take(pa.array(a)), ids.take(pa.array(b)), np.repeat(similar[of[at:to]], width))
        at = to


def _roots(near: np.ndarray) -> np.ndarray:
    """The first row that each row is linked with, through others too."""
    n = len(near)
    root, left = np.arange(n), np.ones(n, bool)
    for s in range(n):
        if left[s]:
            left[s] = False
            front = np.array([s])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & left)
                left[front] = False
                root[front] = s
    return root


def copy_edges(sets: DataFrame, one: DataFrame) -> DataFrame:
    """(left, right): the least id of each distinct set of a cluster to its other members."""
    first = one.where("n > 1").select("cluster", "k", F.col("id").alias("left"))
    return sets.select("cluster", "k", "id").join(first, ["cluster", "k"]).where("id != left").select("left", F.col("id").alias("right"))


def compared(texts: DataFrame, n: int, min_length: int, flavour: str = "minhash") -> tuple[DataFrame, DataFrame]:
    """(sets, one), both written, for the functions above."""
    sets = written(hashed_sets(texts, n, min_length, flavour))
    return sets, written(distinct_sets(sets))
