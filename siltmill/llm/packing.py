"""Best-fit packing with Martello and Toth's dominance reduction, over the histogram of lengths.

Documents longer than the capacity are cut into full pieces and a rest. What the driver sees is one
count for each length, so its work is bounded by the capacity, whatever the number of
documents. There the reduction fixes sets that dominate all others that hold the same longest
piece; the rest is packed best-fit, longest first. Bins of the same content form ranges of ids, so
the plan is a list of ranges, and each piece finds its bin by its rank among those of its length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmill.session import written

#: Pieces of one length are ranked in buckets of about so many, whose number follows the length's count.
RANKED = 1 << 20


class Items:
    """A multiset of lengths with counts, in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.keys = sorted(self.n)

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect.bisect_left(self.keys, length))

    def smallest(self, count: int) -> list[int]:
        out: list[int] = []
        for k in self.keys:
            out += [k] * min(self.n[k], count - len(out))
            if len(out) == count:
                break
        return out

    def at_most(self, limit: int) -> int | None:
        at = bisect.bisect_right(self.keys, limit)
        return self.keys[at - 1] if at else None

    def between(self, low: int, high: int) -> int:
        """How many items are longer than low and shorter than high."""
        a, b = bisect.bisect_right(self.keys, low), bisect.bisect_left(self.keys, high)
        return sum(self.n[k] for k in self.keys[a:b])

    def pair(self, limit: int) -> tuple[int, int] | None:
        """Two items of the largest sum within the limit, the longer first."""
        best, i, j = None, 0, bisect.bisect_right(self.keys, limit) - 1
        while i <= j:
            a, b = self.keys[i], self.keys[j]
            if a + b > limit:
                j -= 1
                continue
            if i < j or self.n[a] > 1:
                if best is None or a + b > sum(best):
                    best = (b, a)
            i += 1
        return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix dominating sets: ((lengths, how often) in order, the counts that are left).

    For the longest piece j that is not settled, with k the number of the smallest others that fit
    beside it: k = 0 fixes {j}. The longest fitting partner p gives {j, p} where k = 1, where the two
    fill the bin, or where k = 2 and p is at least as long as the best fitting pair (a, b) together.
    With k = 2 and p = a, {j, a, b} is fixed where no triple can beat it: at most one piece lies
    between a and b, or the two pieces just longer than b don't fit beside j. Otherwise j waits.
    """
    left, waiting, fixed = Items(counts), {}, []
    while left.keys or waiting:
        if not left.keys:
            break
        j = left.keys[-1]
        # the candidates beside j are all others that are not in a fixed set, waiting ones too
        left.take(j, 1)
        others = Items({k: left.n.get(k, 0) + waiting.get(k, 0) for k in {*left.n, *waiting}}) if waiting else left
        small, k, room = others.smallest(3), 0, capacity - j
        while k < len(small) and sum(small[: k + 1]) <= room:
            k += 1
        found: tuple[int, ...] | None = None
        if k == 0:
            found = (j,)
        else:
            p = others.at_most(room)
            if k == 1 or p == room:
                found = (j, p)
            elif k == 2:
                a, b = others.pair(room)
                if p >= a + b:
                    found = (j, p)
                elif p == a and (others.between(b, a) <= 1 or _over(others, b, room)):
                    found = (j, a, b)
        left_j = left.n.get(j, 0) + 1
        if found is None:
            if left_j > 1:
                left.take(j, left_j - 1)
            waiting[j] = waiting.get(j, 0) + left_j
            continue
        # a set is fixed as often as its members last; removing them only makes the others fewer
        times = left_j
        if len(found) == 2:
            p = found[1]
            have = left.n.get(p, 0) + waiting.get(p, 0) + (p == j)
            times = min(left_j, have // 2 if p == j else have)
        elif len(found) == 3:
            # nothing else changes while all three last: the best partners stay the best, those that are too
            # long together get longer, and no piece comes between
            have = {x: left.n.get(x, 0) + waiting.get(x, 0) + (x == j) for x in found}
            times = min(left_j, *(have[x] // found.count(x) for x in found))
        left.n[j] = left_j  # put the one taken back, then take all
        if j not in left.keys:
            left.keys.append(j)
        for length in found:
            _draw(left, waiting, length, times)
        fixed.append((found, times))
    return fixed, waiting


def _over(items: Items, b: int, room: int) -> bool:
    """Whether the two pieces just longer than b are too long together."""
    at, above = bisect.bisect_right(items.keys, b), []
    for k in items.keys[at:]:
        above += [k] * min(items.n[k], 2 - len(above))
        if len(above) == 2:
            return sum(above) > room
    return True


def _draw(left: Items, waiting: dict[int, int], length: int, count: int) -> None:
    """Take from the unsettled ones first, then from those that wait."""
    now = min(count, left.n.get(length, 0))
    if now:
        left.take(length, now)
    if count > now:
        waiting[length] -= count - now
        if not waiting[length]:
            del waiting[length]


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], dict]:
    """Ranges (length, first rank, count, first bin, offset in the bin), and what was done.

    The r-th piece of a length lies in the range that holds its rank, in bin first bin + r - first rank.
    """
    ranks: dict[int, int] = {}
    ranges, bins = [], 0

    def place(length: int, count: int, first_bin: int, offset: int) -> None:
        at = ranks.get(length, 0)
        ranges.append((length, at, count, first_bin, offset))
        ranks[length] = at + count

    fixed, rest = reduce_instance(counts, capacity)
    fixed_bins = 0
    for lengths, times in fixed:
        offset = 0
        for length in lengths:
            place(length, times, bins, offset)
            offset += length
        bins += times
    fixed_bins = bins
    rooms: list[int] = []  # the rooms that open bins have, in order
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, count)

    def opened(room: int, first: int, count: int) -> None:
        if room:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append((first, count))

    for length in sorted(rest, reverse=True):
        todo = rest[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, todo)
                full = todo // each
                first = bins
                bins += full
                for i in range(each):
                    place(length, full, first, i * length)
                opened(capacity - each * length, first, full)
                todo -= each * full
                continue
            room = rooms[at]
            first, count = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            now = min(count, todo)
            place(length, now, first, capacity - room)
            opened(room - length, first, now)
            if count > now:
                opened(room, first + now, count - now)
            todo -= now
    return ranges, {"bins": bins, "fixed_bins": fixed_bins, "fixed_sets": len(fixed)}


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", length=None, text_col: str = "text", ranked: int = RANKED) -> DataFrame:
    """(bin_id, start, id, piece, piece_start, length): each document's pieces and where they lie.

    length is a column of lengths, by default the text's number of runs without white space;
    text.count_words counts characters of scripts without spaces singly. A null or non-positive
    length (as of a null or empty text) takes part in no bin and gives no row; longer documents than
    the capacity are cut into whole bins and a rest. Rows that repeat an id are packed like any
    others; ties among equal lengths go by the id's hash, the id and the piece. A null id is packed
    too. An empty table gives an empty one, and other columns are left out whatever their names.
    """
    spark = docs.sparkSession
    size = (F.regexp_count(F.col(text_col), F.lit(r"\S+")) if length is None else length).cast("long")
    whole = docs.select(F.col(id_col).alias("id"), size.alias("size")).where(F.col("size") > 0)
    cut = whole.select(
        "id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {capacity}L"))).alias("piece", "k"), "size"
    )
    cut = written(
        cut.select(
            "id",
            "piece",
            F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("k") * capacity).cast("int").alias("length"),
            F.xxhash64("id", "piece").alias("h"),
        )
    )
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    ranges, _ = plan_bins(counts, capacity)
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(table)  # bounded by the capacity, not by the data
    buckets = F.array(*[F.lit(-(-counts.get(k, 1) // ranked)).cast("long") for k in range(1, capacity + 1)])
    keyed = cut.select("id", "piece", "length", F.pmod("h", buckets[F.col("length") - 1]).alias("bucket"))
    # ranks within a bucket, and the pieces of one length in the buckets before it
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = keyed.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(offsets, ["length", "bucket"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        step = int(table[:, 1].max()) + 1 if len(table) else 1
        keys = table[:, 0] * step + table[:, 1]
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            row = table[np.searchsorted(keys, length.astype(np.int64) * step + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row[:, 3] + rank - row[:, 1]),
                    pa.array(row[:, 4]),
                    b.column(0),
                    b.column(1),
                    pa.array(b.column(1).to_numpy().astype(np.int64) * capacity),
                    pa.array(length.astype(np.int64)),
                ],
                ["bin_id", "start", id_col, "piece", "piece_start", "length"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    made = placed.select("id", "piece", "length", (F.col("rank") + F.col("offset")).alias("rank"))
    return made.mapInArrow(assign, f"bin_id long, start long, `{id_col}` {kind}, piece int, piece_start long, length long")
