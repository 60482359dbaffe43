"""Substrings of a least number of bytes that occur more than once in a corpus, found exactly.

Every window of `length` bytes has an anchor: of its k-byte pieces the first one of the least hash. Neighbouring
windows mostly have the same anchor and make a run, some three for each window length. Equal windows have equal
anchors, at the same place within them; so a run whose bytes occur again repeats as a whole, one whose anchor stands
in no other bytes repeats nowhere, and only what is left, one run of each content, is compared window by window.
Rows are runs, not windows, throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmill.operators.intervals import cut_out, merge_intervals
from siltmill.session import spread, written

_BASE = np.uint64(0x100000001B3)


def _piece_hashes(data: bytes, k: int) -> np.ndarray:
    """A hash of each k-byte piece, by doubling."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(x) - k + 1
    out, done, power, width, base = np.zeros(n, np.uint64), 0, x, 1, _BASE
    while k:  # binary digits of k, each with the hash of that many bytes
        if k & 1:
            out = out * base + power[done : done + n]
            done += width
        power = power[: len(power) - width] * base + power[width:] if len(power) > width else power[:0]
        k, width, base = k >> 1, width * 2, np.uint64(int(base) ** 2 % (1 << 64))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash and place of the anchor, first window, one after the last) of each run of windows with one anchor."""
    k = max(1, length // 3)
    low = _piece_hashes(data, k)
    at = np.arange(len(low), dtype=np.int32)

    def less(i: int, j: int) -> None:
        """The sliding minimum of what stands i and j on; of equal ones the first."""
        nonlocal low, at
        n = len(low) - j
        later = low[j:] < low[i : i + n]
        low, at = np.where(later, low[j:], low[i : i + n]), np.where(later, at[j:], at[i : i + n])

    w, span = length - k + 1, 1
    while span * 2 <= w:
        less(0, span)
        span *= 2
    if w > span:
        less(0, w - span)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return low[first], at[first], first, np.append(first[1:], len(at))


#: More runs of one anchor than these are compared by joins, so that none is one task's work.
MANY = 5_000


def repeated_ranges(docs: DataFrame, length: int = 100, text: str = "text", index: str = "__INDEX__", many: int = MANY) -> DataFrame:
    """(index, first, last): ranges of starts, last excluded, of the windows of length bytes within a document whose
    bytes occur again. A document's ranges are disjoint.

    Windows of one document and of different ones count alike, and all occurrences are returned."""
    kind = docs.schema[index].dataType.simpleString()
    base = docs.select(F.col(index).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct run of a document; at has its windows, the first one's distance to the anchor, and its places."""
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py().encode()
                low, at, first, last = _runs(data, length)
                view = memoryview(data)
                c = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(first.tolist(), (last + (length - 1)).tolist())), np.uint64, len(first))
                order = np.lexsort((first, c, low))
                low, c, at, first, last = low[order], c[order], at[order], first[order], last[order]
                new = np.append(True, (low[1:] != low[:-1]) | (c[1:] != c[:-1]))
                one = np.flatnonzero(new)
                n = np.diff(np.append(one, len(new)))
                ends = np.cumsum(np.append(0, n + 2))
                flat = np.empty(ends[-1], np.int32)
                flat[ends[:-1]], flat[ends[:-1] + 1] = (last - first)[one], (at - first)[one]
                flat[np.arange(len(first)) + 2 * np.cumsum(new)] = first
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                ids = b.column(0).slice(i, 1).take(pa.array(np.zeros(len(one), np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(low[one].view(np.int64)), pa.array(c[one].view(np.int64)), lists], ["id", "anchor", "c", "at"])

    runs = spread(base).mapInArrow(find, f"id {kind}, anchor long, c long, at array<int>")
    # a row of a hundred bytes or so of text goes through one shuffle; its window is sorted and spills, whatever an anchor's count
    group = Window.partitionBy("anchor")
    before, after = (f("c").over(group.orderBy("c")) for f in (F.lag, F.lead))
    near = runs.withColumns({"before": before, "after": after}).withColumns({"least": F.min("c").over(group), "most": F.max("c").over(group)})
    whole = (F.size("at") > 3) | F.coalesce(F.col("before") == F.col("c"), F.lit(False)) | F.coalesce(F.col("after") == F.col("c"), F.lit(False))
    several = F.col("least") != F.col("most")
    chosen = several & (F.col("before").isNull() | (F.col("before") != F.col("c")))
    live = written(near.select("id", "anchor", "c", "at", whole.alias("whole"), chosen.alias("chosen"), several.alias("several")).where("whole OR several").drop("several"))

    chosen_of = live.where("chosen")
    ambiguous = chosen_of.groupBy("id").agg(F.collect_list(F.struct("anchor", "c", "whole", "at")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each chosen run."""
        for b in batches:
            for i in range(b.num_rows):
                data, rows = b.column(0)[i].as_py().encode(), b.column(1)[i].as_py()
                made = [(r["anchor"], r["c"], r["whole"], r["at"][0], r["at"][1], data[r["at"][2] : r["at"][2] + r["at"][0] + length - 1]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), _CUT.types)], schema=_CUT)

    pieces = base.join(ambiguous, "id").select("text", "runs").mapInArrow(cut, "anchor long, c long, whole boolean, n int, off int, data binary")
    crowded = chosen_of.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > many).select("anchor")
    hot = written(crowded)
    any_hot = bool(hot.head(1))
    if any_hot:
        pieces = written(pieces)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each run that doesn't repeat as a whole, which of its windows another run of its anchor has."""
        held, key = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != key and held:
                    yield from _compared(held, length)
                    held = []
                key = row[0]
                held.append(row)
        if held:
            yield from _compared(held, length)

    calm = pieces.join(hot, "anchor", "left_anti") if any_hot else pieces
    parts = calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "anchor long, c long, first int, last int")
    if any_hot:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for anchor, c, _, n, _, data in zip(*(x.to_pylist() for x in b.columns)):
                    h = [xxhash.xxh3_128_digest(data[s : s + length]) for s in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([anchor] * n), pa.array([c] * n), pa.array(range(n), pa.int32()), pa.array(h, pa.binary())], ["anchor", "c", "first", "h"])

        windows = written(pieces.join(hot, "anchor", "left_semi").mapInArrow(each, "anchor long, c long, first int, h binary"))
        often = windows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
        parts = parts.unionAll(windows.join(often, "h", "left_semi").select("anchor", "c", "first", (F.col("first") + 1).alias("last")))
    some = live.where("NOT whole").join(parts, ["anchor", "c"])
    all_ = live.where("whole").withColumns({"first": F.lit(0), "last": F.col("at")[0]})
    both = some.select("id", "at", "first", "last").unionAll(all_.select("id", "at", "first", "last"))
    placed = both.select("id", "first", "last", F.explode(F.slice("at", 3, F.size("at") - 2)).alias("place")).withColumn("place", F.col("place").cast("long"))
    return placed.select(F.col("id").alias(index), (F.col("place") + F.col("first")).alias("first"), (F.col("place") + F.col("last")).alias("last"))


_CUT = pa.schema([("anchor", pa.int64()), ("c", pa.int64()), ("whole", pa.bool_()), ("n", pa.int32()), ("off", pa.int32()), ("data", pa.binary())])
_PART = pa.schema([("anchor", pa.int64()), ("c", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _compared(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, c, first, last): the windows that several of the runs of an anchor have, for those that aren't whole."""
    if len(rows) < 2 or all(r[2] for r in rows):
        return
    # equal windows have the anchor at the same place, so none stands twice in a run
    keys = [[xxhash.xxh3_128_digest(data[s : s + length]) for s in range(n)] for _, _, _, n, _, data in rows]
    count = Counter(k for run in keys for k in run)
    out = []
    for (anchor, c, whole, *_), run in zip(rows, keys):
        if not whole:
            hit = np.diff(np.array([0, *(count[k] > 1 for k in run), 0], np.int8))
            out += [(anchor, c, x, y) for x, y in zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist())]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _PART.types)], schema=_PART)


def repeated_windows(docs: DataFrame, length: int = 100, text: str = "text", index: str = "__INDEX__") -> DataFrame:
    """(index, start): every window of length bytes within a document whose bytes occur again.

    Windows of one document and of different ones count alike, and all occurrences are returned."""
    ranges = repeated_ranges(docs, length, text, index)
    return ranges.select(index, F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("start"))


def repeated_spans(docs: DataFrame, length: int = 100, text: str = "text", index: str = "__INDEX__", strategy: str = "overlapping") -> DataFrame:
    """(index, start, stop): maximal runs of repeated windows ('overlapping'), or the windows themselves ('longest')."""
    if strategy == "overlapping":
        found = repeated_ranges(docs, length, text, index).select(index, F.col("first").alias("start"), (F.col("last") - 1 + length).alias("stop"))
    else:
        found = repeated_windows(docs, length, text, index).withColumn("stop", F.col("start") + length)
    return merge_intervals(found, [index], strategy)


def remove_repeats(docs: DataFrame, length: int = 100, text: str = "text", index: str = "__INDEX__") -> DataFrame:
    """docs with all repeated substrings cut out of the text; documents left empty, or null before, go."""
    spans = repeated_spans(docs, length, text, index).groupBy(F.col(index).alias("id_")).agg(F.collect_list(F.struct("start", "stop")).alias("spans_"))
    joined = docs.join(spans, docs[index] == F.col("id_"), "left")
    cut = joined.withColumn(text, F.when(F.col("spans_").isNull(), F.col(text)).otherwise(cut_out(text, "spans_")))
    return cut.where(F.length(text) > 0).drop("id_", "spans_")
