"""Segment each distinct chunk of text once, and join the answers back to the documents.

A block is some 32 MB of consecutive texts of one input task. It is coded against its own table of
distinct chunks, whose codes are small where chunks are frequent; so a document is a short run of numbers.
The block sends its distinct chunks to hash buckets, one row for each bucket. In a bucket, equal
chunks of all blocks meet, each is answered once, and the answers go back to the blocks. Two
shuffles, both of packed rows: the chunk requests and the coded documents; never one row a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.llm.text import Codes

#: Hash buckets for distinct chunks, one for BUCKET_INPUT bytes of input within these bounds: as many tasks can share the
#: segmenting. A block sends a row to each bucket, so that more of them would make rows of single words.
BUCKETS, MOST_BUCKETS = 1024, 8192
BUCKET_INPUT = 64 << 20
#: Bytes of chunks and answers that a task remembers of a bucket. A chunk that comes after they were let go is segmented again.
MEMO_BYTES = 256 << 20
BLOCK_CHARS = 1 << 25
#: Documents in a row of packed ones.
TOGETHER = 64
NAMES = ["kind", "route", "block", "seq", "ids", "data"]

_squeeze = zstandard.ZstdCompressor(level=1).compress
_expand = zstandard.ZstdDecompressor().decompress


def _frames(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2**32 + 255: one byte each, where 255 says that four byte planes hold the rest."""
    rest = (x[x >= 255] - 255).astype(np.uint32)
    planes = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 4).T)
    return _frames([_squeeze(np.minimum(x, 255).astype(np.uint8).tobytes()), *(_squeeze(p.tobytes()) for p in planes)])


def unpack_numbers(data: bytes) -> np.ndarray:
    small, *planes = (np.frombuffer(_expand(p), np.uint8) for p in _split(data))
    x = small.astype(np.int64)
    if len(planes[0]):
        rest = np.ascontiguousarray(np.stack(planes).T).view(np.uint32).ravel()
        x[x == 255] += rest
    return x


def pack_sequences(docs: list[np.ndarray | None], single: int) -> bytes:
    """Some documents' codes in order; None stays apart from a document without chunks.

    Codes from single on occur once in their block, and are numbered as they come; so they are all
    written as 0, beside the first of them."""
    lens = np.array([0 if d is None else len(d) + 1 for d in docs], np.int64)
    codes = np.concatenate([d for d in docs if d is not None] or [lens[:0]])
    alone = codes >= single
    first = codes[alone][:1]
    return _frames([pack_numbers(lens), pack_numbers(np.where(alone, 0, codes + 1)), pack_numbers(first)])


def unpack_sequences(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which documents are null, their lengths, the codes of all)."""
    null, lens, (codes, first) = unpack(data)
    alone = codes == 0
    codes = codes - 1
    if len(first):
        codes[alone] = first[0] + np.arange(int(alone.sum()))
    return null, lens, codes


def pack_counts(docs: list[np.ndarray | None], single: int) -> bytes:
    """Some documents' distinct codes, as steps, and how often each occurs."""
    lens, keys, counts = [], [], []
    for d in docs:
        if d is None:
            lens.append(0)
            continue
        k, c = np.unique(d, return_counts=True)
        lens.append(len(k) + 1)
        keys.append(np.diff(k, prepend=0))
        counts.append(c)
    empty = [np.empty(0, np.int64)]
    return _frames([pack_numbers(np.array(lens, np.int64)), pack_numbers(np.concatenate(keys or empty)), pack_numbers(np.concatenate(counts or empty))])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(which documents are null, their lengths, the packed numbers of all)."""
    lens, *numbers = map(unpack_numbers, _split(data))
    return lens == 0, np.maximum(lens - 1, 0), numbers


def _requests(chunks: list[str], ranks: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob of ranks and chunks) for the buckets that occur."""
    order = np.lexsort((ranks, buckets))
    ends = np.flatnonzero(np.diff(buckets[order], append=-1)) + 1
    at = 0
    for end in ends.tolist():
        which = order[at:end]
        texts = [chunks[i].encode() for i in which.tolist()]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        yield int(buckets[which[0]]), _frames([pack_numbers(np.diff(ranks[which], prepend=0)), pack_numbers(lens), _squeeze(b"".join(texts))])
        at = end


def _asked(data: bytes) -> tuple[bytes, list[bytes]]:
    """The ranks, as they were packed, and the chunks."""
    ranks, lens, texts = _split(data)
    texts = _expand(texts)
    ends = np.cumsum(unpack_numbers(lens)).tolist()
    return ranks, [texts[a:b] for a, b in zip([0, *ends], ends)]


def _answered(ranks: bytes, answers: list[bytes], width: int) -> bytes:
    lens = np.fromiter(map(len, answers), np.int64, len(answers)) // width
    planes = np.ascontiguousarray(np.frombuffer(b"".join(answers), np.uint8).reshape(-1, width).T)
    return _frames([ranks, pack_numbers(lens), *(_squeeze(p.tobytes()) for p in planes)])


def bucket_count(docs: DataFrame) -> int:
    """Hash buckets by the planner's estimate of the input; results don't depend on it."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(estimate // BUCKET_INPUT, BUCKETS), MOST_BUCKETS)


class Memo(dict[bytes, bytes]):
    """Answers by chunk, emptied before they outgrow MEMO_BYTES."""

    held = 0

    def answers(self, chunks: list[bytes], solve: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The answers to distinct chunks, in order. What isn't known is asked all at once."""
        new = [c for c in chunks if c not in self]
        found = dict(zip(new, solve([c.decode() for c in new]))) if new else {}
        out = [found[c] if c in found else self[c] for c in chunks]
        size = sum(len(c) + len(a) + 150 for c, a in found.items())
        if self.held + size > MEMO_BYTES:
            self.clear()
            self.held = 0
        if size <= MEMO_BYTES:
            self.update(found)
            self.held += size
        return out


class Table:
    """A block's answers by code: the numbers data[start[c] : start[c] + size[c]]."""

    def __init__(self, blobs: list[bytes], dtype: type):
        ranks, sizes, parts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, dtype)]
        for blob in blobs:
            rank, size, *planes = _split(blob)
            ranks.append(np.cumsum(unpack_numbers(rank)))
            sizes.append(unpack_numbers(size))
            parts.append(np.ascontiguousarray(np.stack([np.frombuffer(_expand(p), np.uint8) for p in planes]).T).view(dtype).ravel())
        rank, size = np.concatenate(ranks), np.concatenate(sizes)
        self.data = np.concatenate(parts)
        self.start, self.size = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        self.start[rank] = np.cumsum(size) - size
        self.size[rank] = size


def chunk_join(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    split: Callable[[str], list[str]],
    solve: Callable[[list[str]], list[bytes]],
    pack: Callable[[list[np.ndarray | None], int], bytes],
    finish: Callable[[Table], Callable[[bytes], list[pa.Array]]],
    out: list[tuple[str, str]],
    dtype: type,
) -> DataFrame:
    """(id, out columns) for each row of docs.

    split cuts a text into chunks, solve answers distinct chunks with numbers of dtype, as bytes, pack
    codes some documents, and finish makes a block's table into a function from packed documents to
    output columns. A null text stays apart from one without chunks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"kind int, route long, block long, seq long, ids array<{kind}>, data binary"
    width = np.dtype(dtype).itemsize
    asked_docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spread = bucket_count(asked_docs)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, seq = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        codes, chars = Codes(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, seq
            block = task << 32 | number
            number += 1
            freq = np.bincount(np.concatenate([a for _, a, _ in held]), minlength=len(codes)) if len(codes) else np.empty(0, np.int64)
            rank = np.empty(len(codes), np.int64)
            rank[np.argsort(-freq, kind="stable")] = np.arange(len(codes))
            single = int((freq > 1).sum())
            chunks = list(codes)
            buckets = np.fromiter((crc32(c.encode()) for c in chunks), np.int64, len(chunks)) % spread
            rows = list(_requests(chunks, rank, buckets))
            if rows:
                n = len(rows)
                b = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), b, pa.array(np.full(n, block)), b, pa.nulls(n, pa.list_(id_type)), pa.array([r[1] for r in rows], pa.binary())], NAMES
                )
            for ids, all_codes, counts in held:
                ranked = rank[all_codes]
                docs, at = [], 0
                for count in counts.tolist():
                    docs.append(None if count < 0 else ranked[at : at + count])
                    at += max(count, 0)
                cuts = [*range(0, len(docs), TOGETHER), len(docs)]
                n = len(cuts) - 1
                seqs = np.arange(seq, seq + n)
                seq += n
                data = [pack(docs[a:b], single) for a, b in zip(cuts, cuts[1:])]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, 2, np.int32)), pa.array((task * 7919 + seqs) % spread), pa.array(np.full(n, block)), pa.array(seqs), lists, pa.array(data, pa.binary())], NAMES
                )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = batch.column(1).to_pylist()
            parts, counts = [], np.empty(len(texts), np.int64)
            for i, text in enumerate(texts):
                if text is None:
                    counts[i] = -1
                    continue
                part = codes.of(split(text))
                parts.append(part)
                counts[i] = len(part)
                chars += len(text)
            held.append((batch.column(0), np.concatenate(parts) if parts else np.empty(0, np.int64), counts))
            if chars >= BLOCK_CHARS:
                yield from flush()
                held, chars = [], 0
                codes = Codes()
        if held:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, now = Memo(), -1
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds == 2).any():
                yield batch.filter(pa.array(kinds == 2))
            asked = batch.filter(pa.array(kinds == 0))
            if not asked.num_rows:
                continue
            data = []
            for route, blob in zip(asked.column(1).to_pylist(), asked.column(5).to_pylist()):
                if route != now:
                    memo, now = Memo(), route
                ranks, chunks = _asked(blob)
                data.append(_answered(ranks, memo.answers(chunks, solve), width))
            yield pa.RecordBatch.from_arrays([*asked.columns[:5], pa.array(data, pa.binary())], NAMES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, apply = None, [], None
        for batch in batches:
            kinds, blocks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != now:
                    now, blobs, apply = blocks[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    blobs += part.column(5).to_pylist()
                    continue
                if apply is None:
                    apply, blobs = finish(Table(blobs, dtype)), []
                for i in range(part.num_rows):
                    ids = part.column(4).slice(i, 1).flatten()
                    yield pa.RecordBatch.from_arrays([ids, *apply(part.column(5)[i].as_py())], [id_col, *(n for n, _ in out)])

    coded = asked_docs.mapInArrow(code, schema)
    met = coded.repartition("route").sortWithinPartitions("route", "kind").mapInArrow(answer, schema)
    home = met.repartition("block").sortWithinPartitions("block", "kind", "seq")
    return home.mapInArrow(merge, f"`{id_col}` {kind}, " + ", ".join(f"`{n}` {t}" for n, t in out))
