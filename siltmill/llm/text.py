"""Text helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts that are written without spaces; each of their characters counts as a word.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
M64 = (1 << 64) - 1


def words(text: str) -> list[str]:
    """Words between white space; characters of scripts without spaces stand alone."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.split()


def slices(col: pa.Array, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts of an array, some at a time, of about so many bytes; each is whole."""
    for b in pieces(iter([pa.RecordBatch.from_arrays([col], ["t"])]), 0, size):
        yield b.column(0).to_pylist()


def count_words(text: Column) -> Column:
    """How many words() a text has; null for a null one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array([None if t is None else len(words(t)) for part in slices(col) for t in part], pa.int64())

    return F.arrow_udf(run, "long")(text)


class Codes(dict):
    """Codes 0, 1, 2, ... in order of first sight."""

    def __missing__(self, key):
        code = self[key] = len(self)
        return code

    def of(self, items: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.int64, len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer on an unsigned array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lens[i] - 1 for all i, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def pieces(batches: Iterator[pa.RecordBatch], text: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one hold about so many bytes; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        offs = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + chars)))
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
