"""Hashes, permutations, LSH parameters, and bits."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each width of hash values: the modulus and the largest value that is kept.
RINGS = {64: ((1 << 61) - 1, (1 << 32) - 1), 32: ((1 << 32) - 5, (1 << 32) - 1), 16: ((1 << 16) - 15, (1 << 16) - 1)}
_DTYPES = {64: np.uint64, 32: np.uint32, 16: np.uint16}


def sha1_u32(data: Column | str) -> Column:
    """The first 4 bytes of SHA-1, little-endian, as a long."""
    hex_ = F.sha1(data)
    swapped = F.concat(*[F.substring(hex_, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")


def sha1_bits(data: bytes, bits: int = 32) -> int:
    """The first bits of SHA-1, little-endian, as a number of any width."""
    return int.from_bytes(hashlib.sha1(data, usedforsecurity=False).digest()[: bits // 8], "little")


def xxh3_bits(data: bytes, seed: int = 0, bits: int = 32) -> int:
    """XXH3: the low half of 64 bits, 64, 128, or the head of the unseeded 128-bit digest, big-endian."""
    if bits == 128:
        return xxhash.xxh3_128_intdigest(data, seed)
    if bits in (32, 64):
        return xxhash.xxh3_64_intdigest(data, seed) & ((1 << bits) - 1)
    return int.from_bytes(xxhash.xxh3_128_digest(data)[: bits // 8], "big")


def hash_text(kind: str, bits: int, seed: int = 0):
    """A function from bytes to a number of so many bits."""
    if kind == "sha1":
        return functools.partial(sha1_bits, bits=bits)
    if kind == "xxh3":
        return functools.partial(xxh3_bits, seed=seed, bits=bits)
    raise ValueError(f"unknown hash {kind}")


def hash_texts(kind: str, bits: int) -> Callable[[Iterable[bytes]], np.ndarray]:
    """hash_text() of many texts at once, to unsigned numbers of 64 bits at most."""
    one = hash_text(kind, bits)
    if kind == "sha1" and bits in (16, 32, 64):
        sha1, width = functools.partial(hashlib.sha1, usedforsecurity=False), bits // 8

        def run(texts: Iterable[bytes]) -> np.ndarray:
            raw = np.frombuffer(b"".join([sha1(x).digest() for x in texts]), np.uint8).reshape(-1, 20)
            return raw[:, :width].copy().view(f"<u{width}").ravel().astype(np.uint64)

        return run
    if kind == "xxh3" and bits in (32, 64):
        mask = np.uint64((1 << bits) - 1)
        return lambda texts: np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64) & mask
    return lambda texts: np.fromiter(map(one, texts), np.uint64)


def views(col: pa.Array) -> Iterator[memoryview | None]:
    """The UTF-8 bytes of each text where they lie, None for nulls: a batch isn't made anew as Python's strings."""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
    whole = memoryview(data if data is not None else b"")
    for i, valid in enumerate(col.is_valid().to_numpy(zero_copy_only=False)):
        yield whole[at[i] : at[i + 1]] if valid else None


def hash_column(text: Column | str, kind: str = "xxh3", bits: int = 64, seed: int = 0) -> Column:
    """Hash of a string: a long up to 64 bits (the bit pattern where the sign bit is set), binary beyond."""
    one = hash_text(kind, bits, seed)
    if kind == "xxh3" and bits == 64:
        one = functools.partial(xxhash.xxh3_64_intdigest, seed=seed)
    wide = bits > 64

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            out = [None if t is None else one(t) for t in views(col)]
            if wide:
                yield pa.array([None if h is None else h.to_bytes(bits // 8, "big") for h in out], pa.binary())
            else:
                yield pa.array([None if h is None else h - (1 << 64) * (h >> 63) for h in out], pa.int64())

    return F.arrow_udf(run, "binary" if wide else "long")(text)


def permutations(num_perm: int, bits: int = 64, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers from 1 and offsets from 0, both below the modulus, as the legacy generator draws them."""
    modulus, _ = RINGS[bits]
    rng = np.random.RandomState(seed)
    kind = _DTYPES[bits]
    return rng.randint(1, modulus, num_perm, dtype=kind), rng.randint(0, modulus, num_perm, dtype=kind)


#: So many hashes are permuted at a time.
_CACHED = 1 << 14


def permuted_minima(hashes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int = 64) -> np.ndarray:
    """Sets x permutations: the least permuted hash of each set; products wrap at the width."""
    modulus, top = RINGS[bits]
    kind = _DTYPES[bits]
    h = hashes.astype(kind)
    out = np.empty((len(starts), len(a)), kind)
    ends, at = np.append(starts[1:], len(h)), 0
    while at < len(starts):  # sets whose hashes stay in the cache
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CACHED, "right")))
        part, first = h[starts[at] : ends[to - 1]], starts[at:to] - starts[at]
        for i in range(len(a)):
            v = part * a[i] + b[i]
            if bits == 64:  # the remainder by 2^61 - 1 in shifts; only its low 32 bits are kept
                v = (v & kind(modulus)) + (v >> kind(61))
                v += (v + kind(1)) >> kind(61)
                v = v.astype(np.uint32)
            else:
                v = (v % kind(modulus)) & kind(top)
            out[at:to, i] = np.minimum.reduceat(v, first)
        at = to
    return out


@functools.lru_cache
def lsh_shape(threshold: float, num_perm: int, false_positive: float = 0.5, false_negative: float = 0.5) -> tuple[int, int]:
    """Bands and rows whose weighted areas of wrong decisions are least; the first of equal ones."""
    x, w = np.polynomial.legendre.leggauss(200)

    def area(low: float, high: float, f) -> float:
        half = (high - low) / 2
        return float(half * (w * f(half * x + (high + low) / 2)).sum())

    best, shape = float("inf"), (0, 0)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            fp = area(0.0, threshold, lambda s: 1 - (1 - s**rows) ** bands)
            fn = area(threshold, 1.0, lambda s: (1 - s**rows) ** bands)
            error = fp * false_positive + fn * false_negative
            if error < best:
                best, shape = error, (bands, rows)
    return shape


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def block_widths(f: int, blocks: int) -> list[int]:
    """f bits in so many blocks, as even as may be."""
    if not 1 <= blocks <= f:
        raise ValueError("there must be 1 to f blocks")
    cut = [round(i * f / blocks) for i in range(blocks + 1)]
    return [b - a for a, b in zip(cut, cut[1:])]


def block_keys(f: int, blocks: int, distance: int) -> list[int]:
    """Masks of all choices of blocks - distance blocks: near signatures agree under one of them."""
    if not 0 <= distance < blocks:
        raise ValueError("there must be more blocks than bits that may differ")
    widths = block_widths(f, blocks)
    ends = list(itertools.accumulate(widths))
    each = [((1 << w) - 1) << (f - e) for w, e in zip(widths, ends)]
    return [sum(c) for c in itertools.combinations(each, blocks - distance)]


class BitPermutation:
    """Moves chosen blocks to the front; reverse() undoes permute()."""

    def __init__(self, f: int, distance: int, order: list[int], widths: list[int]):
        if sum(widths) != f or sorted(order) != list(range(len(widths))):
            raise ValueError("the blocks don't make up the width")
        starts = [sum(widths[:i]) for i in range(len(widths))]
        self.places = [p for i in order for p in range(starts[i], starts[i] + widths[i])]
        self.f = f
        #: bits of the leading blocks - distance blocks, which a search compares
        self.prefix = sum(widths[i] for i in order[: len(widths) - distance])

    def permute(self, x: int) -> int:
        return sum((x >> (self.f - 1 - p) & 1) << (self.f - 1 - i) for i, p in enumerate(self.places))

    def reverse(self, y: int) -> int:
        return sum((y >> (self.f - 1 - i) & 1) << (self.f - 1 - p) for i, p in enumerate(self.places))


def vote(hashes: list[int], f: int) -> int:
    """The bits that more than half of the hashes set."""
    if not hashes:
        raise ValueError("no hashes to vote")
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(f))
