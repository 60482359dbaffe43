"""SimHash document fingerprints, and all of them within a Hamming radius by permuted block tables.

A term is a pair of neighbouring words, its weight the number of times that it occurs. Every term's
64-bit hash votes with its weight, for a set bit and against a clear one. For the search the 64 bits
are cut into blocks; with more blocks than the radius, two near fingerprints agree on at least
blocks - radius whole blocks, so one table for each such choice of blocks, keyed by their bits,
holds every near pair in a bucket of one table at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmill.llm.text import Codes, pieces
from siltmill.session import written

#: Fingerprints differing in so few of the 64 bits are near.
RADIUS = 3
#: Six blocks give 20 tables, whose keys have 31 bits or more.
BLOCKS = 6
_MULT = np.uint64(31)


def term_hash(word: str) -> int:
    """The first 8 bytes of the word's MD5, as an unsigned number."""
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8], "big")


def simhash(texts: list[str | None]) -> list[int | None]:
    """Signed 64-bit fingerprints. Words are what stands between white space, in lower case; a text's
    terms are its pairs of neighbouring words, hashed to 31 h(first) + h(second), or its only word.
    A tie clears the bit. A null text and one without words have none."""
    codes, parts, counts = Codes(), [], []
    for text in texts:
        part = codes.of((text or "").lower().split())
        parts.append(part)
        counts.append(len(part))
    table = np.fromiter(map(term_hash, codes), np.uint64, len(codes))
    n = np.array(counts, np.int64)
    flat = table[np.concatenate(parts)] if parts else np.empty(0, np.uint64)
    ends = np.cumsum(n)
    out = np.zeros(len(n), np.uint64)
    pairs = flat.copy()
    pairs[:-1] = flat[:-1] * _MULT + flat[1:]
    last = ends[n > 1] - 1  # a text's last word starts no pair
    keep = np.ones(len(flat), bool)
    keep[last] = False
    some = np.flatnonzero(n > 0)
    single = ends[n == 1] - 1
    pairs[single] = flat[single]
    terms = pairs[keep]
    m = np.where(n > 1, n - 1, n)[some]
    starts = np.cumsum(m) - m
    for a in range(0, len(some), 256):  # bounds the unpacked bits
        part = slice(a, min(a + 256, len(some)))
        lo, hi = starts[a], starts[part.stop - 1] + m[part.stop - 1]
        bits = np.unpackbits(terms[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts[part] - lo, axis=0, dtype=np.int32)
        vote = 2 * ones > m[part][:, None]
        out[some[part]] = np.packbits(vote, axis=1).view(">u8").ravel()
    return [v if k else None for v, k in zip(out.view(np.int64).tolist(), n.tolist())]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row of docs; null for a null text or one without words. Texts are read whole,
    repeated rows and null ids stay, an empty table gives an empty one, and other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash(b.column(1).to_pylist()), pa.int64())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fingerprint long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks, the mask of their bits, as signed numbers."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("there must be more blocks than the radius, and 64 at most")
    cut = [round(i * 64 / blocks) for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:])]
    return [m - (1 << 64) * (m >> 63) for m in (sum(c) for c in combinations(each, blocks - radius))]


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(left, right, distance): all pairs left < right of a table of distinct fingerprints within the radius."""
    masks = block_masks(radius, blocks)

    def keyed(name: str) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
        return prints.select(F.col("fingerprint").alias(name), rows.alias("r")).select(name, "r.t", "r.key")

    pairs = keyed("left").join(keyed("right"), ["t", "key"]).where(F.col("left") < F.col("right"))
    x = F.col("left").bitwiseXOR(F.col("right"))
    first: Column = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)).otherwise(first)
    # a pair that meets in several tables counts in the first of them
    near = pairs.where((F.bit_count(x) <= radius) & (F.col("t") == first))
    return near.select("left", "right", F.bit_count(x).cast("long").alias("distance"))


def near_documents(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, near_id, distance): for each document, every fingerprint within the radius.

    near_id is the least id among the documents of that fingerprint; the document's own fingerprint is
    one of them, at distance 0, so copies meet in their least id and thousands of them cost no pairs.
    A document without words (null, empty) gives one row of null fingerprint, near_id and distance. A text of any
    length votes with all its terms, and a tie of votes clears the bit.
    Repeated rows stay, ids that are null have rows but are no near_id, an empty table gives an empty
    one, and other columns are left out whatever their names.
    """
    found = written(fingerprint(docs, id_col, text_col))
    owners = written(found.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min(id_col).alias("near_id")))
    pairs = near_fingerprints(owners.select("fingerprint"), radius, blocks)
    both = (
        pairs.select("left", "right", "distance")
        .unionAll(pairs.select(F.col("right"), F.col("left"), "distance"))
        .unionAll(owners.select("fingerprint", "fingerprint", F.lit(0).cast("long")))
        .toDF("fingerprint", "other", "distance")
    )
    sides = both.join(owners.withColumnRenamed("fingerprint", "other"), "other").select("fingerprint", "near_id", "distance")
    return found.join(sides, "fingerprint", "left").select(id_col, "fingerprint", "near_id", "distance")


ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos
           FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda x: x <> '') AS l FROM documents)),
h AS (SELECT doc_id, pos, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h, count(*) OVER (PARTITION BY doc_id) AS n,
             lead(('0x' || substr(md5(word), 1, 16))::UBIGINT) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM w),
t AS (SELECT doc_id, CASE WHEN n = 1 THEN h ELSE ((h::HUGEINT * 31 + nxt) % 18446744073709551616)::UBIGINT END AS h
      FROM h WHERE n = 1 OR nxt IS NOT NULL),
v AS (SELECT doc_id, {', '.join(f'2 * sum((h >> {b}) & 1) > count(*) AS b{b}' for b in range(64))} FROM t GROUP BY doc_id),
f AS (SELECT doc_id, ({' + '.join(f'(CASE WHEN b{b} THEN {(1 << b) if b < 63 else -(1 << 63)}::HUGEINT ELSE 0 END)' for b in range(64))})::BIGINT AS fingerprint FROM v),
o AS (SELECT fingerprint, min(doc_id) AS near_id FROM f GROUP BY fingerprint),
p AS (SELECT a.fingerprint, b.near_id, bit_count(xor(a.fingerprint, b.fingerprint))::BIGINT AS distance
      FROM o a JOIN o b ON bit_count(xor(a.fingerprint, b.fingerprint)) <= {RADIUS})
SELECT d.doc_id, f.fingerprint, p.near_id, p.distance
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN p ON p.fingerprint = f.fingerprint"""
