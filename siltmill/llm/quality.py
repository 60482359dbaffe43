"""Quality rules on repetition, from each text's suffix array.

Suffixes of all texts of a batch are sorted together by prefix doubling over words, where only
those that still tie are sorted again; the ranks kept from each round give the longest common prefix
of neighbours in the array. An interval of the array whose common prefix can't be longer is a maximal
repeated substring; a word is covered when some suffix before it shares a prefix of at least
min_words words with another that reaches it, which is the union of those substrings' spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.llm.text import Codes, slices, words

#: A repeat counts from so many words.
MIN_WORDS = 8
#: Of a text's characters (without white space), repeats may cover so large a part. A short text whose
#: heading comes back as its last line reaches 0.75, and is kept, as labelled rows of good quality are.
MAX_COVERED = 0.8
#: The longest repeat may be so large a part.
MAX_LONGEST = 0.45
#: A run without white space that is longer than this counts as a word for each character.
LONG_WORD = 64


def _tokens(text: str) -> list[str]:
    out = words(text)
    if len(text) > LONG_WORD and max(map(len, out), default=0) > LONG_WORD:
        out = [p for w in out for p in ([w] if len(w) <= LONG_WORD else list(w))]
    return out


def shared_prefixes(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix in words that its suffix shares with another of its text."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    # one more end mark after each text, different for each, so that no suffix is another's prefix
    base = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(base, kind="stable")
    levels: list[np.ndarray] = []
    last = np.flatnonzero(np.diff(doc, append=-1))  # each text's last position
    room = np.empty(n, np.int64)  # words from a position to its text's end
    room[:] = np.repeat(last, np.diff(last, prepend=-1)) + 1 - np.arange(n)
    sa = order
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = base[order][1:] != base[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    # ranks are those of a group's first place in the array, so that groups can be split in place
    firsts = np.flatnonzero(new)
    rank = firsts[rank]
    k = 1
    while True:
        levels.append(rank)
        size = np.diff(np.append(firsts, n))
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)  # places in the array that are not settled
        if not len(at):
            break
        who = sa[at]
        ahead = who + k
        inside = room[who] > k
        # a suffix that ends within k words comes first, and alone: later ends rank apart by place
        key2 = np.where(inside, rank[np.minimum(ahead, n - 1)] + n, who)
        key1 = rank[who]
        sub = np.lexsort((key2, key1))
        who, key1, key2 = who[sub], key1[sub], key2[sub]
        sa = sa.copy()
        sa[at] = who
        fresh = np.ones(len(at), bool)
        fresh[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
        new = ~tied
        new[at] = fresh
        firsts = np.flatnonzero(new)
        place = np.repeat(firsts, np.diff(np.append(firsts, n)))
        rank = rank.copy()
        rank[who] = place[at]
        k *= 2
    # neighbours' common prefix: from the widest level down, step over what they share
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    got = np.zeros(len(live), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        ra, rb = levels[level], np.minimum(np.maximum(a, b) + got, n - 1)
        ok = (np.maximum(a, b) + got < n) & (doc[rb] == doc[a]) & (doc[np.minimum(np.minimum(a, b) + got, n - 1)] == doc[a])
        same = ok & (ra[np.minimum(a + got, n - 1)] == ra[np.minimum(b + got, n - 1)])
        got += step * same
    lcp[live] = got
    best = np.zeros(n, np.int64)
    best[sa[:-1]] = lcp
    best[sa[1:]] = np.maximum(best[sa[1:]], lcp)
    return best


def measure(texts: list[str | None], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(covered, longest) as fractions of each text's characters without white space; 0 for empty or null ones."""
    covered, longest = np.zeros(len(texts)), np.zeros(len(texts))
    parts, sizes, which, docs, total = [], [], [], [], 0

    def flush() -> None:
        if not parts:
            return
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        best = shared_prefixes(np.concatenate(parts), doc)
        best = np.where(best >= min_words, best, 0)
        size = np.concatenate(sizes)
        at = np.arange(len(best))
        # the furthest end of spans so far; spans stay within their text, so texts don't mix
        cover = np.maximum.accumulate(at + best) > at
        sums = np.concatenate([[0], np.cumsum(size)])
        span = sums[at + best] - sums[at]
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        whole = np.add.reduceat(size, starts)
        covered[docs] = np.add.reduceat(size * cover, starts) / whole
        longest[docs] = np.maximum.reduceat(span, starts) / whole
        for held in (parts, sizes, docs):
            held.clear()

    codes = Codes()
    for i, text in enumerate(texts):
        toks = _tokens(text) if text else []
        if not toks:
            continue
        parts.append(codes.of(toks))
        sizes.append(np.fromiter(map(len, toks), np.int64, len(toks)))
        docs.append(i)
        total += len(toks)
        if total > 250_000:
            flush()
            codes, total = Codes(), 0
    flush()
    return covered, longest


def score(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, out_col: str = "repetition") -> DataFrame:
    """docs with a struct column out_col (covered, longest, keep) for each row, in place of one of this name.

    See rate() for what they say: null and empty texts have zeros and stay, and a text at a limit stays. An empty table
    gives an empty one; texts are read whole; all rows and other columns are as they were."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            found = [measure(part, min_words) for part in slices(col, 1 << 22)]
            covered, longest = (np.concatenate([np.empty(0), *(f[k] for f in found)]) for k in (0, 1))
            keep = (covered <= max_covered) & (longest <= max_longest)
            yield pa.StructArray.from_arrays([pa.array(covered), pa.array(longest), pa.array(keep)], ["covered", "longest", "keep"])

    return docs.withColumn(out_col, F.arrow_udf(run, "struct<covered:double,longest:double,keep:boolean>")(F.col(text_col)))


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id, covered, longest, keep) for each row.

    covered is the part of the text that lies in repeated substrings of min_words words or more,
    every occurrence and overlaps included; longest is the longest repeat's part. A text goes where
    either is over its limit; one at the limit stays. Null and empty texts repeat nothing and stay.
    Rows count by themselves: repeated rows and null ids stay as they are; texts of any length are
    read whole, an empty table gives an empty one, and other columns are left out.
    """
    made = score(docs.select(F.col(id_col), F.col(text_col).alias("text_")), "text_", out_col="r_", **limits)
    return made.select(id_col, "r_.covered", "r_.longest", "r_.keep")


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs that the rules keep, with its columns whatever their names; see rate().

    Null and empty texts, null ids and repeated rows stay; an empty table gives an empty one."""
    name = "repetition_"
    while name in docs.columns:
        name += "_"
    return score(docs, text_col, out_col=name, **limits).where(F.col(name)["keep"]).select(*[F.col(f"`{c}`") for c in docs.columns])
