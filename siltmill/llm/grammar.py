"""Token ids as binary shards, each compressed by a Re-Pair grammar.

A shard is some two million tokens of consecutive documents of one input task. Round by round the
most frequent pairs of neighbouring symbols within documents become nonterminals; where two chosen
pairs overlap, the more frequent one wins. Rounds end when no pair is left that occurs twice, or when
all symbols that two bytes can name are used up. A shard keeps its rules, the number of tokens that each
symbol expands to, and each document's run of symbols; so any range of a document's tokens is found
by adding lengths and expanding only the symbols that it touches.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.llm.text import pieces
from siltmill.llm.token_counts import DEFAULT_RANKS, PATTERN, load

SHARD_TOKENS = 2_000_000
#: Symbols in all, so that each takes two bytes: the vocabulary's and the rules'.
SYMBOLS = 1 << 16
#: A pair becomes a rule from so many occurrences.
LEAST_COUNT = 2
#: A round takes the pairs that are at least this part as frequent as its most frequent one, and at least the
#: most frequent ones up to so many.
ROUND = 0.3
TOGETHER = 250
MAGIC = b"RPG1"


def tokenize(texts: list[str | None], ranks: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, how many each has); a null text counts as empty."""
    encode = load(ranks, pattern).encode_ordinary
    parts = [np.frombuffer(array("I", encode(t) if t else []), np.uint32) for t in texts]  # sooner than numpy reads a list
    return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.array([len(p) for p in parts], np.int64)


def compress(seq: np.ndarray, counts: np.ndarray, base: int, symbols: int = SYMBOLS, least: int = LEAST_COUNT, part: float = ROUND, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, how many each document has, rules): rule k is the pair that symbol base + k stands for.

    It ends when no pair within documents occurs least times, apart from one another, or when all symbols
    are used up. A round takes the pairs that are at least part as frequent as its most frequent one, and
    the most frequent ones up to so many together; an occurrence beside one of a more frequent pair waits.
    """
    shift, kind = (np.uint32(16), np.uint32) if symbols <= 1 << 16 else (np.uint64(32), np.uint64)
    low, none, width = kind((1 << int(shift)) - 1), kind(np.iinfo(kind).max), 8 * np.dtype(kind).itemsize
    factor = kind(0x9E3779B97F4A7C15 >> (64 - width) | 1)
    seq, ends = seq.astype(kind), np.cumsum(counts, dtype=np.int64)
    rules: list[np.ndarray] = []
    made = 0
    while made < symbols - base and len(seq) > 1:
        keys = seq[:-1] << shift
        keys |= seq[1:]
        across = np.unique(ends)
        across = across[(across > 0) & (across < len(seq))] - 1  # pairs that would run into the next document
        skip = across
        # of one symbol repeated, every other pair counts
        twice = np.flatnonzero(seq[:-1] == seq[1:])
        if len(twice):
            twice = twice[~np.isin(twice, across)]
            new_run = np.concatenate([[True], np.diff(twice) != 1])[: len(twice)]
            start = twice[np.maximum.accumulate(np.where(new_run, np.arange(len(twice)), 0))]
            skip = np.concatenate([across, twice[(twice - start) % 2 == 1]])
        keys[skip] = none
        order = np.sort(keys)
        order = order[: len(order) - len(skip)]
        if not len(order):
            break
        firsts = np.append(0, np.flatnonzero(order[1:] != order[:-1]) + 1)
        freq = np.diff(firsts, append=len(order))
        most = int(freq.max())
        if most < least:
            break
        picked = np.flatnonzero(freq >= max(least, math.ceil(most * part)))
        if len(picked) < together < len(freq):
            picked = np.flatnonzero(freq >= max(least, np.partition(freq, -together)[-together]))
        picked = picked[np.argsort(-freq[picked], kind="stable")][: symbols - base - made]
        chosen = order[firsts[picked]]
        sides = np.zeros(symbols, np.uint8)  # 1: some chosen pair's left symbol, 2: its right one
        sides[chosen >> shift] = 1
        sides[chosen & low] |= 2
        side = sides.take(seq, mode="clip")
        there = np.flatnonzero((side[:-1] & (side[1:] >> 1)).view(bool))
        mine = keys[there]
        # a table by hash; of two chosen pairs in one slot the rarer waits for a later round
        bits = min(18, (16 * len(chosen)).bit_length())
        slots = (chosen * factor) >> kind(width - bits)
        rank_in, key_in = np.zeros(1 << bits, np.int32), np.full(1 << bits, none, kind)
        rank_in[slots[::-1]] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int32)
        key_in[slots[::-1]] = chosen[::-1]
        slots = (mine * factor) >> kind(width - bits)
        hit = (key_in[slots] == mine) & (mine != none)
        there, mine = there[hit], rank_in[slots[hit]]
        rank = np.full(len(seq) + 1, len(chosen), np.int32)  # of the pair that begins one place before
        rank[there + 1] = mine
        wins = (mine <= rank[there]) & (mine <= rank[there + 2])
        there, mine = there[wins], mine[wins]
        good = np.bincount(mine, minlength=len(chosen)) >= least  # the most frequent one always is
        there, mine = there[good[mine]], mine[good[mine]]
        rules.append(chosen[good])
        seq[there] = (np.cumsum(good) - 1 + base + made)[mine]
        made += int(good.sum())
        gone = there + 1
        stays = np.ones(len(seq), bool)
        stays[gone] = False
        seq = seq[stays]
        ends -= np.searchsorted(gone, ends)
    pairs = np.concatenate(rules) if rules else np.empty(0, kind)
    table = np.stack([pairs >> shift, pairs & low], 1).astype(np.uint32)
    return seq.astype(np.uint32), np.diff(ends, prepend=0), table


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """How many tokens each rule's symbol expands to; a rule uses earlier symbols only, round by round."""
    out = np.ones(base + len(rules), np.int64)
    done = 0
    while done < len(rules):
        # rules whose parts are all settled
        ready = done + int(np.argmax(np.append((rules[done:] >= base + done).any(1), True)))
        part = rules[done:ready].astype(np.int64)
        out[base + done : base + ready] = out[part[:, 0]] + out[part[:, 1]]
        done = ready
    return out[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The tokens that symbols stand for."""
    out = symbols.astype(np.int64)
    while len(big := np.flatnonzero(out >= base)):
        size = np.ones(len(out), np.int64)
        size[big] = 2
        first = (np.cumsum(size) - size)[big]
        wide = np.repeat(out, size)
        pair = rules[out[big] - base]
        wide[first], wide[first + 1] = pair[:, 0], pair[:, 1]
        out = wide
    return out


def pack_shard(ids: np.ndarray, counts: np.ndarray, base: int) -> tuple[bytes, int, int]:
    """(the shard's bytes, its symbols, its rules).

    Little-endian: magic, then vocabulary size, documents, symbols and rules as uint32, then each
    document's number of symbols (uint32), the rules' pairs, their expansion lengths (uint32) and the
    symbols; pairs and symbols are uint16 where all symbols fit, else uint32."""
    seq, sizes, rules = compress(ids, counts, base)
    kind = np.uint16 if base + len(rules) <= 1 << 16 else np.uint32
    head = np.array([base, len(counts), len(seq), len(rules)], "<u4").tobytes()
    body = [sizes.astype("<u4"), rules.astype(kind), expansions(rules, base).astype("<u4"), seq.astype(kind)]
    return MAGIC + head + b"".join(x.tobytes() for x in body), len(seq), len(rules)


class Shard:
    """A shard that is read at random."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("this is no shard")
        self.base, docs, n, r = np.frombuffer(data, "<u4", 4, 4).tolist()
        kind, width = (np.uint16, 2) if self.base + r <= 1 << 16 else (np.uint32, 4)
        sizes = np.frombuffer(data, "<u4", docs, 20).astype(np.int64)
        at = 20 + 4 * docs
        self.rules = np.frombuffer(data, kind, 2 * r, at).reshape(-1, 2).astype(np.int64)
        at += 2 * width * r
        self.lengths = np.concatenate([np.ones(self.base, np.int64), np.frombuffer(data, "<u4", r, at).astype(np.int64)])
        self.symbols = np.frombuffer(data, kind, n, at + 4 * r)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])

    def document(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens start to stop of a document; only the symbols that hold them are expanded."""
        run = self.symbols[self.ends[doc] : self.ends[doc + 1]]
        ends = np.cumsum(self.lengths[run])
        total = int(ends[-1]) if len(ends) else 0
        start, stop, _ = slice(start, stop).indices(total)
        if start >= stop:
            return np.empty(0, np.int64)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(run[a:b], self.rules, self.base)[start - before : stop - before]


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard_id, ids, doc_tokens, n_tokens, n_symbols, n_rules, data): one row for each shard.

    ids and doc_tokens are lists in the order of the shard's documents; a document of null text has null
    tokens and no symbols, one of empty text 0. Long documents are never cut, so a shard may be larger.
    Each row is stored by itself, so repeated rows and null ids stay. An empty table gives no shard, and
    other columns are left out whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, task, number = load(ranks, pattern).n_vocab, TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids, counts, null = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            names = pa.concat_arrays([h[0] for h in held])
            data, symbols, rules = pack_shard(ids, counts, base)
            shard = task << 32 | number
            number += 1
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), one(names), one(pa.array(counts, mask=null)), pa.array([len(ids)]), pa.array([symbols]), pa.array([rules]), pa.array([data], pa.binary())],
                ["shard_id", "ids", "doc_tokens", "n_tokens", "n_symbols", "n_rules", "data"],
            )

        total = 0
        for b in pieces(batches, 1):
            texts = b.column(1).to_pylist()
            ids, counts = tokenize(texts, ranks, pattern)
            held.append((b.column(0), ids, counts, np.array([t is None for t in texts])))
            total += len(ids)
            if total >= shard_tokens:
                yield flush()
                held.clear()
                total = 0
        if held:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"shard_id long, ids array<{kind}>, doc_tokens array<long>, n_tokens long, n_symbols long, n_rules long, data binary"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tokens): a row for each document of a table that write_shards made, exactly its token ids.

    Null tokens stand for a null text, none for an empty one. Repeated rows and null ids come back as they
    were; an empty table gives an empty one, and other columns of it are left out.
    """
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                names, tokens, shard = b.column(0).slice(i, 1).flatten(), b.column(1)[i].as_py(), Shard(b.column(2)[i].as_py())
                null = np.array([t is None for t in tokens])
                flat = expand(shard.symbols, shard.rules, shard.base)
                ends = np.cumsum([t or 0 for t in tokens])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(null, False)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([names, lists], [id_col, "tokens"])

    return shards.select("ids", "doc_tokens", "data").mapInArrow(run, f"`{id_col}` {kind}, tokens array<int>")
