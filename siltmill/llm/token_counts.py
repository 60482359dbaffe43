"""Token counts without token ids: pieces are counted once for each distinct pre-token, and joined to
the documents' pre-token frequencies, whose weighted sum is the document's count (see chunk_join)."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from siltmill.llm.chunk_join import Table, chunk_join, pack_counts, unpack

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own pattern, in a form that doesn't step back: it splits every text alike.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_found: dict[tuple[str, str], tiktoken.Encoding] = {}


def load(path: str = DEFAULT_RANKS, pattern: str = PATTERN) -> tiktoken.Encoding:
    if (path, pattern) not in _found:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _found[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _found[path, pattern]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """(id, n_pretokens, n_tokens) for each row, as the tokenizer would give for the whole text.

    A null text has null counts, an empty one zeros. Each row counts by itself, so repeated rows and
    null ids stay; an empty table gives an empty one, and other columns are left out whatever their names.
    """

    def split(text: str) -> list[str]:
        return regex.findall(pattern, text)

    def solve(chunks: list[str]) -> list[bytes]:
        whole = load(ranks, pattern)._core_bpe.encode_single_piece
        return [np.uint32(len(whole(c.encode()))).tobytes() for c in chunks]

    def finish(table: Table) -> Callable[[bytes], list[pa.Array]]:
        pieces = table.data[table.start].astype(np.int64)

        def apply(packed: bytes) -> list[pa.Array]:
            null, lens, (steps, counts) = unpack(packed)
            total, tokens = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
            some = np.flatnonzero(lens)
            if len(some):
                starts = (np.cumsum(lens) - lens)[some]
                run = np.cumsum(steps)
                codes = run - np.repeat(run[starts] - steps[starts], lens[some])  # steps begin anew in each document
                total[some] = np.add.reduceat(counts, starts)
                tokens[some] = np.add.reduceat(pieces[codes] * counts, starts)
            return [pa.array(total, mask=null), pa.array(tokens, mask=null)]

        return apply

    return chunk_join(docs, id_col, text_col, split, solve, pack_counts, finish, [("n_pretokens", "long"), ("n_tokens", "long")], np.uint32)
