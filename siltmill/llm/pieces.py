"""SentencePiece encoding and decoding by a table of distinct marked words.

Where no piece of the model crosses from a word into the next white-space marker, the segmentation
of a text is the chain of its marked words' segmentations; so each distinct one is segmented once
and the ids are joined back by position (see chunk_join).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.llm.chunk_join import Table, chunk_join, pack_sequences, unpack_sequences
from siltmill.llm.text import ragged

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CROSSING = re.compile(f"[^{MARK}]{MARK}")
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model; ValueError if its pieces cross markers or it rewrites texts, as then words can't be segmented alone."""
    if path not in _models:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(_CROSSING.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
            raise ValueError(f"{path}: a piece crosses a white-space marker")
        if model.decode(model.encode("  a  ﬁ x ")) != "  a  ﬁ x ":
            raise ValueError(f"{path}: the model rewrites texts before segmenting them")
        _models[path] = model
    return _models[path]


def marked_words(text: str) -> list[str]:
    """Runs of markers with the text up to the next run, without the first marker; other markers are spaces.

    The model puts one marker before the text, so the words are those of marker + text. An empty text has none.
    """
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " ":
        return [w[1:].replace(MARK, " ") for w in _MARKED.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def _solver(path: str) -> Callable[[list[str]], list[bytes]]:
    def solve(chunks: list[str]) -> list[bytes]:
        model = load(path)
        alone = model.piece_to_id(MARK)
        ids = model.encode(chunks, num_threads=1)
        return [np.array(x if c else [alone], np.uint16 if model.get_piece_size() < 65536 else np.uint32).tobytes() for c, x in zip(chunks, ids)]

    return solve


def _width(path: str) -> type:
    return np.uint16 if load(path).get_piece_size() < 65536 else np.uint32


def piece_bytes(path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All pieces' bytes, one after another, with start and size by id; markers are spaces, control pieces empty."""
    model = load(path)
    parts = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            parts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i):
            parts.append(b"")
        elif model.is_unknown(i):
            parts.append(model.decode([i]).encode())
        else:
            parts.append(piece.replace(MARK, " ").encode())
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return b"".join(parts), np.cumsum(size) - size, size


def _decoded(flat: np.ndarray, counts: np.ndarray, table: tuple[bytes, np.ndarray, np.ndarray]) -> list[str]:
    data, start, size = table
    lens = size[flat]
    text = np.frombuffer(data, np.uint8)[ragged(start[flat], lens)].tobytes()
    ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(counts)].tolist()
    out = []
    for a, b in zip([0, *ends], ends):
        one = text[a:b].decode("utf-8", "replace")
        out.append(one[1:] if one[:1] == " " else one)
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, decoded: bool = False) -> DataFrame:
    """(id, ids, n_ids), and with decoded also the text that the ids spell.

    The ids are those that the model gives for the whole text. A null text has null in all columns,
    an empty one no ids; texts of any length are taken whole. Each row is encoded by itself, so
    repeated rows and null ids stay as they are; an empty table gives an empty one, and other columns
    are left out whatever their names.
    """
    load(model)

    def finish(table: Table) -> Callable[[bytes], list[pa.Array]]:
        spelled = piece_bytes(model) if decoded else None

        def apply(packed: bytes) -> list[pa.Array]:
            null, lens, codes = unpack_sequences(packed)
            sizes = table.size[codes]
            flat = table.data[ragged(table.start[codes], sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lens)]
            counts = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(null, False)), pa.array(flat.astype(np.int32)))
            out = [lists, pa.array(counts, mask=null)]
            if spelled:
                out.append(pa.array(_decoded(flat, counts, spelled), pa.string(), mask=null))
            return out

        return apply

    out = [("ids", "array<int>"), ("n_ids", "long")] + [("decoded", "string")] * decoded
    return chunk_join(docs, id_col, text_col, marked_words, _solver(model), pack_sequences, finish, out, _width(model))


def decode(table: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """The table with out_col: the text that each row's ids spell, without the marker put before it.

    Null ids give null, no ids an empty text; an id outside the model raises IndexError. A column that
    is already called out_col is replaced.
    """
    load(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = piece_bytes(model)
        for col in batches:
            counts = np.array(col.fill_null([]).value_lengths() if col.null_count else col.value_lengths(), np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(spelled[2])):
                raise IndexError("an id is outside the model")
            yield pa.array(_decoded(flat.astype(np.int64), counts, spelled), pa.string(), mask=~np.array(col.is_valid()))

    return table.withColumn(out_col, F.arrow_udf(run, "string")(F.col(ids_col).cast("array<int>")))
