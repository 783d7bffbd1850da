"""Cost-balanced packing of documents into sequences of a fixed token capacity."""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECES = 1024  # of a batch that leaves a task: 4 MB of ids at a capacity of 1024


class Tokens:
    """Token ids of whole texts as little-endian unsigned 32-bit values.

    ``ranks`` names the same byte-level vocabulary as a ranks file, which encodes several times
    faster; the first text is encoded both ways and must agree. A text that holds the string of a
    special token is left to the tokenizer.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.encode, self.checked = self.slow, ranks is None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.encode = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary,
                special_tokens={}).encode_ordinary

    def slow(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            return array("I", self.slow(text)).tobytes()
        ids = self.encode(text)
        if text and not self.checked:
            self.checked = True
            if ids != self.slow(text):
                raise ValueError("the ranks file has another vocabulary than the tokenizer")
        return array("I", ids).tobytes()


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float):
    """Pieces (document, start, length, sequence, offset) of documents below the capacity.

    The sequences are as few as the tokens need. Documents come in descending cost, which is
    descending length; each goes to the cheapest sequence that still has room, or is cut over the
    emptiest ones when none has.
    """
    count = -(-int(lengths.sum()) // capacity)
    cost, used = np.zeros(count), np.zeros(count, np.int64)
    pieces = []

    def put(doc: int, start: int, size: int, to: int) -> None:
        pieces.append((doc, start, size, to, int(used[to])))
        used[to] += size
        cost[to] += linear * size + quadratic * size * size

    for doc in np.argsort(-lengths, kind="stable"):
        size, start = int(lengths[doc]), 0
        fits = np.flatnonzero(used <= capacity - size)
        if len(fits):
            put(doc, 0, size, fits[np.argmin(cost[fits])])
            continue
        while start < size:
            to = int(np.argmin(used))
            part = min(size - start, capacity - int(used[to]))
            put(doc, start, part, to)
            start += part
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, *, ranks: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
                   end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 1024,
                   block_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset`` and the piece's estimated ``cost``.

    ``tokenizer`` is the path of a tokenizers file, ``ranks`` that of a ranks file of the same
    vocabulary (see ``Tokens``). A document's tokens are its ids and ``end_id``.
    Stretches of a whole capacity become sequences of their own; the rest are balanced by
    ``linear * n + quadratic * n * n`` within blocks of ``block_tokens`` of the same partition.
    There is no shuffle: a block pads less than one sequence, and a task holds one block whatever
    the input's size. A lost task packs its partition again into the same sequences.

    A null or empty text has only ``end_id``. Repeated rows are packed each. A null id is kept.
    Other columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("cost", T.DoubleType()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokens(tokenizer, ranks)
        id_type = None
        sequence = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        block: list[tuple] = []  # id, ids of the rest, its start, all tokens
        held = 0

        def emit(doc_id, start, ids, total, seq, offset):
            size = len(ids) // 4
            out.append((doc_id, start, size, ids, total, seq, offset,
                        linear * size + quadratic * size * size))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                     pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=schema.fieldNames())

        def flush() -> None:
            nonlocal sequence
            lengths = np.array([len(b[1]) // 4 for b in block], np.int64)
            for doc, start, size, to, offset in balance(lengths, capacity, linear, quadratic):
                doc_id, ids, base, total = block[doc]
                emit(doc_id, base + start, ids[4 * start:4 * (start + size)], total,
                     sequence + int(to), offset)
            sequence += -(-int(lengths.sum()) // capacity)
            block.clear()

        for arrow in batches:
            id_type = arrow.schema.field("doc_id").type
            for doc_id, text in zip(arrow["doc_id"].to_pylist(), arrow["text"], strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    emit(doc_id, start, ids[4 * start:4 * (start + capacity)], total, sequence, 0)
                    sequence += 1
                if total > whole:
                    block.append((doc_id, ids[4 * whole:], whole, total))
                    held += total - whole
                if held >= block_tokens:
                    flush()
                    held = 0
                if len(out) >= PIECES:
                    yield batch_of()
        if block:
            flush()
        if out:
            yield batch_of()

    return rows.mapInArrow(pack, schema)
