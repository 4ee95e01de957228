"""Sum-of-squares packing of documents into windows of a fixed number of tokens (Csirik et al., 2006).

Each task packs the documents it reads, online: an array counts the partially filled windows at each
level, and a document goes to the level, an empty window included, where the sum of the squared
counts becomes smallest. Whole windows are cut off long documents first. What is still open at the
end of a task is poured together by cutting pieces, and the last partial window is laid out in powers
of two, which need no padding. A task holds its open windows only.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tsreg.llm.common import map_arrow
from tsreg.llm.tokens import OWNER, broadcast_tokenizer, encoder

WINDOW = 4096
END_ID = 2

# a piece: document, ids of the document before it, ids of the piece as bytes, ids of the document
Piece = tuple[object, int, bytes, int]


class Packer:
    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # partially filled windows at each level
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def level_for(self, size: int) -> int:
        """Level at which a piece leaves the smallest sum of squared counts; 0 opens a window."""
        n = self.counts
        levels = np.flatnonzero(n[1 : self.window - size + 1]) + 1
        # halves of the growth of the sum, less one half
        growth = n[levels + size] - n[levels] + 0.5
        if len(levels) and levels[-1] + size == self.window:
            growth[-1] = -n[levels[-1]]
        if not len(levels) or growth.min() > n[size]:
            return 0
        return int(levels[len(levels) - 1 - np.argmin(growth[::-1])])  # the fullest among equals

    def place(self, piece: Piece) -> list[list[Piece]]:
        """Put a piece shorter than a window; returns the window if that fills it."""
        size = len(piece[2]) // 4
        level = self.level_for(size)
        held = self.open[level].pop() if level else []
        held.append(piece)
        self.counts[level] -= level > 0
        if level + size == self.window:
            return [held]
        self.open[level + size].append(held)
        self.counts[level + size] += 1
        return []

    def add(self, doc_id, ids: bytes) -> list[list[Piece]]:
        """Pack a document; returns the windows that are full now."""
        step, total = 4 * self.window, len(ids) // 4
        whole = len(ids) - len(ids) % step
        full = [[(doc_id, s // 4, ids[s : s + step], total)] for s in range(0, whole, step)]
        if whole < len(ids):
            full += self.place((doc_id, whole // 4, ids[whole:], total))
        return full

    def drain(self) -> list[list[Piece]]:
        """Pour the open windows together: all full but the last, which comes in powers of two."""
        rows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        pieces = [piece for held in rows for piece in held]
        windows, held, level = [], [], 0
        total = sum(len(p[2]) // 4 for p in pieces)
        rest = total % self.window
        sizes = [self.window] * (total // self.window)
        sizes += [1 << b for b in reversed(range(self.window.bit_length())) if rest >> b & 1]
        wanted = iter(sizes)
        size = next(wanted, 0)
        for doc_id, start, ids, doc_tokens in pieces:
            while ids:
                take = min(size - level, len(ids) // 4)
                held.append((doc_id, start, ids[: 4 * take], doc_tokens))
                ids, start, level = ids[4 * take :], start + take, level + take
                if level == size:
                    windows.append(held)
                    held, level, size = [], 0, next(wanted, 0)
        return windows


def pack(
    docs: DataFrame,
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a packed sequence.

    ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32`` (over
    little-endian unsigned 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset`` (place in the
    sequence), and the ids themselves if ``with_ids``. Every document ends in ``end_id``, so a null or
    empty text is one id long. Repeated rows are packed as often as they come; ``doc_id`` may be null.
    """
    source = broadcast_tokenizer(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint"
    ) + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tokens = Packer(window), encoder(source)
        sequence = TaskContext.get().partitionId() << 33

        def rows_of(windows: list[list[Piece]], id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for held in windows:
                offset = 0
                for doc_id, start, ids, doc_tokens in held:
                    length = len(ids) // 4
                    row = (doc_id, start, length, zlib.crc32(ids), doc_tokens, sequence, offset)
                    rows.append(row + (np.frombuffer(ids, "<i4"),) if with_ids else row)
                    offset += length
                sequence += 1
            types = [id_type] + 6 * [pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names[: len(types)]
            )

        id_type = None
        for batch in batches:
            id_type, full = batch.column(0).type, []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1))):
                full += packer.add(doc_id, ids + end)
            if full:
                yield rows_of(full, id_type)
        left = packer.drain()
        if left:
            yield rows_of(left, id_type)

    return map_arrow(docs.select("doc_id", "text"), run, schema, OWNER)
