"""Token sequences of a fixed size with little padding, packed on line by the sum-of-squares rule.

A document, or what is left of one that is longer than the size, goes to the fill level that makes
``sum over levels of (open windows at that level) squared`` smallest, a new window counting as level 0.
The level array has one count per fill level, so placing takes the same time however many windows are
open. Each task packs its own rows; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import ship, slices
from lotline.llm.tokens import encoder

#: Windows that a task holds open; beyond it they are closed, so that memory stays bounded.
OPEN_WINDOWS = 8_192
#: Pieces in an output batch.
_BATCH = 2_000
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes  # four bytes an id
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * at], self.doc_tokens),
            Piece(self.doc_id, self.start + at, self.ids[4 * at :], self.doc_tokens),
        )


@dataclass
class Packer:
    """Packs one task's documents; ``add`` and ``close`` give pieces with sequence and offset."""

    size: int
    first_sequence: int = 0
    most_open: int = OPEN_WINDOWS
    levels: np.ndarray = field(init=False)
    windows: list[list[list[Piece]]] = field(init=False)
    open_count: int = 0
    sequences: int = 0

    def __post_init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.levels = np.zeros(self.size + 1, np.int64)
        self.windows = [[] for _ in range(self.size + 1)]
        self.open_count = 0

    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        while piece.length > self.size:
            head, piece = piece.cut(self.size)
            yield from self._emit([head])
        if piece.length == 0:
            return
        level = self.best_level(piece.length)
        window = self.windows[level].pop() if level else []
        window.append(piece)
        filled = level + piece.length
        self.levels[level] -= level > 0
        self.open_count += (level == 0) - (filled == self.size)
        if filled == self.size:
            yield from self._emit(window)
            return
        self.levels[filled] += 1
        self.windows[filled].append(window)
        if self.open_count > self.most_open:
            yield from self.close()

    def best_level(self, length: int) -> int:
        """The level to put ``length`` ids on; the fullest of ties, 0 for a new window."""
        n, size = self.levels, self.size
        change = np.full(size + 1, np.iinfo(np.int64).max)
        change[0] = 2 * n[length] + 1 if length < size else 0
        room = size - length
        # Level h loses a window and h + length gains one; a full window counts nowhere.
        change[1:room] = np.where(n[1:room] > 0, 2 * (n[1 + length : size] - n[1:room]) + 2, change[1:room])
        if room and n[room]:
            change[room] = 1 - 2 * n[room]
        return size - int(change[::-1].argmin())

    def close(self) -> Iterator[tuple[Piece, int, int]]:
        """Cut the open windows' pieces into full sequences; what is left over, into powers of two, which need no padding."""
        pieces = [p for level in reversed(self.windows) for window in level for p in window]
        self._reset()
        left = sum(p.length for p in pieces)
        room = self._room(left)
        sequence: list[Piece] = []
        for piece in pieces:
            while piece.length >= room:
                head, piece = piece.cut(room)
                yield from self._emit([*sequence, head])
                left -= self._room(left)
                sequence, room = [], self._room(left)
                if piece.length == 0:
                    break
            if piece.length:
                sequence.append(piece)
                room -= piece.length

    def _room(self, left: int) -> int:
        return self.size if left >= self.size else 1 << (max(left, 1).bit_length() - 1)

    def _emit(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for piece in pieces:
            yield piece, self.first_sequence + self.sequences, offset
            offset += piece.length
        self.sequences += 1


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    size: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: one row per piece of a document.

    ``ids`` are little-endian unsigned 32-bit integers; every id of a document, the end id included,
    lies in one piece. ``sequence_id`` is unique, ``offset`` gapless from 0. All sequences are full but
    at most a few per task, whose sizes are powers of two. Documents are whole where they fit; they are
    cut at the size, and where a task closes its open windows. A null or empty text is its end id only.
    Rows that repeat are packed each, a null id stays null, other columns are not read. No rows give no
    rows. The result of a task follows from its rows in their order, so read ``docs`` from a table.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = end_id.to_bytes(4, "little")
        packer = Packer(size, TaskContext.get().partitionId() << 33, open_windows)
        rows: list[tuple] = []

        def placed(found: Iterator[tuple[Piece, int, int]]) -> None:
            rows.extend((p.doc_id, p.start, p.length, p.ids, p.doc_tokens, seq, offset) for p, seq, offset in found)

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

        for batch in slices(batches):
            ids = encode(batch.column(1).to_pylist())
            for doc_id, raw in zip(batch.column(0).to_pylist(), ids, strict=True):
                placed(packer.add(Piece(doc_id, 0, raw + end, len(raw) // 4 + 1)))
                if len(rows) >= _BATCH:
                    yield batch_of()
        placed(packer.close())
        if rows:
            yield batch_of()

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(
        run,
        "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
