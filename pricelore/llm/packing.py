"""Packing of documents into windows of equal length, by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids held by a task before they are packed and passed on (four bytes each).
BLOCK_IDS = 24_000_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Open windows by the room that is left in them: a segment tree over 0..size that finds the least room of n or more."""

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]
        self.opened = 0

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room >= length of any open window."""
        tree, at = self.tree, length + self.leaves
        if tree[at]:
            return length
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece; opens a window if none has the room."""
        room = self.tightest(length) if length < self.size else None
        if room is None:
            window, room = self.opened, self.size
            self.opened += 1
        else:
            window = self.windows[room].pop()
            self.add(room, -1)
        left = room - length
        if left:
            self.windows[left].append(window)
            self.add(left, 1)
        return window, self.size - room


def pack(docs: DataFrame, encode: Callable[[list[str | None]], list[bytes]], end_id: int = 1, size: int = 2048, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packs every document's ids, with end_id after them, into sequences of at most `size` ids.

    docs: doc_id, text (null: empty); further columns are ignored. encode gives each text's ids as little-endian unsigned
    32-bit bytes. Overlong documents are first cut into full windows; what remains of all documents is placed by falling
    length, each in the open window with the least room that suffices. Returns a row per piece: doc_id, start (ids of its
    document before it), length, doc_tokens (with end_id), sequence_id, offset, ids (bytes as above).

    Each task packs the documents of its partition, in blocks of block_ids ids or one document, and leaves at most a few
    windows partly filled; nothing is shuffled. Windows left open by a block are filled by the next. sequence_id holds the
    partition's number above bit 40. Repeated rows and null ids are packed like any other; an empty text has end_id
    alone; an empty table gives no rows.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, windows = TaskContext.get().partitionId() << 40, OpenWindows(size)
        held: list[tuple[int | None, bytes]] = []
        n_held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            pieces = [(d, s, min(size, len(ids) // 4 - s), ids) for d, ids in held for s in range(0, len(ids) // 4, size)]
            pieces.sort(key=lambda p: -p[2])
            for at in range(0, len(pieces), 2_000):
                part = pieces[at : at + 2_000]
                places = [windows.place(p[2]) for p in part]
                columns = [
                    [p[0] for p in part], [p[1] for p in part], [p[2] for p in part], [len(p[3]) // 4 for p in part],
                    [base + w for w, _ in places], [o for _, o in places],
                ]
                ids = pa.array([p[3][4 * p[1] : 4 * (p[1] + p[2])] for p in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), ids], names=names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, 512):
                for doc_id, ids in zip(ids_of[at : at + 512], encode(texts.slice(at, 512).to_pylist()), strict=True):
                    held.append((doc_id, ids + end))
                    n_held += len(ids) // 4 + 1
                    if n_held >= block_ids:
                        yield from packed()
                        held, n_held = [], 0
        yield from packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
