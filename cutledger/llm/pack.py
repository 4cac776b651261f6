"""Packing into sequences by Karmarkar-Karp multiway differencing, in one pass without a shuffle."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import text_of
from cutledger.llm.tokens import END, encoder, runs, vocabulary_path

CAPACITY = 1024
#: Pieces of what is left of a document after its whole windows are at most this long.
PIECE = 256
#: Windows of one block, and tokens that a block leaves free so that near-equal windows all fit.
WINDOWS, FREE = 64, 48
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows so that their sums come out nearly equal; indexes by window.

    Every item begins as a partial partition of its own: itself in one window, nothing in the
    others. The two partial partitions with the largest imbalance are merged, the fullest window
    of one with the emptiest of the other, and so on, until one is left.
    """
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = s
        heap.append((-s if k > 1 else 0, i, sums, {k - 1: [i]}))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        sums = a + b[::-1]
        for w, items in ib.items():
            ia.setdefault(k - 1 - w, []).extend(items)
        order = np.argsort(sums, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        sums = sums[order]
        n += 1
        heapq.heappush(heap, (int(sums[0] - sums[-1]), n, sums, {int(place[w]): items for w, items in ia.items()}))
    return list(heap[0][3].values()) if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows; their number rises for as long as one would exceed the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, k)
        if max((sum(sizes[i] for i in w) for w in dealt), default=0) <= capacity:
            return dealt
        k += 1


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Lengths of a document's pieces: whole windows, then pieces of one length, then what is left."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [piece] * (rest // piece) + [rest % piece] * (rest % piece > 0)


class Packer:
    """Takes documents one by one and gives finished sequences, holding one block of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.room = capacity, WINDOWS * capacity - FREE
        self.held: list[tuple] = []
        self.total = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list[tuple]]:
        start, n = 0, len(ids)
        for length in cut(n, self.capacity):
            while length:
                now = min(length, self.room - self.total) if length < self.capacity else length
                piece = (doc, start, now, zlib.crc32(ids[start : start + now].astype("<u4").tobytes()), n)
                start, length = start + now, length - now
                if now == self.capacity:
                    yield [piece]
                    continue
                self.held.append(piece)
                self.total += now
                if self.total == self.room:
                    yield from self.flush()

    def flush(self) -> Iterator[list[tuple]]:
        held, self.held, self.total = self.held, [], 0
        for w in windows([p[2] for p in held], self.capacity):
            if w:
                yield [held[i] for i in w]


def _pack(path: str, capacity: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, packer = encoder(path), Packer(capacity)
    end, names = np.array([END], encode.dtype).tobytes(), [x.split()[0] for x in SCHEMA.split(", ")]
    number, rows = TaskContext.get().partitionId() << 32, []

    def place(sequences: Iterable[list[tuple]]) -> None:
        nonlocal number
        for pieces in sequences:
            at = 0
            for p in pieces:
                rows.append((*p, number, at))
                at += p[2]
            number += 1

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b in runs(pc.utf8_length(texts).to_pylist()):
            for doc, ids in zip(docs[a:b], encode(texts.slice(a, b - a).to_pylist()), strict=True):
                place(packer.add(doc, np.frombuffer(ids + end, encode.dtype)))
            if len(rows) > 20_000:
                yield out()
    place(packer.flush())
    if rows:
        yield out()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: empty) and the end id. Whole windows of it are
    sequences of their own; the rest is cut into pieces that each task packs, a block of WINDOWS
    windows at a time, so memory is bounded and nothing is shuffled. A sequence's id holds the
    number of its partition and its number there. Rows are packed as they are: a null doc_id
    stays null, a repeated row is packed again. A table without rows gives none.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(partial(_pack, path or vocabulary_path(), capacity), SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
