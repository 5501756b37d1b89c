"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every document becomes its ids and one closing id.  While at least a window's worth of a
document is left, whole windows are cut off it; they need no packing.  The rests, cut into
pieces of at most ``piece`` ids (one document in ``fine`` into halves of halves, so that
there are small ones to even the sums out), are gathered into blocks of about ``block_windows`` windows
and divided by the multiway differencing method of Karmarkar and Karp: every piece starts as
a partial partition (one sum per window, all but one zero); the two partitions with the
largest spread are merged, the largest sums of one onto the smallest of the other, until one
is left, with near-equal sums.  If its largest sum exceeds the capacity, the count of windows
rises and the block is divided again, so no window is ever too long and no piece is dropped.

A block holds at most ``block_windows`` windows of ids, so memory is bounded whatever the
documents' lengths or keys; blocks are formed where their documents are read, so nothing is
shuffled, and a lost task is made again from its own input split.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import SLICE
from .common import map_slices, strings

FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """For each size the window (0 to ``windows`` - 1) that multiway differencing gives it.

    Ties keep the order of the sizes, so the result is determined.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    left, right = [], []  # children of merged nodes, by node - n
    heap = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, np.array([s], dtype=np.int64), np.array([i], dtype=np.int64)))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        # a and b hold their sums above zero, the largest first; zeros take the opposite ones first
        over = len(a) + len(b) - windows
        if over > 0:
            x, y = a[len(a) - over :], b[len(b) - over :][::-1]
            xn, yn = an[len(an) - over :], bn[len(bn) - over :][::-1]
            left += xn.tolist()
            right += yn.tolist()
            sums = np.concatenate([a[: len(a) - over], b[: len(b) - over], x + y])
            nodes = np.concatenate([an[: len(an) - over], bn[: len(bn) - over], np.arange(made, made + over)])
            made += over
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([an, bn])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, int(nodes[0]), sums, nodes))
    window = np.empty(made, dtype=np.int64)
    roots = heap[0][3]
    window[roots] = np.arange(len(roots))
    for k in range(made - 1, n - 1, -1):  # a node is made after its children
        window[left[k - n]] = window[right[k - n]] = window[k]
    return window[:n]


def balance(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for the sizes, none above the capacity; as few windows as differencing reaches."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if len(sizes) == 0 or np.bincount(window, weights=sizes).max() <= capacity:
            return window
        windows += 1


def cut(length: int, piece: int, fine: bool) -> list[int]:
    """Sizes of the pieces of a rest: near-equal ones of at most ``piece``, or halves of halves if ``fine``."""
    if fine:
        out = []
        while length:
            out.append(-(-length // 2))
            length //= 2
        return out
    parts = -(-length // piece)
    return [(k + 1) * length // parts - k * length // parts for k in range(parts)]


class Packer:
    """Gathers pieces until a block is full; gives rows of plain columns."""

    def __init__(self, first_sequence: int, capacity: int, piece: int, block_windows: int, fine: int):
        self.sequence, self.capacity, self.piece, self.block = first_sequence, capacity, piece, capacity * block_windows
        self.documents, self.fine = 0, fine
        self.whole: list[tuple] = []
        self.rest: list[tuple] = []  # row, start, length, crc, doc tokens
        self.size = 0

    def add(self, row, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        raw = memoryview(ids).cast("B")
        while n - start >= self.capacity:
            crc = zlib.crc32(raw[4 * start : 4 * (start + self.capacity)])
            self.whole.append((row, start, self.capacity, crc, n, self.sequence, 0, self.capacity))
            self.sequence += 1
            start += self.capacity
        self.documents += 1
        for size in cut(n - start, self.piece, self.documents % self.fine == 0):
            stop = start + size
            self.rest.append((row, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), n))
            self.size += stop - start
            start = stop

    def take(self, end: bool) -> Iterator[tuple]:
        """Rows that are settled: whole windows, and blocks that are full (at the end all)."""
        yield from self.whole
        self.whole = []
        while self.rest and (end or self.size >= self.block):
            sizes, n = np.array([x[2] for x in self.rest], dtype=np.int64), len(self.rest)
            if self.size > self.block:
                n = max(1, int(np.searchsorted(np.cumsum(sizes), self.block, side="right")))
            window = balance(sizes[:n], self.capacity)
            totals = np.bincount(window, weights=sizes[:n]).astype(np.int64).tolist()
            filled = [0] * len(totals)
            for (row, start, length, crc, tokens), w in zip(self.rest[:n], window.tolist()):
                yield row, start, length, crc, tokens, self.sequence + w, filled[w], totals[w]
                filled[w] += length
            self.sequence += len(totals)
            self.rest = self.rest[n:]
            self.size -= int(sizes[:n].sum())


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, closing_id: int = 0, piece: int = 256, block_windows: int = 256, fine: int = 4) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``id_col``, start and length (in the document's ids), ids_crc32 (of the ids as
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence),
    sequence_tokens, and padded_tokens: the sequence's stored length, which is the capacity
    unless sequence_tokens is a power of two, which needs no padding.

    Ids are those of the tokenizers library with ``add_special_tokens=False``, then
    ``closing_id``.  A null or empty text is the closing id alone.  Ids of documents may be
    null or repeated: each row is a document of its own.  Other columns aren't read; an
    empty table gives an empty result.  A very long text makes as many whole pieces as it takes;
    pieces of equal length are taken in the order of their rows.  ``sequence_id`` is unique, not gapless: its high
    bits are the input partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import codec

        encode = codec(tokenizer_path).encode_once
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, piece, block_windows, fine)
        names = ["id", *(f.split()[0] for f in FIELDS.split(", "))]

        def rows(settled: Iterator[tuple], kind: pa.DataType) -> pa.RecordBatch | None:
            columns = list(zip(*settled))
            if not columns:
                return None
            held = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:]]
            total = np.array(columns[7], dtype=np.int64)
            padded = np.where(total & (total - 1) == 0, total, capacity)
            return pa.RecordBatch.from_arrays([*held, pa.array(padded)], names)

        kind: list[pa.DataType] = []

        def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
            kind[:] = [b.column(0).type]
            for row, ids in zip(b.column(0).to_pylist(), encode(strings(b.column(1)))):
                packer.add(row, np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(closing_id)))
            return rows(packer.take(end=False), kind[0])

        yield from map_slices(batches, "text", work, SLICE)
        if kind:
            last = rows(packer.take(end=True), kind[0])
            if last is not None:
                yield last

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)
