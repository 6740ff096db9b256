"""Packing: documents into windows of token ids by sum-of-squares online packing.

A document's full windows stand alone. Its tail goes to the fill level for which the sum of squares of the counts of
partially filled windows, by level, is least (a level array of counts; ties go to the fuller window). Each partition
packs what it reads, so that nothing is shuffled. However many windows stay open, each piece is placed so; a task's memory is bounded by the
text of its partition. At the end of a partition, the fullest open windows are completed by cutting the pieces of the
emptiest ones, and the last remainder is cut at powers of two, which need no padding.

Cases: null text counts as empty: its end id alone; null and repeated doc_ids are kept as they are; an empty table has
no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common

WINDOW = 1024
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Places pieces ``(doc_id, start, ids, doc_tokens)``; ``done`` gathers them with their sequence and offset."""

    def __init__(self, window: int, first_sequence: int = 0):
        self.window, self.next_id = window, first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, ids, total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        w, total = self.window, len(ids)
        full = total // w * w
        for start in range(0, full, w):
            self.emit([(doc_id, start, ids[start : start + w], total)])
        if full < total:
            self.place((doc_id, full, ids[full:].copy(), total))  # an open window doesn't hold a whole slice

    def place(self, piece: tuple) -> None:
        w, counts, size = self.window, self.counts, len(piece[2])
        levels = counts[: w - size + 1]
        change = 1 + 2 * counts[size:]
        change[-1] = 0  # a full window is no longer counted
        change = change - 2 * levels + 1
        change[1:][levels[1:] == 0] = 1 << 60
        change[0] -= 1  # a new window leaves no level
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        pieces = self.open[level].pop() if level else []
        pieces.append(piece)
        if level:
            counts[level] -= 1
        if level + size == w:
            self.emit(pieces)
        else:
            self.open[level + size].append(pieces)
            counts[level + size] += 1

    def close(self) -> None:
        """Fills the fullest open windows with what the emptiest hold, and ends the one left over."""
        bins = [p for level in sorted(self.open, reverse=True) for p in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        pool: list[tuple] = []
        low, high = 0, len(bins)
        while low < high:
            pieces = bins[low]
            low += 1
            gap = self.window - sum(len(p[2]) for p in pieces)
            while gap and (pool or low < high):
                if not pool:
                    high -= 1
                    pool = bins[high]
                doc_id, start, ids, total = pool.pop()
                pieces.append((doc_id, start, ids[:gap], total))
                if len(ids) > gap:
                    pool.append((doc_id, start + gap, ids[gap:], total))
                gap -= len(pieces[-1][2])
            self._end(pieces, gap)
        if pool:
            self._end(pool, self.window - sum(len(p[2]) for p in pool))

    def _end(self, pieces: list, gap: int) -> None:
        if not gap:
            self.emit(pieces)
            return
        while pieces:
            size = 1 << (sum(len(p[2]) for p in pieces).bit_length() - 1)
            own = []
            while size:
                doc_id, start, ids, total = pieces.pop(0)
                own.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    pieces.insert(0, (doc_id, start + size, ids[size:], total))
                size -= len(own[-1][2])
            self.emit(own)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row a piece; ``ids`` are its ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        bpe = byte_bpe.loaded(tokenizer_path)
        packer, end = SumOfSquares(window, TaskContext.get().partitionId() << 36), np.array(end_id, bpe.dtype)

        def rows():
            done, packer.done = packer.done, []
            cols = list(zip(*done)) if done else [[]] * 6
            arrays = [
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([len(x) for x in cols[2]], pa.int64()),
                pa.array([x.astype("<u4").tobytes() for x in cols[2]], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        with common.task_memory(bpe):
            for b in batches:
                keys, texts = b.column(0).to_pylist(), b.column(1)
                for low, high in byte_bpe.slices(texts):
                    ids, at = bpe.encode(texts.slice(low, high - low))
                    for key, start, stop in zip(keys[low:high], at.tolist(), at[1:].tolist()):
                        packer.add(key, np.append(ids[start:stop], end))
                    yield rows()
            packer.close()
            yield rows()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.documents(spark, sf_dir), byte_bpe.default_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
