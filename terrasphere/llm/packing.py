"""Sum-of-squares online packing of token sequences into windows of one length.

Every document is cut into whole windows and a rest; a rest goes, as it comes, to the fill level that makes the sum
of squared numbers of partly filled windows smallest (a new window is level 0), with those numbers kept in one array
per task. At the end of a task pieces of its emptiest windows fill the gaps of the fullest, whose contents stay where they were
placed, and the one window left over is cut into sequences whose lengths are powers of two, which need no padding. A task packs what
it reads: no shuffle, a window never spans tasks, and a lost task is simply packed again.

NULL and empty texts are one end id; repeated rows are packed as often as they come; an empty table gives no pieces;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.tables import pieces, table
from terrasphere.llm.tokens import encoder, vocabulary

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces (doc, start, ids, doc_tokens) and hands out finished windows as lists of pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # partly filled windows by level; 0 and capacity stay 0
        self.open: list[list] = [[] for _ in range(capacity)]

    def place(self, piece) -> list | None:
        """Put one piece of less than the capacity; returns the window if that filled it."""
        size = len(piece[2])
        top = self.capacity - size
        levels = np.arange(1, top + 1)
        cost = np.where(self.count[1 : top + 1] > 0, self.count[levels + size] - self.count[1 : top + 1], self.capacity << 32)
        level, best = 0, self.count[size]  # a new window adds 2 n + 1, a used level another 1 - 2 n
        if top:
            i = top - 1 - int(np.argmin(cost[::-1]))
            # closing a window subtracts 2 n - 1 only, so it wins ties
            if 2 * cost[i] + 2 - (levels[i] == top) <= 2 * best + 1:
                level = int(levels[i])
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.count[level + size] += 1
        self.open[level + size].append(window)
        return None

    def finish(self) -> Iterator[list]:
        """The open windows, fullest first. Pieces of the emptiest go into their gaps; what was placed in a window stays
        there. The one window that is left over is cut into lengths that are powers of two."""
        windows = [w for level in reversed(range(self.capacity)) for w in self.open[level]]
        gaps = [self.capacity - level for level in reversed(range(self.capacity)) for _ in self.open[level]]
        at, giving = 0, len(windows) - 1
        while at < giving:
            doc, start, ids, n = windows[giving].pop()
            here = min(len(ids), gaps[at])
            windows[at].append((doc, start, ids[:here], n))
            gaps[at] -= here
            if here < len(ids):
                windows[giving].append((doc, start + here, ids[here:], n))
            elif not windows[giving]:
                giving -= 1
            if not gaps[at]:
                yield windows[at]
                at += 1
        if at > giving or not windows:
            return
        left = windows[at]
        total = sum(len(p[2]) for p in left)
        for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
            window = []
            while size:
                doc, start, ids, n = left[0]
                window.append((doc, start, ids[:size], n))
                if len(ids) > size:
                    left[0] = (doc, start + size, ids[size:], n)
                    size = 0
                else:
                    left.pop(0)
                    size -= len(ids)
            yield window


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit), its window and its place there."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer, part, made = encoder(path), Packer(capacity), 0, 0

        def rows(windows):
            nonlocal made
            cols: list[list] = [[] for _ in range(7)]
            for window in windows:
                at = 0
                for doc, start, ids, n in window:
                    for col, v in zip(cols, (doc, start, len(ids), ids.astype("<u4").tobytes(), n, (part << 32) + made, at)):
                        col.append(v)
                    at += len(ids)
                made += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in pieces(batches, "text"):
            ids, bounds = known.encode(batch.column("text"))
            part, done = batch.column("part")[0].as_py(), []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                n, whole = b - a, (b - a) // capacity * capacity
                done += [[(doc, s, ids[a + s : a + s + capacity], n)] for s in range(0, whole, capacity)]
                if whole < n and (full := packer.place((doc, whole, ids[a + whole : b].copy(), n))):
                    done.append(full)
            yield rows(done)
        yield rows(packer.finish())

    return docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, one row per piece."""
    return describe(pack(table(spark, sf_dir, "documents")))


def describe(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
