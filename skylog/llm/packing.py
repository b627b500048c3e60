"""Packs documents into token sequences of a fixed length, by large-item matching and best fit.

Lengths are whole numbers up to the capacity, so a packing is decided on the histogram of lengths
alone: at most ``capacity`` counts reach the driver, however many documents there are. Pieces above
a third of the capacity go at most two to a sequence, by a greedy matching in descending order: each takes
the largest partner that fits, or the partner whose gap a shorter piece fills best, which then comes along,
whichever way takes fewer sequences in all. The shorter ones then go, in descending order, to the smallest
gap that holds them. The plan names ranges of ranks within a length; each piece finds its place by its own rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import partitions
from .tables import saved
from .tokens import default_path, encoder

#: Ends every document.
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Gaps:
    """Open sequences by their gap: ranges of sequence numbers that are filled alike."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def put(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in self.ranges:
                insort(self.sizes, gap)
                self.ranges[gap] = []
            self.ranges[gap].append((first, n))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """A range with the smallest gap that holds the length: gap, first sequence, number of sequences."""
        i = bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, n = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap], self.sizes[i]
        return gap, first, n


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, pieces a sequence, offset) that place all pieces.

    Rank ``first rank + j`` of a length goes to sequence ``first sequence + j // pieces`` at
    ``offset + (j % pieces) * length``.
    """
    return min((_planned(counts, capacity, fill) for fill in (False, True)), key=lambda found: found[1])[0]


def _planned(counts: dict[int, int], capacity: int, fill: bool) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The runs and the number of sequences; with ``fill``, partners are chosen by the gaps that shorter pieces fill."""
    runs, gaps, sequences = [], _Gaps(), 0
    left = {n: c for n, c in counts.items() if c and 3 * n > capacity}
    free = {n: c for n, c in counts.items() if c and 3 * n <= capacity}
    short = np.array(sorted(free), np.int64)
    rank = dict.fromkeys(counts, 0)

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], n, sequence, each, offset))
        rank[length] += n

    lengths = sorted(left)
    while lengths:
        a = lengths[-1]
        i = bisect_left(lengths, capacity - a + 1) - 1
        if fill and i >= 0 and len(short):
            room = capacity - a - np.array(lengths[: i + 1])
            at = np.searchsorted(short, room, "right") - 1
            i -= int(np.argmin((room - np.where(at >= 0, short[at], 0))[::-1]))
            b, most = lengths[i], left[a] // 2 if lengths[i] == a else min(left[a], left[lengths[i]])
            if at[i] >= 0 and most:
                third = int(short[at[i]])
                n = min(most, free[third])
                if a == b:
                    place(a, 2 * n, sequences, 2, 0)
                else:
                    place(a, n, sequences, 1, 0)
                    place(b, n, sequences, 1, a)
                place(third, n, sequences, 1, a + b)
                left[a] -= n
                left[b] -= n
                free[third] -= n
                gaps.put(capacity - a - b - third, sequences, n)
                sequences += n
                short = short if free[third] else short[short != third]
                lengths = [x for x in lengths if left[x]]
                continue
        if i < 0:
            n, used = left[a], a
            place(a, n, sequences, 1, 0)
            left[a] = 0
        elif lengths[i] == a:
            n, used = left[a] // 2, 2 * a
            if n:
                place(a, 2 * n, sequences, 2, 0)
            left[a] -= 2 * n
            if left[a]:  # an odd one: the next shorter partner
                gaps.put(capacity - used, sequences, n)
                sequences += n
                n, used = 1, a + (lengths[i - 1] if i else 0)
                place(a, 1, sequences, 1, 0)
                if i:
                    place(lengths[i - 1], 1, sequences, 1, a)
                    left[lengths[i - 1]] -= 1
                left[a] = 0
        else:
            b = lengths[i]
            n, used = min(left[a], left[b]), a + b
            place(a, n, sequences, 1, 0)
            place(b, n, sequences, 1, a)
            left[a] -= n
            left[b] -= n
        gaps.put(capacity - used, sequences, n)
        sequences += n
        lengths = [x for x in lengths if left[x]] if 0 in (left[x] for x in {a, *lengths[max(0, i - 1) : i + 1]}) else lengths

    for length in sorted((n for n, c in free.items() if c), reverse=True):
        todo = free[length]
        while todo:
            gap, first, n = gaps.take(length) or (capacity, sequences, -(-todo // (capacity // length)))
            if gap == capacity:
                sequences += n
            each = gap // length
            full = min(n, todo // each)
            if full:
                place(length, full * each, first, each, capacity - gap)
                gaps.put(gap - each * length, first, full)
                todo -= full * each
            if full < n and todo < each:
                if todo:
                    place(length, todo, first + full, todo, capacity - gap)
                    gaps.put(gap - todo * length, first + full, 1)
                    full += 1
                    todo = 0
                gaps.put(gap, first + full, n - full)
    return runs, sequences


def tokenized(documents: DataFrame, capacity: int, path: str) -> DataFrame:
    """One row for each piece of each document; see ``PIECES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                start, piece = 0, 0
                while start < len(ids):
                    length = (len(ids) - start) % capacity or capacity
                    out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start, piece = start + length, piece + 1
            yield pa.record_batch(
                [
                    pa.array(c, k) for c,
                    k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Places every document's ids (by the tokenizer, and then ``END_ID``) in sequences of ``capacity``.

    Longer documents are cut so that only their first piece may be shorter than the capacity. Returns
    ``PIECES`` and ``sequence_id`` and ``offset``; sequences are filled without gaps from 0. A null or
    empty text has its end id alone; repeated rows are packed each; an empty table gives no rows.
    """
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(documents))).cast("int").alias("salt")
    pieces = saved(tokenized(documents, capacity, tokenizer or default_path())).select("*", salt)
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    runs = sorted(plan(histogram, capacity))
    held = documents.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))
    # rank within a length: the pieces of lesser salts, then the place among those of the same salt
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    firsts = counts.select("length", "salt", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.withColumn("place", place).join(firsts, ["length", "salt"]).select(
        *columns, (F.col("before") + F.col("place") - 1).alias("rank")
    )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        keys = table[:, 0] * (1 << 40) + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = table[np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1]
            j = rank - run[:, 1]
            placed = [pa.array(run[:, 3] + j // run[:, 4]), pa.array(run[:, 5] + j % run[:, 4] * length)]
            yield pa.record_batch([*batch.columns[:5], *placed], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(put, f"{PIECES}, sequence_id long, offset long")
