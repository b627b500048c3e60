"""Shuffles of many small fixed-width records, packed into one row for each task and partition.

Spark deals the rows out; numpy sorts and groups the records inside a task. A record costs its
own bytes only, where a row of its own would cost several times as much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "part int, data binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("data", pa.binary())])
#: Records are held back in a task up to this size, so that rows don't get too short.
BUFFER_BYTES = 8 << 20


#: Input that one partition takes, and the most partitions of a shuffle.
PARTITION_BYTES, MOST_PARTITIONS = 512 << 20, 100_000


def input_bytes(df: DataFrame) -> int:
    """Size of the files and tables that the rows come from; where Spark doesn't know it before it runs, bytes of text are counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if "text" in df.columns and any(x >= 1 << 60 for x in sizes):
        return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return sum(x for x in sizes if x < 1 << 60)


def partitions(df: DataFrame) -> int:
    """Partitions of a shuffle of the rows: spark.sql.shuffle.partitions, and more for large inputs."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-input_bytes(df) // PARTITION_BYTES), MOST_PARTITIONS))


def kinds_of(names: Sequence[str]) -> list[tuple[np.dtype, bool]]:
    """Types of columns, and whether their numbers stay whole: "u8=" is for hashes that repeat in neighbouring records."""
    return [(np.dtype(k.rstrip("=")), k.endswith("=")) for k in names]


def planes(column: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: bytes that hardly change cost next to nothing in a compressed shuffle."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(-1, column.itemsize).T.tobytes()


def from_planes(data, kind: np.dtype, n: int, at: int = 0) -> np.ndarray:
    """n numbers whose bytes begin at a place of the data."""
    return np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy(order="C").view(kind).ravel()


class Packer:
    """Collects records (numpy columns) with their partition and gives packed rows."""

    def __init__(self, parts: int, *kinds: str) -> None:
        self.parts, self.kinds, self.held, self.size = parts, kinds_of(kinds), [], 0

    def add(self, part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [np.ascontiguousarray(c, k) for c, (k, _) in zip(columns, self.kinds, strict=True)]
        self.held.append((part.astype(np.int32), *columns))
        self.size += sum(c.nbytes for c in columns)
        if self.size >= BUFFER_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        part, *columns = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(part, kind="stable")
        part, columns = part[order], [c[order] for c in columns]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=self.parts))
        data = [
            b"".join(c[a:b].tobytes() if whole else planes(c[a:b]) for c, (_, whole) in zip(columns, self.kinds, strict=True))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        if data:
            yield pa.record_batch([pa.array(part[cuts[:-1]], pa.int32()), pa.array(data, pa.binary())], schema=_SCHEMA)


def unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of one packed row."""
    types = kinds_of(kinds)
    n, at, out = len(data) // sum(k.itemsize for k, _ in types), 0, []
    for k, whole in types:
        out.append(np.frombuffer(data, np.uint8, n * k.itemsize, at).copy().view(k) if whole else from_planes(data, k, n, at))
        at += n * k.itemsize
    return out


def exchange(
    packed: DataFrame, kinds: tuple[str, ...], receive: Callable[..., Iterator[pa.RecordBatch]], schema: str, parts: int
) -> DataFrame:
    """Deals packed rows out to their partitions; ``receive`` gets the number and all records of one, as columns."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], 0
        for batch in batches:
            part = batch.column(0)[0].as_py()
            held += [unpack(x.as_buffer(), kinds) for x in batch.column(1)]
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            del held
            yield from receive(part, *columns)

    return packed.repartitionById(parts, "part").mapInArrow(gather, schema)


def uniform_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition by the upper 32 bits of a hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
