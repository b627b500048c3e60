"""Fingerprints of texts by consistent weighted sampling of their words.

A text is a weighted set: its words with their counts. For each of K samples every word draws gamma
variables r and c (shape 2) and a uniform b from its own hash; its weight w is rounded down to a step
t = floor(ln w / r + b) of the word's own scale, and the word with the least ln c - r (t - b) - r is
sampled with its t. Two texts sample the same with a probability that is their generalised Jaccard
similarity, sum of min weights over sum of max weights: with K samples, their share of equal ones has a
standard error of at most 1 / (2 sqrt(K)), 0.0625 for 64. Draws are 32-bit floats: fingerprints are
equal on machines whose numpy gives equal logarithms, and should be compared among such only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import partitions
from .tables import doc_id, keyed, saved
from .words import ALNUM, mix, split_words

SAMPLES = 64
_GROUP_BYTES = 2 << 20


def _uniform(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) from each 64-bit value."""
    scale = np.float32(2.0**-24)
    low = ((seed & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale
    return low, ((seed >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * scale


def _draws(terms: np.ndarray, counts: np.ndarray, samples: int) -> np.ndarray:
    """The value of each term with its count in each sample (terms x samples); the least is sampled."""
    streams = np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((len(terms), samples), np.float32)
    log_w = np.log(counts.astype(np.float32))
    for a in range(0, len(terms), 4096):
        seed = mix(terms[a : a + 4096, None] + streams)
        u1, u2 = _uniform(seed)
        u3, u4 = _uniform(mix(seed + np.uint64(1)))
        b = (((seed >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        r, c = -np.log(u1 * u2), -np.log(u3 * u4)
        t = np.floor(log_w[a : a + 4096, None] / r + b)
        out[a : a + 4096] = np.log(c) - r * (t - b) - r
    return out


def fingerprints(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit sample names for each text; all 0 for a text without words."""
    out = np.zeros((len(texts), samples), np.uint16)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = split_words(np.frombuffer(b"".join(texts), np.uint8), offsets, ALNUM)
    for low in range(0, len(texts), 1 << 14):
        high = min(low + (1 << 14), len(texts))
        a, b = words.first[low], words.first[high]
        if a == b:
            continue
        row = np.repeat(np.arange(high - low), np.diff(words.first[low : high + 1]))
        places, n = np.unique((row.astype(np.uint64) << np.uint64(48)) | (words.hash[a:b] >> np.uint64(16)), return_counts=True)
        # counts by rank: 1 << 16 different ones would take 2**31 words, more than a batch can hold
        counts, rank = np.unique(n, return_inverse=True)
        kinds, which = np.unique((places << np.uint64(16)) | rank.astype(np.uint64), return_inverse=True)
        values = _draws(mix(kinds >> np.uint64(16)), counts[kinds & np.uint64(0xFFFF)], samples)
        rows, start = np.unique(places >> np.uint64(48), return_index=True)
        ends = np.append(start[1:], len(places))
        at = 0
        while at < len(rows):  # as many texts at once as keep the gathered values small
            to = max(at + 1, int(np.searchsorted(ends, start[at] + 60_000)))
            least = np.minimum.reduceat(values[which[start[at] : ends[to - 1]]], start[at:to] - start[at], axis=0)
            names = mix(least.view(np.uint32).astype(np.uint64)) % np.uint64(0xFFFF) + np.uint64(1)
            out[low + rows[at:to].astype(np.int64)] = names.astype(np.uint16)
            at = to
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples: an estimate of the generalised Jaccard similarity. Texts without words are like each other only."""
    return (a == b).mean(-1)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many (or all) of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROWS = pa.schema([
    ("key", pa.int64()), ("salt", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("task", pa.int32()), ("end", pa.int32()), ("text", pa.string()),
])
_SPARK_ROWS = "key long, salt long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, task int, end int, text string"
_FIRST, _LAST = 0, 1


def _compared(rows: list[tuple], following: str, samples: int) -> Iterator[pa.RecordBatch]:
    """Results for consecutive rows (key, salt, text); ``following`` is the text after the last."""
    texts = [r[2] for r in rows] + [following]
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    raw = [t.encode() for t in changed]
    prints = fingerprints([t.encode() for t in texts] + raw, samples)
    own, other = prints[: len(texts)], prints[len(texts) :]
    n = len(rows)
    yield pa.record_batch([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(
            [len(t) for t in texts[:-1]], pa.int64()
        ),
        pa.array(
            [hashlib.sha256(t).hexdigest() for t in raw]
        ), pa.array([p.tobytes() for p in own[:-1]], pa.binary()), pa.array([p.tobytes() for p in other], pa.binary()),
        pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()),
    ], schema=_ROWS)


def compare_with_next(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``edited``), and how alike they are.

    The next document is that with the next greater doc_id (nulls come first; rows of one doc_id are
    ordered by a hash of their text), for the last one the first. A null text counts as empty. Returns
    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` (binary, two
    bytes a sample), ``near_edited``, ``near_next``. A single row follows itself; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, seen = TaskContext.get().partitionId(), [], 0, False

        def end(row: tuple, which: int) -> pa.RecordBatch:
            return pa.record_batch(
                [
                    pa.array([v], f.type) for v,
                    f in zip((row[0], row[1], None, None, None, None, None, None, task, which, row[2]), _ROWS, strict=True)
                ],
                schema=_ROWS
            )

        for batch in batches:
            for row in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), (t.as_py() or "" for t in batch.column(2)),
                strict=True
            ):
                if not seen:
                    seen = True
                    yield end(row, _FIRST)
                if size >= _GROUP_BYTES:
                    yield from _compared(held, row[2], samples)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if len(held) > 1:
            yield from _compared(held[:-1], held[-1][2], samples)
        if held:
            yield end(held[-1], _LAST)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, salt, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _compared([(key, salt, text)], following, samples)

    ordered = keyed(documents).select("key", "salt", "text").repartitionByRange(partitions(documents), "key", "salt").sortWithinPartitions("key", "salt")
    found = saved(ordered.mapInArrow(run, _SPARK_ROWS))
    # a task's last row needs the first one of the next task that has rows; only task numbers reach the driver
    tasks = sorted(r.task for r in found.where(F.col("end") == _FIRST).select("task").toLocalIterator())
    done = found.where("end is null")
    if tasks:
        after = documents.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, after int")
        last = found.where(F.col("end") == _LAST).select("task", "key", "salt", "text").join(after, "task")
        first = found.where(F.col("end") == _FIRST).select(F.col("task").alias("after"), F.col("text").alias("following"))
        done = done.unionByName(last.join(first, "after").select("key", "salt", "text", "following").mapInArrow(join_ends, _SPARK_ROWS))
    return done.select(doc_id(), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
