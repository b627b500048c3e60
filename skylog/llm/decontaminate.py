"""Finds benchmark passages in documents by a prefix-filtered join of word shingles.

A window of a benchmark item occurs in a document only if all its shingles do, so its necessary
prefix is a single one: its rarest shingle, counted over all documents. Shingles of documents meet
these prefix tokens; the token's offset gives the one place where the window can start (positional
bound), which must leave room for all its words (length bound), and the whole word sequence decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keyed, doc_id, saved
from .words import ALNUM, chunks

SHINGLE = 3
#: Benchmark text that one pass over the documents holds in memory and broadcasts (with its windows about
#: seven times as many bytes); more takes more passes.
BLOCK_BYTES = 16 << 20
_TOKENS = bytes(b if not ALNUM.separator[b] else 0x20 for b in ALNUM.fold)


class _Block:
    """Windows of a bounded part of the benchmark, as arrays sorted by the hash of their prefix token."""

    def __init__(self, items: list[tuple], window: int) -> None:
        texts = pa.record_batch({"text": pa.array([t for _, t in items], pa.string())})
        self.ids, self.widths, self.parts = [i for i, _ in items], [], []
        self.text, self.start, self.end, self.vocabulary = b"", np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint64)
        for chunk in chunks([texts], limit=1 << 62):  # one chunk: all of the block
            words = chunk.words(ALNUM)
            self.text, self.start, self.end = chunk.data.tobytes(), words.start.astype(np.uint32), words.end.astype(np.uint32)
            counts, of = np.diff(words.first), words.text_of
            for size in np.unique(np.minimum(counts, window)):
                at = words.starts(int(size)) if size else words.starts(1)[:0]
                at = at[np.minimum(counts[of[at]], window) == size]
                if len(at):
                    width = min(SHINGLE, int(size))
                    tokens = words.runs(width)[at[:, None] + np.arange(size - width + 1)]
                    self.parts.append((at, words.runs(int(size))[at], of[at], np.full(len(at), size), tokens))
                    self.widths = sorted({*self.widths, width})
            if self.parts:
                self.vocabulary = np.unique(np.concatenate([p[4].ravel() for p in self.parts]))

    def order(self, counts: np.ndarray) -> None:
        """Chooses each window's prefix token: its rarest shingle, the first of equals. ``counts`` are those of the vocabulary."""
        columns = []
        for at, hashes, item, size, tokens in self.parts:
            best = np.argmin(counts[np.searchsorted(self.vocabulary, tokens)], axis=1)
            columns.append((tokens[np.arange(len(at)), best], best, hashes, size, item, at))
        del self.parts, self.vocabulary
        empty = (np.empty(0, np.uint64),) * 6
        prefix, offset, hashes, size, item, at = (np.concatenate(c) for c in zip(*(columns or [empty]), strict=True))
        by = np.argsort(prefix, kind="stable")
        self.prefix, self.hash = prefix[by], hashes[by]
        self.offset, self.size = offset[by].astype(np.int16), size[by].astype(np.int16)
        self.item, self.at = item[by].astype(np.int32), at[by].astype(np.int32)

    def words(self, window: int) -> list[bytes]:
        a = self.at[window]
        return self.text[self.start[a] : self.end[a + self.size[window] - 1]].translate(_TOKENS).split()


class _Lookup:
    """Which of many hashes are in a small sorted array: a bit table first, then a search."""

    def __init__(self, sorted_: np.ndarray) -> None:
        self.sorted, self.bits = sorted_, np.zeros(1 << 22, bool)
        self.bits[(sorted_ >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(self.sorted, hashes[maybe])
        return maybe[self.sorted[np.minimum(at, len(self.sorted) - 1)] == hashes[maybe]] if len(self.sorted) else maybe[:0]


def _token_counts(rows: DataFrame, block: _Block) -> np.ndarray:
    """How often each shingle of the block's vocabulary occurs in all documents."""
    held = rows.sparkSession.sparkContext.broadcast((block.vocabulary, block.widths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, widths = held.value
        found, total = _Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        for chunk in chunks(batches):
            words = chunk.words(ALNUM)
            for width in widths:
                _, hashes = words.windows(width)
                total += np.bincount(np.searchsorted(vocabulary, hashes[found(hashes)]), minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.record_batch({"token": pa.array(at), "times": pa.array(total[at])})

    out = np.zeros(len(block.vocabulary), np.int64)
    for r in rows.select("text").mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).toLocalIterator():
        out[r.token] = r.times
    return out


def _occurrences(rows: DataFrame, block: _Block) -> DataFrame:
    """key, salt, n_words, the hit word ranges and the items found, for every row."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        found = _Lookup(block.prefix)
        for chunk in chunks(batches):
            words = chunk.words(ALNUM)
            n, row_of = len(chunk.rows), words.text_of
            pairs, spans = [set() for _ in range(n)], [[] for _ in range(n)]
            for width in block.widths:
                at, hashes = words.windows(width)
                hit = found(hashes)
                low, high = np.searchsorted(block.prefix, hashes[hit]), np.searchsorted(block.prefix, hashes[hit], "right")
                times = high - low
                window = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                place = np.repeat(at[hit], times)
                row = row_of[place]
                start, size = place - block.offset[window], block.size[window]
                room = (start >= words.first[row]) & (start + size <= words.first[row + 1])
                window, start, size, row = window[room], start[room], size[room], row[room]
                same = words.spans(start, size) == block.hash[window]
                for w, s, k, r in zip(window[same], start[same], size[same], row[same], strict=True):
                    text = chunk.data[words.start[s] : words.end[s + k - 1]].tobytes().translate(_TOKENS).split()
                    if text == block.words(w):
                        if (item := block.ids[block.item[w]]) is not None:
                            pairs[r].add(item)
                        spans[r].append((s - words.first[r], s - words.first[r] + k))
            yield pa.record_batch({
                "key": pa.array(chunk.column("key")), "salt": pa.array(chunk.column("salt")), "n_words": pa.array(np.diff(words.first), pa.int64()),
                "spans": pa.array([_merged(s) for s in spans], _SPANS), "items": pa.array(
                    [sorted(p) for p in pairs], pa.list_(pa.string())
                ),
            })

    return rows.mapInArrow(find, "key long, salt long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], int(b))
        else:
            out.append({"start": int(a), "end": int(b)})
    return out


def _blocks(benchmark: DataFrame, window: int) -> Iterator[_Block]:
    """The benchmark in parts of bounded text, each brought to the driver on its own."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_BYTES) * 2 if total > BLOCK_BYTES else 1
    for i in range(parts):
        yield _Block([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()], window)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Words of documents inside any occurrence of a ``window``-word sequence of a benchmark item.

    An item of fewer words, but not none, is one window. Returns key columns, ``doc_id``, ``n_words``,
    ``spans`` (disjoint ranges of hit word positions, in order), ``n_hit`` and ``items`` (ids of items with
    occurring windows, of whatever type, as strings and sorted as such). Null texts have no words; items without words find nothing, and the windows
    of items without an id count as hits but name no item; several texts under one item_id all count for it; repeated rows get equal results. Every row comes
    back, hit or not. A benchmark of more than ``BLOCK_BYTES`` is joined in blocks.
    """
    rows = keyed(documents)
    out = None
    for block in _blocks(benchmark, window):
        block.order(_token_counts(rows, block))
        found = _occurrences(rows, block)
        out = found if out is None else _both(out, found)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("key", "salt", doc_id(), "n_words", "spans", hit.alias("n_hit"), "items")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Joins the results of two blocks; rows repeated as a whole have equal results in each."""
    more = saved(b.where("size(spans) > 0").groupBy("key", "salt").agg(F.first("spans").alias("s"), F.first("items").alias("i")))
    merge = F.aggregate(
        F.array_sort(F.concat("spans", F.coalesce("s", F.expr("cast(array() as array<struct<start:long,end:long>>)")))),
        F.expr("cast(array() as array<struct<start:long,end:long>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")
                    )
                )
            )
        ).otherwise(F.concat(done, F.array(s))),
    )
    items = F.array_sort(F.array_union("items", F.coalesce("i", F.expr("cast(array() as array<string>)"))))
    return a.join(more, ["key", "salt"], "left").select("key", "salt", "n_words", merge.alias("spans"), items.alias("items"))
