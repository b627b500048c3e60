"""Spelling variants: words one edit apart, found by a frontier of states on a trie that is a table.

A state is (word, position, node, edits): where in a trie of all words the rest of a word is still to be
read. The trie is a table of edges (node, label, child), dealt out over the cluster; a label is a run of 1, 2, 4, ...
characters, so that a rest of n characters takes one join for each bit of n. A word's own path needs no
join, as a node is named by its prefix: the frontier starts with all states of one edit. There are two tries, of
words and of reversed words, and each takes the edits in the half of a word that it reads last: few words
share the node where an edit begins, so the frontier stays narrow. An insertion is a deletion in the other word.

Nodes and labels are 64-bit hashes under a key drawn for each call. Where two of them clash all children are
kept, and each pair is compared as strings at the end, so a clash costs time and changes nothing.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved
from .words import Chunk, chunks, mix

#: Distinct words held back in a task before they are sent, and bytes of words worked on at once.
HELD, TRIE_BYTES = 1_000_000, 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LEAD = 0xC3  # begins the UTF-8 bytes of U+00C0 to U+00FF, and of no other letter here


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BEGINS = np.zeros(256, bool)
_BEGINS[0x61:0x7B] = _BEGINS[_LEAD] = True


def _crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end], continued from the value before it; a byte of all of them at a time, long ones alone."""
    out, size = np.empty(len(start), np.uint32), end - start
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(size <= 64)
    short = short[np.argsort(-size[short], kind="stable")]
    start, size, crc = start[short], size[short], ~before[short]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        crc[:n] = _CRC[(crc[:n] ^ data[start[:n] + k]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out[short] = ~crc
    return out


def _runs(chunk: Chunk, least: int) -> tuple[np.ndarray, ...]:
    """Folded bytes of a chunk, and start, end and text of each run of at least so many letters."""
    data = _FOLD[chunk.data]
    lead = data == _LEAD
    letter = _BEGINS[data]
    letter[1:] |= lead[:-1]
    before, after = np.zeros_like(letter), np.zeros_like(letter)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    full = np.flatnonzero(np.diff(chunk.offsets))
    before[chunk.offsets[:-1][full]] = False
    after[chunk.offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    long = end - start - leads[end] + leads[start] >= least
    start, end = start[long], end[long]
    return data, start, end, np.searchsorted(chunk.offsets, start, "right") - 1


def word_counts(documents: DataFrame, least_length: int = 5, least_count: int = 3, slip: int | None = None) -> DataFrame:
    """(word, n): how often each word occurs in all whole texts, for words of so many code points and occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. Null texts have none. With
    ``slip``, runs whose hash (crc32 of doc_id, colon and run) it divides lose one code point, the one at
    hash % length: misspellings that can be told again. A null doc_id is hashed as no characters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for chunk in chunks(batches):
            data, start, end, row = _runs(chunk, least_length)
            slipped = []
            if slip:
                ids = [zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i)) for i in chunk.rows.column(0).to_pylist()]
                hashes = _crc32(data, start, end, np.array(ids, np.uint32)[row])
                hit = hashes % np.uint32(slip) == 0
                for a, b, h in zip(start[hit].tolist(), end[hit].tolist(), hashes[hit].tolist(), strict=True):
                    word = data[a:b].tobytes().decode()
                    slipped.append(word[: h % len(word)] + word[h % len(word) + 1 :])
                start, end = start[~hit], end[~hit]
            size = end - start
            stop = np.cumsum(size)
            source = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size - start, size)
            words = pa.LargeStringArray.from_buffers(
                len(size), pa.py_buffer(np.concatenate([[0], stop]).astype(np.int64)), pa.py_buffer(data[source])
            )
            slipped = pa.array([w for w in slipped if len(w) >= least_length], pa.large_string())
            counts = pc.value_counts(pa.concat_arrays([words, slipped]))
            held.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
            n += len(counts)
            if n > HELD:
                held = [_summed(held)]
                n = 0 if len(held[0]) > HELD // 2 else len(held[0])
                if not n:
                    yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _summed(held).to_batches(1 << 16)

    rows = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": out["word"].cast(pa.large_string()), "n": out["n_sum"].cast(pa.int64())})


class _Side:
    """The words of a chunk in one direction: names of their prefixes and of any run inside them, in closed form.

    ``half`` characters of a word are read without an edit.
    """

    def __init__(self, words: list[str], key: tuple[int, int], reverse: bool) -> None:
        text = "".join(words[::-1] if reverse else words).encode("utf-32-le")
        self.flat = np.frombuffer(text, np.uint32)[:: -1 if reverse else 1]
        self.size, self.reverse = np.fromiter(map(len, words), np.int64, len(words)), reverse
        self.begin = np.cumsum(self.size) - self.size
        self.half = self.size - self.size // 2 if reverse else self.size // 2
        longest = int(self.size.max(initial=0))
        self.inverse = _powers(pow(key[0] | 1, -1, 1 << 64), longest)
        place = np.arange(len(self.flat)) - np.repeat(self.begin, self.size)
        terms = mix(self.flat + np.full(1, key[1], np.uint64)) * _powers(key[0] | 1, longest)[place]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.salt = mix(np.full(1, key[1] ^ (2 + reverse), np.uint64))

    def places(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and positions from each word's half to ``last``."""
        n = np.maximum(last - self.half + 1, 0)
        word = np.repeat(np.arange(len(n)), n)
        return word, np.arange(len(word)) - np.repeat(np.cumsum(n) - n - self.half, n)

    def node(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Names of the prefixes of k characters."""
        begin = self.begin[word]
        return mix(self.sums[begin + k] - self.sums[begin] + self.salt)

    def label(self, word: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Names of the n characters from position k on."""
        at = self.begin[word] + k
        return mix((self.sums[at + n] - self.sums[at]) * self.inverse[k] + n.astype(np.uint64) * _ODD)

    def node_and_rest(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Names of a prefix together with the number of characters that the word has after it."""
        return mix(self.node(word, k) + (self.size[word] - k).astype(np.uint64) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


def _edges(side: _Side, _: Chunk):
    """(node, label, child) of all runs of 1, 2, 4, ... characters from the half of a word on."""
    stride = 1
    while stride <= int((side.size - side.half).max(initial=0)):
        word, k = side.places(side.size - stride)
        yield side.node(word, k), side.label(word, k, np.full(len(k), stride)), side.node(word, k + stride)
        stride *= 2


def _branches(side: _Side, _: Chunk):
    """(place, other, child): what a node has for a next character, by the number of characters after it."""
    word, k = side.places(side.size - 1)
    yield side.node_and_rest(word, k), side.flat[side.begin[word] + k].astype(np.int32), side.node(word, k + 1)


def _states(steps: int):
    def make(side: _Side, chunk: Chunk):
        """(key, node, place, letter, first, label of each step) of all places of an edit."""
        word, k = side.places(side.size - 1)
        at = side.begin[word] + k
        # equal characters in a row: it is the word's first of them that may go
        inside, beside = (k < side.size[word] - 1, at + 1) if side.reverse else (k > 0, at - 1)
        repeats = inside & (side.flat[np.minimum(beside, len(side.flat) - 1)] == side.flat[at])
        rest, to, labels = side.size[word] - k - 1, k + 1, []
        for _ in range(steps):
            # the largest power of two that is left
            n = np.where(rest > 0, np.int64(1) << np.maximum(np.frexp(rest)[1] - 1, 0), 0)
            labels.append(pa.array(side.label(word, to, n).view(np.int64), mask=rest == 0))
            rest, to = rest - n, to + n
        yield chunk.column("key")[word], side.node(word, k), side.node_and_rest(word, k), side.flat[at].astype(np.int32), ~repeats, *labels

    return make


def _ends(side: _Side, chunk: Chunk):
    """(node, word, n) of whole words."""
    everything = np.arange(len(side.size))
    yield side.node(everything, side.size), chunk.rows.column(0), chunk.column("n")


def _made(words: DataFrame, key: tuple[int, int], make, schema: str) -> DataFrame:
    """Rows that ``make(side, chunk)`` gives, as columns, for the words of a chunk in either direction."""
    names = [c.split()[0] for c in schema.split(", ")]

    def arrow(column) -> pa.Array:
        return column if isinstance(column, pa.Array) else pa.array(column.view(np.int64) if column.dtype == np.uint64 else column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "word", TRIE_BYTES):
            texts = chunk.rows.column(0).to_pylist()
            for reverse in (False, True):
                for columns in make(_Side(texts, key, reverse), chunk):
                    yield pa.record_batch([arrow(c) for c in columns], names)

    return words.mapInArrow(run, schema)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of distinct words that differ by one inserted, deleted or replaced code point.

    ``words`` has one row a word, with a count n that goes along; null and empty words are near nothing.
    """
    key = (secrets.randbits(64), secrets.randbits(64))
    words = saved(words.where("word != ''").select("word", F.col("n").cast("long").alias("n"), F.xxhash64("word").alias("key")))
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    # most bits that are set in the number of characters after an edit
    steps = (longest - longest // 2).bit_length() - 1 if longest else 0
    labels = [f"l{i}" for i in range(steps)]
    # dealt out by what the joins look up; equal rows meet there too
    edges = _made(words, key, _edges, "node long, label long, child long").repartition("node", "label").distinct()
    branches = _made(words, key, _branches, "place long, other int, child long").repartition("place").distinct()
    schema = ", ".join(["key long, node long, place long, letter int, first boolean", *(f"{c} long" for c in labels)])
    begun = _made(words, key, _states(steps), schema)
    deleted = begun.where("first").select("key", "node", *labels)
    # of two words that differ in one character, that with the lesser one looks for the other
    replaced = begun.join(branches, "place").where("other > letter").select("key", F.col("child").alias("node"), *labels)
    states = deleted.unionByName(replaced)
    for i, label in enumerate(labels):
        known = edges.withColumnRenamed("label", label)
        moved = states.join(known, ["node", label], "left").where(f"{label} is null or child is not null")
        states = moved.select("key", F.coalesce("child", "node").alias("node"), *labels[i + 1 :])
    ends = _made(words, key, _ends, "node long, near string, near_n long")
    pairs = states.join(ends, "node").join(words, "key").where(F.levenshtein("word", "near", 1) == 1)
    # either of the two is near the other
    return pairs.selectExpr("stack(2, word, n, near, near_n, near, near_n, word, n) as (word, n, near, near_n)")


def variants(words: DataFrame) -> DataFrame:
    """Every word with its form and root: word, n, n_near, form, form_n, root.

    ``n_near`` counts near words. The form is the near word of largest n (of equal ones the first in code-point
    order) if that is at least twice the word's n, else null. Forms are followed from word to word; the last is the
    root, the word itself if it has no form. As counts at least double on the way, there are no rings.
    """
    words = saved(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    has = -F.col("best.less") >= 2 * F.col("n")
    out = saved(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"),
            F.when(has, -F.col("best.less")).alias("form_n"),
        )
    )
    # each round doubles the way that is behind: a word's root so far is asked for its own
    up = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = saved(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            break
        up = up.drop("moved")
    return out.join(up.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))
