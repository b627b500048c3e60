"""Cross-entropy difference of documents under a target and a background language model.

Both models have the same form over one shared vocabulary, the words of all counted texts, and back off to
one shared distribution of all of them, so that a word or context that a model hasn't seen tells nothing:
the background is all texts but the target's, and the larger model's counts are scaled down to the smaller
one's total, so that both are as sure of what they have seen. With counts c of all texts, scaled counts s of
a model, and kinds of words,

    all(w) = (c(w) + 1) / (n + kinds + 1)
    all(w | v) = (c(v, w) + prior * all(w)) / (c(v) + prior)
    p(w | v) = weight * (s(v, w) + prior * all(w | v)) / (s(v) + prior) + (1 - weight) * (all(w) + s(w) / s(any)) / 2

where one place is kept for unknown words. The start of a text is a context like a word, its end the rest
of its last word's probability, so each context's probabilities add up to 1. Every word and every pair
keeps its own count. If one of the two has no words, the models are alike and all scores 0.

Counts are never brought together whole: documents are gathered in groups of bounded size, each group
asks the partitions by name that hold its words and pairs for their counts, and these add up and answer.
Rows that repeat doc_id and text are one row with a number, so they don't swell a group. A document's
score is the mean over its words of background loss minus target loss: the higher, the more it is like the
target. Words are hashed under a key drawn for each model, so no text can be written to clash with others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED, Packer, exchange, from_planes, input_bytes, partitions, planes, uniform_part
from .tables import doc_id, keyed, saved
from .words import LOWER, Words, WordStyle, chunks, join

#: Input of one group of documents; a document is never split.
GROUP_BYTES = 3 << 20
#: Words of a group that are scored at a time.
_SLICE = 1 << 16
#: Names of words are even, those of pairs odd; this one is the start of a text.
_START = np.uint64(0)
_PAIR = np.uint64(1)
#: ``data`` holds sorted names and, where they are counted, their counts in target and background, all as ``planes``.
_ROWS = "part int, chunk long, counted boolean, data binary"
#: Names that one row of a written model holds.
_ROW_NAMES = 1 << 19


class Totals(NamedTuple):
    """Words of the target and of all texts, and kinds of them."""

    target: int
    all: int
    kinds: int


@dataclass
class Models:
    """Counts of words and pairs in target and all texts, written by partition of their names, and how words are named."""

    counts: DataFrame
    parts: int
    totals: Totals
    style: WordStyle


def _named(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of each word, of its predecessor, and of the pair."""
    word = words.hash & ~_PAIR
    before = np.concatenate([[_START], word[:-1]])[: len(word)]
    before[words.first[:-1][np.diff(words.first) > 0]] = _START
    return word, before, join(before, word) | _PAIR


class _Group:
    """The words of a group's documents: names, sorted, with their counts in texts of the target and in all."""

    def __init__(self, group: pa.Table, style: WordStyle) -> None:
        self.chunk = next(chunks(group.combine_chunks().to_batches(), limit=1 << 62))
        self.words = self.chunk.words(style)
        word, self.before, pair = _named(self.words)
        full, row = np.flatnonzero(np.diff(self.words.first)), self.words.text_of
        self.names, at = np.unique(np.concatenate([word, pair, np.full(len(full), _START)]), return_inverse=True)
        #: Places of each word's and each pair's name.
        self.word, self.pair = at[: len(word)], at[len(word) : 2 * len(word)]
        self.target = self.chunk.column("target").astype(bool)
        rows = np.concatenate([row, row, full])
        times = self.chunk.column("times")
        target, every = (np.bincount(at, n[rows], len(self.names)) for n in (times * self.target, times))
        self.counts = np.stack([target, every]).astype(np.uint64)


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(map(planes, columns))


def _unpacked(data, columns: int) -> np.ndarray:
    n = len(data) // 8 // columns
    return np.stack([from_planes(data, np.dtype(np.uint64), n, 8 * n * i) for i in range(columns)])


def _unpacked_names(data, counted: bool) -> np.ndarray:
    """Names, which are packed as differences, and their counts."""
    columns = _unpacked(data, 3 if counted else 1)
    columns[0] = np.cumsum(columns[0])
    return columns


def _rows(parts: int, chunk: int | None, names: np.ndarray, *counts: np.ndarray) -> pa.Table:
    """One row for each partition that has some of the sorted names."""
    part = uniform_part(names, parts).astype(np.int32)
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
    data = [_packed(np.diff(names[a:b], prepend=np.uint64(0)), *(c[a:b] for c in counts)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table(
        {
            "part": pa.array(part[cuts[:-1]], pa.int32()), "chunk": pa.array([chunk] * len(data), pa.int64()),
            "counted": pa.array([bool(counts)] * len(data), pa.bool_()), "data": pa.array(data, pa.binary())
        }
    )


def _added(held: list) -> list[np.ndarray]:
    """Sorted names and their sums in the counted rows."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.empty(0, np.uint64)] * 3
    if not len(columns[0]):
        return columns
    names, target, total = columns
    order = np.argsort(names, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(names[order]) != 0]))
    return [names[order][start], np.add.reduceat(target[order], start), np.add.reduceat(total[order], start)]


def _answers(asked: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, data) for each asking row: what others have counted of its names, in their order."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asking, part = [], [], None
        for batch in batches:
            for chunk, counted, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                values = _unpacked_names(data.as_buffer(), counted)
                if counted:
                    held.append(values)
                if chunk is not None:
                    asking.append((chunk, values))
            part = batch.column(0)[0].as_py()
        names, *counts = _added(held)
        for chunk, (wanted, *own) in asking:
            found = np.zeros((2, len(wanted)), np.uint64)
            if len(names):
                at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                known = names[at] == wanted
                found[:, known] = [c[at[known]] for c in counts]
            if own:
                found -= own
            yield pa.record_batch(
                [pa.array([chunk]), pa.array([part], pa.int32()), pa.array([_packed(*found)], pa.binary())],
                ["chunk", "part", "data"]
            )

    return asked.repartitionById(parts, "part").mapInArrow(answer, "chunk long, part int, data binary")


def _of(doc: np.ndarray, name: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each (document, name) occurs, at each of its places; these sorted, and their numbers."""
    pairs, at, n = np.unique(doc * kinds + name, return_inverse=True, return_counts=True)
    return n[at], pairs, n


def _losses(group: pa.Table, answers: pa.Table, totals: Totals, style: WordStyle, weight: float, prior: float, within: bool) -> pa.Table:
    """Losses of a group's documents from the answers of the partitions."""
    own = _Group(group, style)
    chunk, words, names, w, p = own.chunk, own.words, own.names, own.word, own.pair
    data = [_unpacked(x.as_buffer(), 2) for x in answers.sort_by("part").column("data")]
    counts = np.concatenate(data, axis=1) if data else np.zeros((2, 0), np.uint64)
    counts = (counts + own.counts if within else counts).astype(np.float64)
    doc, n = words.text_of, np.diff(words.first)
    new = own.before == _START
    v = np.concatenate([[0], w[:-1]])[: len(w)]
    v[new] = 0  # the start's name is the least of all
    own_pair = own_word = own_before = own_n = np.zeros(len(w))
    if within and len(w):
        own_pair = _of(doc, p, len(names))[0]
        own_word, kinds, times = _of(doc, w, len(names))
        own_before = np.where(new, 1, times[np.minimum(np.searchsorted(kinds, doc * len(names) + v), len(kinds) - 1)])
        own_n = n[doc]
    loss = np.empty((2, len(w)))
    for i in range(0, len(w), _SLICE):  # so that what is held for each word stays small
        at = slice(i, i + _SLICE)
        mine, own_w, own_p, own_v, size = own.target[doc[at]], own_word[at], own_pair[at], own_before[at], own_n[at]
        every = _Counts(counts[1, w[at]] - own_w, counts[1, p[at]] - own_p, counts[1, v[at]] - own_v, totals.all - size)
        target = _Counts(counts[0, w[at]] - own_w * mine, counts[0, p[at]] - own_p * mine, counts[0, v[at]] - own_v * mine, totals.target - size * mine)
        rest = _Counts(*(x - y for x, y in zip(every, target, strict=True)))
        single = (every.word + 1) / (every.n + totals.kinds + 1)
        shared = (every.pair + prior * single) / (every.before + prior)
        for k, (model, other) in enumerate(((target, rest), (rest, target))):
            scale = np.minimum(1, other.n / np.maximum(model.n, 1))
            # without words on one side both are the shared distribution
            seen = np.where(scale * model.n > 0, model.word / np.maximum(model.n, 1), single)
            likely = weight * (scale * model.pair + prior * shared) / (scale * model.before + prior) + (1 - weight) * (single + seen) / 2
            loss[k, at] = -np.log(likely)
    out = [np.bincount(doc, x, len(n)) / np.maximum(n, 1) for x in loss]
    none = n == 0
    return pa.table({
        "key": pa.array(chunk.column("key")), "salt": pa.array(chunk.column("salt")), "times": pa.array(chunk.column("times")), "n_tokens": pa.array(n, pa.int64()),
        "loss_target": pa.array(out[0], mask=none), "loss_background": pa.array(out[1], mask=none), "score": pa.array(out[1] - out[0], mask=none),
    })


class _Counts(NamedTuple):
    """At each word: counts of it, of its pair, of its context, and of all words."""

    word: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    n: np.ndarray


_GROUPED = "chunk long, key long, salt long, text string, target boolean"


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that repeat key and salt in a batch become one, with their number as ``times``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
        _, first, times = np.unique(rows, axis=0, return_index=True, return_counts=True)
        if len(first) < batch.num_rows:
            batch = batch.take(pa.array(first))
        else:
            times = np.ones(batch.num_rows, np.int64)
        yield pa.record_batch([*batch.columns, pa.array(times, pa.int64())], [*batch.schema.names, "times"])


def _grouped(documents: DataFrame, target: DataFrame | None, broadcast_ids: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Rows (key, salt, text, target), the same dealt out by the number of their group with ``times``, and the partitions.

    Equal rows are brought together in each batch before they are dealt out, and wholly after it.
    """
    rows, parts = keyed(documents), partitions(documents)
    if target is None:
        rows = rows.withColumn("target", F.lit(False))
    else:
        ids = target.where("doc_id is not null").select(
            F.col("doc_id").cast("long").alias("key")
        ).distinct().withColumn("target", F.lit(True))
        if ids.count() <= broadcast_ids:
            ids = F.broadcast(ids)
        rows = rows.join(ids, "key", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    groups = max(parts, -(-input_bytes(documents) // GROUP_BYTES))
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "salt"), F.lit(groups).cast("long")))
    dealt = chunked.select("chunk", "key", "salt", "text", "target").mapInArrow(_collapsed, f"{_GROUPED}, times long").repartition(parts, "chunk")
    # no further shuffle: what is dealt by chunk is together by chunk, key and salt
    each = dealt.groupBy("chunk", "key", "salt").agg(F.first("text").alias("text"), F.first("target").alias("target"), F.sum("times").alias("times"))
    return rows, each, parts


def _totals(rows: DataFrame, parts: int, style: WordStyle) -> Totals:
    """Words of the target and all texts and their kinds; three sums reach the driver."""
    kinds = ("<u8", "<u4", "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts, *kinds)
        for chunk in chunks(batches):
            words = chunk.words(style)
            names, at = np.unique(words.hash & ~_PAIR, return_inverse=True)
            target = chunk.column("target").astype(bool)[words.text_of]
            yield from packer.add(
                uniform_part(names, parts), names, np.bincount(at, target, len(names)), np.bincount(at, minlength=len(names))
            )
        yield from packer.flush()

    def add(_: int, names: np.ndarray, target: np.ndarray, every: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums = [int(target.sum(dtype=np.int64)), int(every.sum(dtype=np.int64)), len(np.unique(names))]
        yield pa.record_batch([pa.array([x], pa.int64()) for x in sums], ["target", "every", "kinds"])

    packed = rows.select("text", "target").mapInArrow(count, PACKED)
    found = exchange(packed, kinds, add, "target long, every long, kinds long", parts)
    return Totals(*(x or 0 for x in found.agg(F.sum("target"), F.sum("every"), F.sum("kinds")).first()))


def fit(documents: DataFrame, target: DataFrame, broadcast_ids: int = 1_000_000) -> Models:
    """Counts both models over all documents; those whose doc_id is in ``target`` make the target model.

    Null texts have no words. Ids of the target are broadcast up to ``broadcast_ids`` of them and joined
    by a shuffle beyond. Without a target, or without words, the models still give finite losses. The
    counts are written to the shared folder, for any number of tables to be scored.
    """
    rows, groups, parts = _grouped(documents, target, broadcast_ids)
    style = LOWER.keyed()

    def count(group: pa.Table) -> pa.Table:
        own = _Group(group, style)
        return _rows(parts, None, own.names, *own.counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for batch in batches:
            part = batch.column(0)[0].as_py()
            held += [_unpacked_names(x.as_buffer(), True) for x in batch.column(3)]
        sums = _added(held)
        for a in range(0, len(sums[0]), _ROW_NAMES):
            names, *counts = (x[a : a + _ROW_NAMES] for x in sums)
            data = _packed(np.diff(names, prepend=np.uint64(0)), *counts)
            yield pa.record_batch(
                [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([True]), pa.array([data], pa.binary())],
                ["part", "chunk", "counted", "data"]
            )

    counts = saved(groups.groupBy("chunk").applyInArrow(count, _ROWS).repartitionById(parts, "part").mapInArrow(add, _ROWS))
    return Models(counts, parts, _totals(rows, parts, style), style)


def score(documents: DataFrame, models: Models, weight: float = 0.6, prior: float = 20.0) -> DataFrame:
    """Scores documents by models of other texts.

    Returns key columns, ``doc_id``, ``n_tokens``, mean ``loss_target`` and ``loss_background``, and
    ``score``, their difference. Texts without words (null ones too) have no losses and score null;
    repeated rows score alike.
    """
    _, groups, parts = _grouped(documents, None)
    names, style = models.parts, models.style

    def ask(group: pa.Table) -> pa.Table:
        return _rows(names, group.column("chunk")[0].as_py(), _Group(group, style).names)

    asked = groups.groupBy("chunk").applyInArrow(ask, _ROWS).unionByName(models.counts)
    return _finished(groups, parts, _answers(asked, names), (models.totals, style, weight, prior, False))


def score_within(documents: DataFrame, target: DataFrame, weight: float = 0.6, broadcast_ids: int = 1_000_000, prior: float = 20.0) -> DataFrame:
    """Scores each document by models of all the others; those whose doc_id is in ``target`` make the target model.

    A document's own counts are taken out of both models before it is scored, so that it isn't known by
    itself; one that occurs twice is known by its copy. Counting and scoring take one exchange, after the
    sums of words and kinds. For the rest it is as ``fit`` and ``score``.
    """
    rows, groups, parts = _grouped(documents, target, broadcast_ids)
    style = LOWER.keyed()

    def ask(group: pa.Table) -> pa.Table:
        own = _Group(group, style)
        return _rows(parts, group.column("chunk")[0].as_py(), own.names, *own.counts)

    answers = _answers(groups.groupBy("chunk").applyInArrow(ask, _ROWS), parts)
    return _finished(groups, parts, answers, (_totals(rows, parts, style), style, weight, prior, True))


_SCORES = "key long, salt long, times long, n_tokens long, loss_target double, loss_background double, score double"
#: Copies of one row that are made at a time.
_COPIES = 4096


def _finished(groups: DataFrame, parts: int, answers: DataFrame, how: tuple) -> DataFrame:
    losses = lambda group, found: _losses(group, found, *how)
    out = groups.groupBy("chunk").cogroup(answers.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(losses, _SCORES)
    columns = ["key", "salt", "n_tokens", "loss_target", "loss_background", "score"]
    out = out.select(*columns, "times", F.explode(F.sequence(F.lit(1), F.col("times"), F.lit(_COPIES))).alias("first"))
    out = out.select(*columns, F.explode(F.sequence("first", F.least(F.col("times"), F.col("first") + (_COPIES - 1)))).alias("copy"))
    return out.select("key", "salt", doc_id(), *columns[2:])
