"""Toxicity of texts and their offending sentences, learnt from labels of whole documents.

Multiple-instance learning: a sentence is offensive with probability s(b + sum of its words' weights),
a document is toxic if at least one sentence is, so their probabilities combine by noisy-or. Only
document labels are known; the likelihood's gradient itself tells which sentences carry them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tables import doc_id, keyed, saved
from .words import ALNUM, Chunk, chunks

_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


@dataclass
class Model:
    """Sorted hashes of the known words, their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """The weight of each word; 0 if it is not known."""
        at, known = _find(self.words, words)
        return np.where(known, self.weights[at], 0.0) if len(self.words) else np.zeros(len(words))


def _find(names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash asked for in the sorted names, and whether it is there at all."""
    if not len(names):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return at, names[at] == asked


def _sentences(chunk: Chunk):
    """Words of a chunk and the number of the sentence that each is in (from 0, text by text)."""
    words = chunk.words(ALNUM)
    ends = np.concatenate([[0], np.cumsum(_ENDS[chunk.data])])[words.start]
    new = np.ones(len(words.hash), bool)
    new[1:] = ends[1:] != ends[:-1]
    new[words.first[:-1][np.diff(words.first) > 0]] = True
    return words, np.cumsum(new) - 1


def held_out(doc: F.Column) -> F.Column:
    """Whether a document is held out of training; one without an id is not."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(documents: DataFrame, labels: DataFrame, limit: int, budget: int) -> DataFrame:
    """Label and text of documents, chosen by a hash of their id: at most ``limit`` rows and ``budget`` characters.

    A text of more than a 64th of the budget is passed over, so that no single row keeps the others out.
    """
    chosen = labels.where(
        "doc_id is not null and toxic is not null"
    ).groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(limit)
    order = (F.xxhash64("key"), "key", "salt")
    # at most ``limit`` small rows: broadcast
    size = F.coalesce(F.length("text"), F.lit(0))
    rows = keyed(documents).join(F.broadcast(chosen), "key").where(64 * size <= budget).orderBy(*order).limit(limit)
    rows = rows.withColumn(
        "sum", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).where(F.col("sum") <= budget)
    return rows.select(F.col("toxic").cast("int").alias("toxic"), "text")


def _known(sample: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of the words that ``least`` documents of the sample hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = chunk.words(ALNUM)
            order = np.lexsort((words.text_of, words.hash))
            word, text = words.hash[order], words.text_of[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
            kinds, n = np.unique(word[new], return_counts=True)
            yield pa.record_batch({"word": pa.array(kinds.view(np.int64)), "n": pa.array(n, pa.int64())})

    counted = sample.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(counted.select("word").toArrow().column(0).to_numpy().view(np.uint64))


def _examples(sample: DataFrame, known: np.ndarray) -> list:
    """Of each document its label, the places of its known words, and how many of them each sentence has."""
    held = sample.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for chunk in chunks(batches):
            words, sentence = _sentences(chunk)
            at, is_known = _find(known, words.hash)
            n = np.bincount(sentence[is_known], minlength=sentence[-1] + 1 if len(sentence) else 0).astype(np.int32)
            kept = np.concatenate([[0], np.cumsum(is_known)])[words.first]
            first = np.searchsorted(sentence, np.arange(len(n)))  # each sentence's first word
            cut = np.searchsorted(first, words.first)
            places = at[is_known].astype(np.int32)
            yield pa.record_batch({
                "toxic": pa.array(chunk.column("toxic").astype(np.int32)),
                "words": pa.array([places[a:b].tobytes() for a, b in zip(kept[:-1], kept[1:], strict=True)], pa.binary()),
                "sentences": pa.array([n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            })

    return sample.mapInArrow(run, "toxic int, words binary, sentences binary").collect()


def fit(
    documents: DataFrame, labels: DataFrame, limit: int = 8000, budget: int = 60_000_000, rounds: int = 500,
    shrink: float = 2e-5
) -> Model:
    """Learns from at most ``limit`` labelled documents with ``budget`` characters together (the documented bound; nothing else is capped).

    The sample is learnt on the driver, whatever the size of the corpus; what reaches it are four bytes a word.
    Words seen in fewer than 4 of the documents get no weight. Without labelled documents, or with one kind of
    label only, the model scores every sentence alike, at the rate of toxic labels seen (0.5 if none).
    """
    sample = saved(_sample(documents, labels, limit, budget))
    known = _known(sample, 4)
    rows = _examples(sample, known)
    y = np.array([r.toxic for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(rate / (1 - rate))))
    n_sentences = np.array([max(1, len(r.sentences) // 4) for r in rows])
    first, total = np.cumsum(n_sentences) - n_sentences, int(n_sentences.sum())
    word = np.frombuffer(b"".join(r.words for r in rows), np.int32)
    # a document without words is one sentence without any
    each = np.frombuffer(b"".join(r.sentences or bytes(4) for r in rows), np.int32)
    del rows
    at, owner = np.repeat(np.arange(total, dtype=np.int32), each), np.repeat(np.arange(len(y), dtype=np.int32), n_sentences)
    # one label is one observation, however long its document is
    w, b = np.zeros(len(known)), -np.log(n_sentences.mean() * 10 + 1)
    step_w, step_b = np.full(len(known), 1e-12), 1e-12
    for _ in range(rounds):
        z = np.clip(b + np.bincount(at, w[word], total), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.add.reduceat(np.log1p(-p), first))
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0) / len(y)
        g = p * pull[owner]
        gw, gb = np.bincount(word, g[at], len(known)), g.sum()
        step_w, step_b = step_w + gw**2, step_b + gb**2
        w += 0.5 * gw / np.sqrt(step_w)
        b += 0.5 * gb / np.sqrt(step_b)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * shrink / np.sqrt(step_w), 0)
    return Model(known, w, float(b))


def _scored(model: Model, chunk: Chunk, from_score: float) -> tuple[pa.Array, pa.Array]:
    """Score and offending sentences of each text of a chunk."""
    words, sentence = _sentences(chunk)
    start = np.flatnonzero(np.diff(sentence, prepend=-1))
    z = np.clip(model.bias + (np.add.reduceat(model.weigh(words.hash), start) if len(start) else np.empty(0)), -30, 30)
    p = 1 / (1 + np.exp(-z))
    row = words.text_of[start]
    safe = np.zeros(len(chunk.rows))
    np.add.at(safe, row, np.log1p(-p))
    safe[np.bincount(row, minlength=len(safe)) == 0] = np.log1p(-1 / (1 + np.exp(-model.bias)))
    spans: list[list[dict]] = [[] for _ in range(len(chunk.rows))]
    last = np.append(start[1:], len(words.hash)) - 1
    for i in np.flatnonzero(p >= from_score):
        base = chunk.offsets[row[i]]
        spans[row[i]].append({"start": int(words.start[start[i]] - base), "end": int(words.end[last[i]] - base), "score": float(p[i])})
    return pa.array(1 - np.exp(safe)), pa.array(spans, _SPANS)


def score(documents: DataFrame, model: Model, from_score: float = 0.5) -> DataFrame:
    """Scores whole texts. Returns key columns, ``doc_id``, ``score`` (0 to 1) and ``offending``.

    ``offending`` lists the byte ranges of sentences with a probability of ``from_score`` or more, in
    the UTF-8 text, with it. Null texts and texts without words score as one empty sentence. Ids,
    labels, languages and sources play no part; repeated rows get equal scores.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            scores, spans = _scored(held.value, chunk, from_score)
            yield pa.record_batch(
                {"key": pa.array(chunk.column("key")), "salt": pa.array(chunk.column("salt")), "score": scores, "offending": spans}
            )

    out = keyed(documents).mapInArrow(run, "key long, salt long, score double, offending array<struct<start:long,end:long,score:double>>")
    return out.select("key", "salt", doc_id(), "score", "offending")


def score_rows(documents: DataFrame, model: Model) -> DataFrame:
    """``row``, each row of the documents as a struct of all its columns, and its ``score``: no shuffle to bring them together."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield pa.record_batch([chunk.rows.column(0), _scored(held.value, chunk, 2.0)[0]], ["row", "score"])

    rows = documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
