"""Removal of passages that occur more than once, by difference-cover anchors.

Two equal windows start at word positions i and j of their documents. A difference cover D modulo a
period p has, for any i and j, a shift below p that takes both positions into D modulo p. So anchors
(short windows) hashed at cover positions alone are enough to notice every equal pair of windows at
least p - 1 words longer than an anchor; with p = 21 that is 5 of 21 positions. Shared anchors are
then extended: every full window around one is compared by 128 bits of BLAKE2 over its words, which
no two different windows are known to share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import PACKED, Packer, exchange, partitions, uniform_part
from .tables import doc_id, keyed
from .words import PLAIN, Chunk, chunks, mix

#: Perfect difference sets: each non-zero residue modulo the period is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
_KNOWN = np.uint32(1 << 31)
#: A place: its row's key and salt, and the word position; names go before it, one column for 64 bits.
_PLACE = ("i8", "i8", "u4")


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves an anchor two fifths of a window."""
    return max((p, d) for p, d in COVERS.items() if window - p + 1 >= 0.4 * window)


def _in_order(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the names, and which of them in that order equal the one before."""
    order = np.lexsort(names[::-1]) if len(names) > 1 else np.argsort(names[0], kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([n[order[1:]] == n[order[:-1]] for n in names])
    return order, same


def _repeated(select, kinds: tuple[str, ...]) -> tuple:
    """Sender and receiver of an exchange that finds the names occurring at two places or more.

    ``select(chunk)`` gives names (columns of 64 bits), row of the chunk and word position. Names are sent
    as ``kinds`` says, beside the partition that their upper half has chosen.
    Places that share their name inside one chunk are known to repeat; only one of them is compared with
    other chunks, so a very common name costs one record a chunk, and the others pass through, dealt out by document.
    """

    def sender(parts: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(parts, *kinds, *_PLACE)
            for chunk in chunks(batches):
                names, row, place = select(chunk)
                key, salt, place = chunk.column("key")[row], chunk.column("salt")[row], place.astype(np.uint32)
                order, same = _in_order(names)
                many = same.copy()
                many[:-1] |= same[1:]
                one, known = np.sort(order[~same]), np.sort(order[many])
                yield from packer.add(uniform_part(names[0][one], parts), *(n[one] for n in names), key[one], salt[one], place[one])
                yield from packer.add(
                    _home(key[known], salt[known], parts), *(n[known] for n in names), key[known], salt[known],
                    place[known] | _KNOWN
                )
            yield from packer.flush()

        return send

    def receiver(parts: int):
        def receive(_: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            *names, key, salt, place = columns
            known = place >= _KNOWN
            asked = np.flatnonzero(~known)
            order, same = _in_order([n[asked] for n in names])
            several = same.copy()
            several[:-1] |= same[1:]
            found = np.sort(np.concatenate([np.flatnonzero(known), asked[order[several]]]))
            packer = Packer(parts, *_PLACE)
            yield from packer.add(_home(key[found], salt[found], parts), key[found], salt[found], place[found] & ~_KNOWN)
            yield from packer.flush()

        return receive

    return sender, receiver


def _home(key: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    return uniform_part(mix(key.view(np.uint64) + mix(salt.view(np.uint64))), parts)


def _found(df: DataFrame, parts: int, select, kinds: tuple[str, ...], before: int, after: int) -> DataFrame:
    """One row for each key and salt: the places of all its names that occur more than once.

    ``spans`` holds them as disjoint ranges of word positions (packed starts and ends), each place
    reaching from ``before`` words before it to ``after`` words after it.
    """

    def join_up(_: int, key: np.ndarray, salt: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((place, salt, key))
        key, salt, place = key[order], salt[order], place[order].astype(np.int64)
        row = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        new = row.copy()
        new[1:] |= place[1:] - before > place[:-1] + after + 1
        at = np.flatnonzero(new)
        start, end = np.maximum(place[at] - before, 0), place[np.append(at[1:], len(place)) - 1] + after + 1
        rows = np.append(np.flatnonzero(row[at]), len(at))
        for a in range(0, len(rows) - 1, 4096):
            cuts = rows[a : a + 4097]
            first = at[cuts[:-1]]
            yield pa.record_batch({
                "key": pa.array(key[first]), "salt": pa.array(salt[first]),
                "spans": pa.array(
                    [np.stack([start[x:y], end[x:y]]).astype(np.uint32).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)],
                    pa.binary()
                ),
            })

    sender, receiver = _repeated(select, kinds)
    found = exchange(df.mapInArrow(sender(parts), PACKED), (*kinds, *_PLACE), receiver(parts), PACKED, parts)
    return exchange(found, _PLACE, join_up, "key long, salt long, spans binary", parts)


def _spread(chunk: Chunk, first: np.ndarray) -> np.ndarray:
    """Marks the words inside the spans of their text."""
    spans = chunk.rows.column(chunk.rows.schema.get_field_index("spans"))
    steps = np.zeros(first[-1] + 1, np.int32)
    for i, packed in enumerate(spans):
        if packed.is_valid:
            ends = np.frombuffer(packed.as_buffer(), np.uint32).astype(np.int64).reshape(2, -1)
            for at, step in zip(np.minimum(first[i] + ends, first[i + 1]), (1, -1), strict=True):
                np.add.at(steps, at, step)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(documents: DataFrame, window: int = 35) -> DataFrame:
    """Removes every word inside a window of ``window`` words whose sequence also starts elsewhere.

    Words are runs without ASCII white space. "Elsewhere" is any other position of any row, the same
    row included; windows are judged on the input. Returns key columns, ``doc_id``, ``n_words``,
    ``n_removed`` and ``text``, the rest of the text with its own white space (one space or line feed
    where words went). Null texts have no words and stay null, as do texts shorter than the window
    unchanged; a row repeated as a whole counts as two places; a null doc_id stays null.
    """
    period, cover = cover_for(window)
    anchor, wanted = window - period + 1, np.isin(np.arange(period), cover)

    def anchors(chunk: Chunk):
        words = chunk.words(PLAIN)
        at, hashes = words.windows(anchor)
        row = words.text_of[at]
        place = at - words.first[row]
        keep = wanted[place % period]
        return [hashes[keep]], row[keep], place[keep]

    def full_windows(chunk: Chunk):
        words = chunk.words(PLAIN)
        at = words.starts(window)
        at = at[_spread(chunk, words.first)[at]]
        row = words.text_of[at]
        return list(words.digests(at, window).T), row, at - words.first[row]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = chunk.words(PLAIN)
            gone = _spread(chunk, words.first)
            n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            texts = chunk.rows.column(chunk.rows.schema.get_field_index("text")).cast(pa.string())
            if n_removed.any():
                texts = texts.to_pylist()
                for i in np.flatnonzero(n_removed):
                    texts[i] = _without(chunk, words, gone, i)
            yield pa.record_batch({
                "key": pa.array(chunk.column("key")), "salt": pa.array(chunk.column("salt")),
                "n_words": pa.array(np.diff(words.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(texts, pa.string()),
            })

    rows = keyed(documents)
    parts = partitions(documents)
    candidates = rows.join(_found(rows, parts, anchors, ("u4",), period - 1, 0), ["key", "salt"])
    repeats = _found(candidates, parts, full_windows, ("u8", "u8"), 0, window - 1)
    out = rows.join(repeats, ["key", "salt"], "left").mapInArrow(cut, "key long, salt long, n_words long, n_removed long, text string")
    return out.select("key", "salt", doc_id(), "n_words", "n_removed", "text")


def _without(chunk: Chunk, words, gone: np.ndarray, i: int) -> str:
    a, b = words.first[i], words.first[i + 1]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8)))
    out, last = [], 0
    for x, y in zip(edges[::2] + a, edges[1::2] + a, strict=True):
        if out:
            out.append(b"\n" if b"\n" in chunk.data[words.end[last] : words.start[x]].tobytes() else b" ")
        out.append(chunk.data[words.start[x] : words.end[y - 1]].tobytes())
        last = y - 1
    return b"".join(out).decode()
