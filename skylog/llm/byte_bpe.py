"""Byte-level BPE encoding with offsets, and decoding, over Arrow batches.

A rank file names tokens by their bytes. The tokenizers library works on characters, so each byte gets a
printable stand-in; a file's ranks become the library's vocabulary and its merges: every way to cut a token
into two tokens, in the order of the token's rank. Texts are split by the pattern first; distinct pieces of
a batch go through the library once and are remembered in a bounded table.

A long text is split some bytes at a time, a long piece is encoded a stretch at a time, and their tokens can
stay in parts, rows of their own, through decoding and hashing: no row or task holds them all.

A token is some bytes of the text, not always whole characters. Byte places are running sums of token
lengths; a table of the text's bytes turns them into character places, and all tokens that share a
character name it in their offsets. Decoding joins bytes before it reads characters.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from .words import chunks

#: Pieces and characters of pieces remembered in a task, and pieces of a long text worked on at once.
REMEMBERED, REMEMBERED_CHARACTERS, AT_ONCE = 200_000, 2 << 20, 100_000
#: Text bytes encoded, and ids decoded, at once; a longer text alone.
ENCODED_BYTES, DECODED_IDS = 1 << 19, 1 << 17
#: Bytes of a piece that the library gets at once, and tokens at the end of such a stretch that the next one makes anew.
STRETCH, ANEW = 1 << 16, 64
#: Characters after a match that the default pattern may look at.
AHEAD = 3
#: Encoded rows: what the tokens are, and which characters of the text each one touches.
ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"
PARTS = "doc_id long, part int, last boolean, ids array<int>, starts array<int>, ends array<int>"


def default_path() -> str:
    return importlib.import_module("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    return importlib.import_module("public_tokenizers").PATTERN


def stand_ins() -> list[str]:
    """A printable character for each byte: itself where that is printable, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids: one base64 token and one number a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(n) for token, n in (line.split() for line in f if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing or len(set(ranks.values())) != len(ranks):
        raise ValueError(f"{path}: ids must differ, and every byte needs one; missing are {missing[:5]}")
    return ranks


class ByteTable:
    """The bytes of all tokens of a rank file, one after the other: token i is bytes[first[i]:first[i + 1]]."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        by_id = [b""] * self.size
        for token, n in ranks.items():
            by_id[n] = token
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences, one after the other, and the place of each one's first byte (and of their end)."""
        wrong = (ids < 0) | (ids >= self.size)
        wrong[~wrong] = self.length[ids[~wrong]] == 0
        if wrong.any():
            raise ValueError(f"{ids[wrong][0]} is no token")
        n = self.length[ids]
        return self.bytes[_ranges(self.first[ids], n)], np.concatenate([[0], np.cumsum(n)])[first]


class ByteBpe(ByteTable):
    """Encodes texts to ids, and decodes them, by a rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__(ranks := read_ranks(path))
        self._stand_in = dict(enumerate(stand_ins()))
        shown = {token: token.decode("latin-1").translate(self._stand_in) for token in ranks}
        merges = [
            (shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        # a piece that is a token is that token, whatever merges would make of it
        bpe = models.BPE(vocab={shown[t]: n for t, n in ranks.items()}, merges=merges, ignore_merges=True)
        self._library = Tokenizer(bpe)
        self._pieces, self._looks_ahead = regex.compile(pattern), AHEAD if pattern == default_pattern() else None
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._characters = 0
        self._ids, self._n = np.empty(0, np.int32), np.empty(0, np.int64)

    def _library_ids(self, pieces: list[bytes]) -> list[list[int]]:
        shown = [p.decode("latin-1").translate(self._stand_in) for p in pieces]
        return [e.ids for e in self._library.encode_batch(shown, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has."""
        ids, n = [], []
        for some in _groups((p.encode() for p in pieces), AT_ONCE, STRETCH):
            got = [np.concatenate(self._stretches(some[0]))] if len(some[0]) > STRETCH else self._library_ids(some)
            ids.append(np.fromiter(chain.from_iterable(got), np.int32) if len(some) > 1 else np.asarray(got[0], np.int32))
            n += map(len, got)
        return np.concatenate([np.empty(0, np.int32), *ids]), np.array(n, np.int64)

    def _stretches(self, piece: bytes) -> list[np.ndarray]:
        """Ids of a long piece, in order, from the library's for a stretch at a time.

        Tokens of stretches are those of the whole piece if any two neighbours, encoded by themselves, stay
        these two: the first merge that crosses a place between tokens would be the first to cross it there too.
        Inside a stretch that holds. So a stretch begins where a token does, its last tokens are made anew by the next one, and the
        two that meet are tried; if they don't stay, the next try begins further back and is twice as long.
        """
        kept: list[np.ndarray] = []
        at, size, back = 0, max(STRETCH, 2 * int(self.length.max())), ANEW
        while at < len(piece):
            to = len(piece) if len(piece) - at < 2 * size else at + size
            ids = np.array(self._library_ids([piece[at:to]])[0], np.int32)
            if kept and not self._stay(kept[-1][-1], ids[0]):
                ids = np.concatenate(kept)
                at -= int(self.length[ids[-back:]].sum())
                kept = [ids[:-back]] if len(ids) > back else []
                size, back = 2 * size, 2 * back
                continue
            if to < len(piece):
                ids = ids[: max(1, len(ids) - ANEW)]
            kept.append(ids)
            at += int(self.length[ids].sum())
        return kept

    def _stay(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes together are encoded as these two."""
        pair = self.bytes[_ranges(self.first[[a, b]], self.length[[a, b]])].tobytes()
        return self._library_ids([pair])[0] == [a, b]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the pieces, and how many each has."""
        new = [p for p in dict.fromkeys(pieces) if p not in self._place]
        if len(self._place) + len(new) > REMEMBERED or self._characters > REMEMBERED_CHARACTERS:
            self._forget()
            new = list(dict.fromkeys(pieces))
        ids, n = self._learn(new)
        self._place |= {p: i for i, p in enumerate(new, len(self._place))}
        self._characters += sum(map(len, new))
        self._ids, self._n = np.concatenate([self._ids, ids]), np.concatenate([self._n, n])
        at = np.fromiter(map(self._place.__getitem__, pieces), np.int64, len(pieces))
        n = self._n[at]
        return self._ids[_ranges((np.cumsum(self._n) - self._n)[at], n)], n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the place of each text's first one (and of their end)."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        if sum(map(len, texts)) <= 2 * ENCODED_BYTES:
            pieces = [self._pieces.findall(t) for t in texts]
            if any(pieces):
                got, n = self._encode_pieces(list(chain.from_iterable(pieces)))
                ends = np.cumsum([len(p) for p in pieces])
                counts = np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0)
                ids.append(got)
        else:
            for i, t in enumerate(texts):
                for got in self.runs(np.frombuffer(t.encode(), np.uint8)):
                    counts[i] += len(got)
                    ids.append(got)
        return np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(counts)])

    def runs(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of a long text's UTF-8 bytes, in order, some at a time."""
        for some in _groups(self._split(data), AT_ONCE, ENCODED_BYTES):
            if len(some[0]) > ENCODED_BYTES:
                yield from self._stretches(some[0].encode())
            else:
                yield self._encode_pieces(some)[0]

    def _split(self, data: np.ndarray) -> Iterator[str]:
        """The matches of the pattern. Those of the default one are found some bytes at a time."""
        at, size = 0, ENCODED_BYTES if self._looks_ahead is not None else len(data)
        while at < len(data):
            to = min(at + size, len(data))
            while to < len(data) and data[to] & 0xC0 == 0x80:
                to += 1
            pieces = self._pieces.findall(text := data[at:to].tobytes().decode())
            if to < len(data):
                # matches are what they are in the whole text if they don't look beyond this one
                end = len(text)
                while pieces and end > len(text) - self._looks_ahead:
                    end -= len(pieces.pop())
                if not pieces:
                    size *= 2
                    continue
                to, size = at + len(text[:end].encode()), ENCODED_BYTES
            at = to
            yield from pieces

    def parts(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """Ids and offsets of a long text's UTF-8 bytes, some at a time, and whether they are the last."""
        at = begun = 0
        for ids in self.runs(data):
            some = data[at : at + int(self.length[ids].sum())]
            starts, ends = self.offsets(ids, np.array([0, len(ids)]), some, np.array([0, len(some)]))
            at += len(some)
            yield ids, starts + begun, ends + begun, at == len(data)
            begun += int(np.count_nonzero((some & 0xC0) != 0x80))

    def offsets(self, ids: np.ndarray, first: np.ndarray, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first character that each token touches and the one after the last, counted from its text's begin.

        ``data`` holds the UTF-8 bytes of the texts and ``where`` their begins: the tokens' bytes are the texts'.
        """
        end = np.cumsum(self.length[ids])
        # number of characters begun up to each byte
        begun = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
        before = np.repeat(np.concatenate([[0], begun])[where[:-1]], np.diff(first))
        return begun[end - self.length[ids]] - 1 - before, begun[end - 1] - before


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers each, one range after the other."""
    stop = np.cumsum(n)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - n), n)


def _groups(pieces: Iterable, most: int, size: int) -> Iterator[list]:
    """Consecutive pieces, so many at most and together no longer than ``size``; a longer one is alone."""
    some, total = [], 0
    for p in pieces:
        if some and (len(some) == most or total + len(p) > size):
            yield some
            some, total = [], 0
        some.append(p)
        total += len(p)
    if some:
        yield some


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> ByteBpe:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def _table(path: str) -> ByteTable:
    return ByteTable(read_ranks(path))


def _lists(first: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32()))


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None, parts: bool = False) -> DataFrame:
    """Token ids of every whole text, with the characters that each token touches: doc_id, ids, starts, ends.

    ``starts`` and ``ends`` count code points of the text from 0; tokens that hold parts of one character
    all name it. Matches of the pattern are encoded separately, and no text stands for a special token.
    Null and empty texts have no tokens. Rows keep their doc_id, null or repeated as it may be; other columns are
    left out. A text may have up to 2**31 tokens in a batch of rows.

    With ``parts``, the tokens of a long text are dealt to several rows, which follow one another: ``part`` numbers
    them from 0, and ``last`` marks the last one. Other texts have one row.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for chunk in chunks(batches, limit=ENCODED_BYTES):
            docs = chunk.rows.column(0)
            if parts and len(chunk.data) > 2 * ENCODED_BYTES:
                for k, (ids, starts, ends, last) in enumerate(bpe.parts(chunk.data)):
                    yield _rows(docs, [k], [last], np.array([0, len(ids)]), ids, starts, ends)
            else:
                ids, first = bpe.encode([t or "" for t in chunk.rows.column(1).to_pylist()])
                yield _rows(docs, [0] * len(docs), [True] * len(docs), first, ids, *bpe.offsets(ids, first, chunk.data, chunk.offsets))

    rows = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    if parts:
        return rows.mapInArrow(encoded, PARTS)
    return rows.mapInArrow(lambda batches: (b.drop_columns(["part", "last"]) for b in encoded(batches)), ENCODED)


def _rows(docs: pa.Array, part: list[int], last: list[bool], first: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [docs, pa.array(part, pa.int32()), pa.array(last), *(_lists(first, x) for x in values)], ["doc_id", "part", "last", "ids", "starts", "ends"]
    )


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of about ``DECODED_IDS`` ids at a time, and the place of each one's first id (and of their end)."""
    n = batch.column(batch.schema.get_field_index("ids")).value_lengths().fill_null(0).to_numpy()
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(n) // DECODED_IDS)) + 1, [len(n)]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a), np.concatenate([[0], np.cumsum(n[a:b])])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The encoded rows with ``bytes``, what their ids stand for; null ids give null.

    The bytes of a whole sequence are joined, so characters that tokens split are whole again. Ids cut out of
    a sequence, parts among them, may give bytes that are no UTF-8. An id that the file doesn't have is an error.
    """
    path = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for rows, first in chain.from_iterable(map(_slices, batches)):
            lists = rows.column(rows.schema.get_field_index("ids"))
            data, where = table.decode(lists.flatten().to_numpy(), first)
            data, where = data.tobytes(), where.tolist()
            out = [data[x:y] if full else None for x, y, full in zip(where[:-1], where[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([*rows.columns, pa.array(out, pa.binary())], [*rows.schema.names, "bytes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """One row for each text of which ``decoded`` has the parts: doc_id, n_tokens, SHA-256 of its ids and bytes, n_chars.

    Ids are hashed in decimals, joined by commas. ``n_chars`` is the last part's. A text's parts have to follow one
    another, as ``encode`` deals them and ``decode`` leaves them; it is an error if they don't.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = n_tokens = 0
        for rows, first in chain.from_iterable(map(_slices, batches)):
            column = dict(zip(rows.schema.names, rows.columns, strict=True))
            decimals = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), column["ids"].flatten().cast(pa.string())), ",")
            out = []
            for doc_id, part, last, n, text, data, n_chars in zip(
                column["doc_id"].to_pylist(), column["part"].to_pylist(), column["last"].to_pylist(), np.diff(first).tolist(),
                decimals, column["bytes"], column["n_chars"].to_pylist(), strict=True
            ):
                if part != due:
                    raise ValueError(f"part {part} of {doc_id} where part {due} is due")
                if not part:
                    n_tokens, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                ids_hash.update(b"," if n and n_tokens else b"")
                ids_hash.update(text.as_buffer())
                bytes_hash.update(data.as_buffer())
                n_tokens, due = n_tokens + n, 0 if last else part + 1
                if last:
                    out.append((doc_id, n_tokens, ids_hash.hexdigest(), bytes_hash.hexdigest(), n_chars))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)
        if due:
            raise ValueError(f"part {due} is missing")

    return decoded.select("doc_id", "part", "last", "ids", "bytes", "n_chars").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long"
    )
