"""Words and word windows of a whole Arrow batch of texts, as numpy arrays.

Texts stay UTF-8 bytes: every pattern the operators use is defined on ASCII bytes, so a byte
table tells words from separators, and bytes of longer characters always belong to words.
A word's 64-bit hash depends on its (folded) bytes and the style's key only: words of up to 8 bytes have
one each that no other of them has, those of up to 64 bytes are mixed block by block, and longer ones go
through BLAKE2. The standing key is public, so words can be made to clash under it; ``keyed()`` draws a
secret one, which goes with the job, and whose hashes mean nothing outside it.
A window's hash comes from those of its words, mixed at each step, so that neither repeats nor symmetric
sequences cancel out. Different words or windows share a hash by chance only, at about 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.uint64(0xD6E8FEB86659FD95)
#: Longer words (bytes) are hashed one by one.
_BLOCKS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The hash of two sequences, one after the other, from theirs."""
    return mix(before * _ORDER + after)


@dataclass(frozen=True)
class WordStyle:
    """Which bytes separate words, and how the others are folded before hashing."""

    separator: np.ndarray
    fold: np.ndarray
    #: Added to a word's first bytes before they are mixed, and an odd factor afterwards.
    key: tuple[int, int] = (0, 1)

    def keyed(self) -> WordStyle:
        """The same words under a key drawn anew."""
        return replace(self, key=(secrets.randbits(64), secrets.randbits(64) | 1))


def _style(is_separator, lower: bool) -> WordStyle:
    fold = np.arange(256)
    if lower:
        fold[0x41:0x5B] += 0x20
    return WordStyle(np.array([is_separator(int(b)) for b in fold]), fold.astype(np.uint8))


_SPACES = (0x20, *range(0x09, 0x0E))
#: Runs without ASCII white space; as they are, and with A-Z lower-cased.
PLAIN = _style(lambda b: b in _SPACES, lower=False)
LOWER = _style(lambda b: b in _SPACES, lower=True)
#: Runs of ASCII digits, letters (lower-cased) and all characters beyond ASCII.
ALNUM = _style(lambda b: b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A), lower=True)


@dataclass
class Words:
    """All words of a chunk, in order. ``first[d]:first[d + 1]`` are those of text d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    folded: np.ndarray
    _runs: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def starts(self, n: int) -> np.ndarray:
        """Word index of every window of n consecutive words of one text."""
        last = max(0, len(self.hash) - n + 1)
        after = np.repeat(self.first[1:], np.diff(self.first))[:last]
        return np.flatnonzero(np.arange(n, last + n) <= after)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index and hash of every window of n consecutive words of one text."""
        at = self.starts(n)
        return at, self.runs(n)[at]

    def runs(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, whether or not they are in one text."""
        if n == 1:
            return self.hash
        if n not in self._runs:
            half, last = 1 << ((n - 1).bit_length() - 1), max(0, len(self.hash) - n + 1)
            self._runs[n] = join(self.runs(half)[:last], self.runs(n - half)[half : half + last])
        return self._runs[n]

    def spans(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the n words from word index at, for each element."""
        out = np.empty(len(at), np.uint64)
        for size in np.unique(n):
            chosen = n == size
            out[chosen] = self.runs(int(size))[at[chosen]]
        return out

    def digests(self, at: np.ndarray, n: int) -> np.ndarray:
        """128 bits of BLAKE2 over the n words (with one space between) from each word index: two columns."""
        size = self.end - self.start + 1
        stop = np.cumsum(size)
        kind = np.int32 if len(self.folded) < 1 << 31 else np.int64
        source = np.arange(stop[-1] if len(stop) else 0, dtype=kind) - np.repeat((stop - size - self.start).astype(kind), size)
        text = self.folded[source]
        text[stop - 1] = 0x20
        view, blake = memoryview(text), hashlib.blake2b
        begin = stop - size
        pairs = zip(begin[at].tolist(), (stop[at + n - 1] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join(blake(view[a:b], digest_size=16).digest() for a, b in pairs), np.uint64).reshape(-1, 2)


def _hashes(folded: np.ndarray, start: np.ndarray, end: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """Hashes of words; ``folded`` has 8 bytes more than the texts."""
    block = np.ndarray((len(folded) - 7,), "<u8", folded.data, strides=(1,))
    size = end - start
    value = block[start] & _MASKS[np.minimum(size, 8)]
    # a shorter word's unused top byte holds its length; words of 8 bytes whose top byte looks like one count as long
    first = value | (np.where(size < 8, size, 0).astype(np.uint64) << np.uint64(56))
    hashes = mix(first + np.uint64(key[0])) * np.uint64(key[1])
    long = np.flatnonzero((size > 8) | ((size == 8) & (value >> np.uint64(56) < np.uint64(8))))
    hashes[long] = mix(hashes[long] + size[long].astype(np.uint64) * _ODD)
    for k in range(8, _BLOCKS, 8):
        long = long[size[long] > k]
        if not len(long):
            return hashes
        hashes[long] = join(hashes[long], mix(block[start[long] + k] & _MASKS[np.minimum(size[long] - k, 8)]))
    secret = b"".join(x.to_bytes(8, "little") for x in key) if key != (0, 1) else b""
    for i in long[size[long] > _BLOCKS]:
        hashes[i] = int.from_bytes(hashlib.blake2b(folded[start[i] : end[i]], digest_size=8, key=secret).digest(), "little")
    return hashes


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def split_words(data: np.ndarray, offsets: np.ndarray, style: WordStyle) -> Words:
    word = ~style.separator[data]
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    full = np.flatnonzero(np.diff(offsets))
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    folded = np.zeros(len(data) + 8, np.uint8)
    folded[: len(data)] = style.fold[data]
    return Words(_hashes(folded, start, end, style.key), start, end, np.searchsorted(start, offsets), folded)


@dataclass
class Chunk:
    """Consecutive rows of a batch: their UTF-8 bytes, text offsets and the batch's rows themselves."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, style: WordStyle) -> Words:
        return split_words(self.data, self.offsets, style)

    def column(self, name: str) -> np.ndarray:
        """A column without nulls as numpy values."""
        return self.rows.column(self.rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts Arrow batches into chunks of about ``limit`` bytes of text; a null text counts as empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        if not len(texts):
            continue
        _, where, data = texts.buffers()
        offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield Chunk(batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
