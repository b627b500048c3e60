"""Jaccard similarity self-join of word-shingle sets by PartEnum signatures, and its link classes.

Linked sets of sizes a and b differ in at most k = (1 - t) / (1 + t) * (a + b) elements. Sizes fall into
bands whose ends have ratio t, so linked sets lie in the same or in neighbouring bands; each band has
one instance of the scheme for its own sets and those of the band below. An instance cuts the shingle
domain (the range of shingle hashes) into first-level parts, and each of these into second-level parts.
Enough first-level parts have so few differences that some subset of their second-level parts has none:
the contents of that subset are a signature which both sets have. Bands take the numbers of parts that
need the fewest signatures: small sets one first-level part with all subsets of its second-level ones,
others many first-level parts that are not cut again. A set gives signatures for as many
first-level parts as its own largest k asks for, and some to spare, so that parts which are empty, or
so common that they say nothing, can be left out without losing a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import PACKED, Packer, exchange, partitions, uniform_part
from .tables import doc_id, keyed, saved
from .words import LOWER, Chunk, WordStyle, chunks, mix

#: Up to so many row keys (24 bytes each) are broadcast to select texts; beyond, they are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Sets that are compared at once; a larger bucket is dealt out in blocks and pairs of blocks.
BLOCK = 4096


def _parts(k: int) -> int:
    """First-level parts for k differences: by the pigeonhole k + 1, and so many more that sets rarely have as many empty ones."""
    return int(np.ceil(1.4 * (k + 1))) + 3


@dataclass(frozen=True)
class Scheme:
    """Instance of one band: first-level parts, second-level parts in each, subsets to enumerate."""

    first: int
    second: int
    subsets: tuple[tuple[int, ...], ...]
    kept: int  # second-level differences that a subset tolerates

    def needed(self, k: int) -> int:
        """First-level parts to sign for at most k differences."""
        if self.first == 1:
            return 1
        return min(self.first, _parts(k))

    def sure(self, k: int) -> int:
        """Signatures that sets with at most k differences share at least."""
        return self.needed(k) - k if self.first > 1 else 1


class PartEnum:
    """Bands and their schemes for the similarity ``percent`` / 100."""

    def __init__(self, percent: int) -> None:
        self.percent, self.ends = percent, [0]
        while self.ends[-1] < 1 << 32:
            self.ends.append((self.ends[-1] + 1) * 100 // percent)
        self._ends = np.array(self.ends[1:])

    def band(self, n: int) -> int:
        return int(np.searchsorted(self._ends, n))

    def differences(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    @lru_cache(maxsize=256)
    def scheme(self, band: int) -> Scheme:
        k = self.differences(self.ends[band + 1], self.ends[band + 1])
        first, second, kept = (1, k + 2, k) if k <= 3 else (_parts(k), 1, 0)
        return Scheme(first, second, tuple(combinations(range(second), second - kept)), kept)

    @lru_cache(maxsize=65536)
    def tasks(self, n: int) -> list[tuple[int, int]]:
        """(instance, most differences) for a set of n: partners from its own band up, and from the bands above."""
        band, most = self.band(n), n * 100 // self.percent
        out = [(band, self.differences(n, min(most, self.ends[band + 1])))]
        if most > self.ends[band + 1]:
            out.append((band + 1, self.differences(n, most)))
        return out

    @lru_cache(maxsize=256)
    def sure(self, band: int) -> int:
        """Signatures of an instance that any of its linked pairs shares at least."""
        low = -(-(self.ends[band] + 1) * self.percent // 100)
        scheme = self.scheme(band)
        ks = {k for n in range(max(1, low), min(low + 64, self.ends[band + 1]) + 1) for b, k in self.tasks(n) if b == band}
        return min((scheme.sure(k) for k in ks), default=1)

    def spare(self, band: int) -> int:
        """Signatures of an instance that a set may leave out, the first ones of an order that all sets share."""
        return min(self.sure(band) - 1, 0xFFFF)

    def bounds(self, sets: dict[int, int]) -> np.ndarray:
        """Each instance's stretch of the partitions (from 0 to 1), as long as its share of all signatures; ``sets`` counts sets by band."""
        weights = np.zeros(len(self.ends) + 1)
        for band, count in sets.items():
            for instance, k in self.tasks(self.ends[band + 1]):
                scheme = self.scheme(instance)
                weights[instance] += count * scheme.needed(k) * len(scheme.subsets)
        return np.concatenate([[0.0], np.cumsum(weights) / max(weights.sum(), 1.0)])

    def signatures(self, elements: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Instance and signatures (uint64) of a sorted set of hashes."""
        return ((band, signs) for band, signs, _ in self.signed(elements))

    def signed(self, elements: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """Instance, signatures (uint64) of a sorted set of hashes, and how many of the ``spare`` ones are left out already."""
        for band, _, signs, left in self.signed_sets(Sets(elements, np.array([0, len(elements)]))):
            yield band, signs, int(left[0]) if len(left) else 0

    def signed_sets(self, sets: Sets) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Instance, then for each signature its set, itself, and how many of the ``spare`` ones the set has left out already.

        A set's elements are parted by their upper bits. Empty parts, by their place, come first in the
        order of those to leave out.
        """
        sizes, mixed = np.diff(sets.cuts), mix(sets.elements)
        members: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            for band, k in self.tasks(int(n)):
                members.setdefault(band, []).append((at, self.scheme(band).needed(k)))
        for band, asked in members.items():
            scheme, spare = self.scheme(band), self.spare(band)
            owner = np.concatenate([at for at, _ in asked])
            needed = np.concatenate([np.full(len(at), k) for at, k in asked]) * len(scheme.subsets)
            cuts = scheme.first * scheme.second
            for a in range(0, len(owner), max(1, _CELLS // cuts)):
                own, need = owner[a : a + max(1, _CELLS // cuts)], needed[a : a + max(1, _CELLS // cuts)]
                length = sizes[own]
                at = np.arange(length.sum()) + np.repeat(sets.cuts[own] - np.cumsum(length) + length, length)
                part = (((sets.elements[at] >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)).astype(np.int64)
                cell = np.repeat(np.arange(len(own)) * cuts, length) + part
                start = np.flatnonzero(np.diff(cell, prepend=-1))
                content, counts = np.zeros(len(own) * cuts, np.uint64), np.zeros(len(own) * cuts, np.int64)
                content[cell[start]] = np.add.reduceat(mixed[at], start)
                counts[cell[start]] = np.diff(np.append(start, len(cell)))
                content, counts = (x.reshape(len(own), scheme.first, scheme.second) for x in (content, counts))
                value = np.stack([content[:, :, s].sum(2, dtype=np.uint64) for s in map(list, scheme.subsets)], 2).reshape(len(own), -1)
                full = np.stack([counts[:, :, s].sum(2) for s in map(list, scheme.subsets)], 2).reshape(len(own), -1) > 0
                place = (np.arange(value.shape[1], dtype=np.uint64) | np.uint64(band << 40)) + np.uint64(1)
                signs = mix(value ^ mix(place * np.uint64(0x9E3779B97F4A7C15)))
                wanted = np.arange(value.shape[1]) < need[:, None]
                empty = wanted & ~full
                left = np.minimum(empty.sum(1), spare)
                kept = wanted & ~(empty & (np.cumsum(empty, 1) <= spare))
                of = np.nonzero(kept)[0]
                yield band, own[of], signs[kept], left[of]


#: Parts of sets that are worked on at once.
_CELLS = 1 << 19


@dataclass
class Sets:
    """Sorted sets of hashes, end to end; ``cuts`` are their bounds."""

    elements: np.ndarray
    cuts: np.ndarray

    def names(self) -> np.ndarray:
        """64-bit ids: equal sets have the same one."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.elements))])
        return mix(np.diff(sums[self.cuts]) + np.diff(self.cuts).astype(np.uint64)).view(np.int64)

    def sketches(self) -> list[bytes]:
        """Parities of each set's elements by their low bits; differ in no more bits than the sets in elements.

        With two to four bits an element, sets of a similarity up to 0.7 are told from those of 0.75 and more.
        """
        sizes, out = np.diff(self.cuts), [b""] * (len(self.cuts) - 1)
        bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
        low = mix(self.elements)
        for width in np.unique(bits):
            chosen = np.flatnonzero(bits == width)
            for a in range(0, len(chosen), max(1, _CELLS // int(width))):
                own = chosen[a : a + max(1, _CELLS // int(width))]
                length = sizes[own]
                at = np.arange(length.sum()) + np.repeat(self.cuts[own] - np.cumsum(length) + length, length)
                bit = np.repeat(np.arange(len(own)) * width, length) + (low[at] & np.uint64(width - 1)).astype(np.int64)
                odd = (np.bincount(bit, minlength=len(own) * int(width)) & 1).astype(np.uint8)
                for i, row in zip(own, np.packbits(odd.reshape(len(own), -1), axis=1, bitorder="little"), strict=True):
                    out[i] = row.tobytes()
        return out


_SIGNED = ("u4", "u1", "u8=", "u1", "u2")
_SHARED = ("u8", "u8", "u1", "u4", "u2")
_KEPT = ("u8", "u8")


def _sets(chunk: Chunk, shingle: int, style: WordStyle) -> Sets:
    """Shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    words = chunk.words(style)
    at, hashes = words.windows(shingle)
    counts, first = np.diff(words.first), np.searchsorted(at, words.first)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    sizes = np.diff(first)
    sizes[short] = 1
    ends = np.cumsum(sizes)
    elements, own = np.empty(ends[-1] if len(ends) else 0, np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    whole = np.zeros(len(sizes), bool)
    whole[short] = True
    elements[~whole[own]], elements[whole[own]] = hashes, words.spans(words.first[short], counts[short])
    for i in np.flatnonzero(sizes > 1):
        elements[ends[i] - sizes[i] : ends[i]].sort()
    new = np.ones(len(elements), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (own[1:] != own[:-1])
    return Sets(elements[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(sizes)))]))


def _same_length(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded to the shortest."""
    n = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, n // 8), 0) for s in sketches])


def _describe(rows: DataFrame, shingle: int, style: WordStyle) -> DataFrame:
    """key, salt, node (set id; null for the empty set), n and the set's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            sets = _sets(chunk, shingle, style)
            n = np.diff(sets.cuts)
            yield pa.record_batch({
                "key": pa.array(chunk.column("key")), "salt": pa.array(chunk.column("salt")), "node": pa.array(sets.names(), mask=n == 0),
                "n": pa.array(n, pa.int64()), "sketch": pa.array(sets.sketches(), pa.binary(), mask=n == 0),
            })

    return rows.mapInArrow(run, "key long, salt long, node long, n long, sketch binary")


def _groups(sign: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct (sign, node) records whose sign has several nodes, in order; nodes of each place's sign."""
    order = np.argsort(sign, kind="stable")
    same = sign[order[1:]] == sign[order[:-1]]
    several = np.zeros(len(order), bool)
    several[1:] |= same
    several[:-1] |= same
    order = order[several]
    order = order[np.lexsort((node[order], sign[order]))]
    s, n = sign[order], node[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    order = order[new]
    start = np.flatnonzero(np.diff(sign[order], prepend=~sign[order[:1]]))
    count = np.diff(np.append(start, len(order)))
    count = np.repeat(count, count)
    return order[count > 1], count[count > 1]


def _dealt(signs: np.ndarray, band: int, bounds: np.ndarray, parts: int) -> np.ndarray:
    """Partitions of an instance's signatures, inside its stretch of them.

    So a set's signatures lie in few partitions, and there one after the other: its name repeats, which the shuffle compresses.
    """
    at = bounds[band] + (signs >> np.uint64(40)) / float(1 << 24) * (bounds[band + 1] - bounds[band])
    return np.minimum((at * parts).astype(np.int64), parts - 1)


def _bounds(described: DataFrame, scheme: PartEnum) -> np.ndarray:
    """Stretches of the instances, by how many different sets each band has (about; one row a band)."""
    band = F.size(F.filter(F.array(*map(F.lit, scheme.ends[1:])), lambda end: end < F.col("n")))
    counts = described.where("node is not null").groupBy(band.alias("band")).agg(F.approx_count_distinct("node").alias("sets"))
    return scheme.bounds({r["band"]: r["sets"] for r in counts.collect()})


def _members(rows: DataFrame, parts: int, scheme: PartEnum, shingle: int, style: WordStyle, bounds: np.ndarray) -> DataFrame:
    """(bucket, block, blocks, node): the sets to compare in each bucket of a signature, in blocks of ``BLOCK``.

    Records of signatures are dealt by signature, inside their instance's stretch of the partitions, those that several sets share then by set: a linked
    pair shares at least ``sure`` signatures of its instance, so each set may leave out its first
    ``sure`` - 1, in one order for all sets, and still meets every partner: those of empty parts, which
    are never sent, and then the most common ones. The others are dealt by
    signature again. Common passages thus cost their records, not pairs of the documents that hold them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(parts, *_SIGNED), set()
        for chunk in chunks(batches):
            sets = _sets(chunk, shingle, style)
            names = sets.names()
            new = np.zeros(len(names), bool)
            for i, name in enumerate(names.tolist()):
                if name not in seen:
                    new[i] = True
                    seen.add(name)
            kept = Sets(sets.elements[np.repeat(new, np.diff(sets.cuts))], np.concatenate([[0], np.cumsum(np.diff(sets.cuts)[new])]))
            nodes = names[new].view(np.uint64)
            for band, of, signs, left in scheme.signed_sets(kept):
                yield from packer.add(
                    _dealt(signs, band, bounds, parts), signs & np.uint64(0xFFFFFFFF), (signs >> np.uint64(32)) & np.uint64(0xFF), nodes[of],
                    np.full(len(signs), band), left
                )
        yield from packer.flush()

    def share(
        part: int, low: np.ndarray, high: np.ndarray, node: np.ndarray, band: np.ndarray, left: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        # 40 bits of a signature and its partition: chance meetings are rare, and every pair is verified
        sign = (high.astype(np.uint64) << np.uint64(32)) | low
        at, times = _groups(sign, node)
        packer = Packer(parts, *_SHARED)
        sign = mix(sign[at] | np.uint64((part & 0xFFFFFF) << 40))
        yield from packer.add(uniform_part(mix(node[at]), parts), sign, node[at], band[at], times, left[at])
        yield from packer.flush()

    def leave_out(
        _: int, sign: np.ndarray, node: np.ndarray, band: np.ndarray, times: np.ndarray, left: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((sign, ~times, band, node))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(node[order]) != 0) | (np.diff(band[order]) != 0)
        start = np.flatnonzero(new)
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        spare = np.array([scheme.spare(b) for b in range(int(band.max()) + 1)])
        kept = order[rank + left[order] >= spare[band[order]]]
        packer = Packer(parts, *_KEPT)
        yield from packer.add(uniform_part(sign[kept], parts), sign[kept], node[kept])
        yield from packer.flush()

    def meet(_: int, sign: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, count = _groups(sign, node)
        sign, node = sign[at], node[at].view(np.int64)
        if not len(sign):
            return
        start = np.flatnonzero(np.diff(sign, prepend=~sign[:1]))
        count = count[start]
        # the same sets share many signatures: one bucket for all of them
        few = np.unique(np.add.reduceat(mix(node.view(np.uint64)), start) ^ mix(count.astype(np.uint64)), return_index=True)
        name, few = few[0].view(np.int64), few[1]
        lengths = count[few]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        member = node[np.repeat(start[few], lengths) + inside]
        columns = [np.repeat(name, lengths), inside // BLOCK, np.repeat(-(-lengths // BLOCK), lengths), member]
        for a in range(0, len(member), 1 << 16):
            yield pa.record_batch([pa.array(c[a : a + (1 << 16)]) for c in columns], ["bucket", "block", "blocks", "node"])

    shared = exchange(rows.mapInArrow(send, PACKED), _SIGNED, share, PACKED, parts)
    kept = exchange(shared, _SHARED, leave_out, PACKED, parts)
    return exchange(kept, _KEPT, meet, "bucket long, block long, blocks long, node long", parts).distinct()


class _Bucket:
    """Sets of a bucket, compared by their sizes and sketches, which excludes no linked pair.

    Of two blocks only pairs across them are looked for.
    """

    def __init__(self, nodes: list, sizes: list, sketches: list, classes: list, blocks: list, percent: int) -> None:
        self.nodes, self.n, self.classes = nodes, np.array(sizes), np.unique(classes, return_inverse=True)[1]
        self.sketches, self.percent, self.blocks = _same_length(sketches), percent, np.array(blocks)
        self.across = self.blocks.min() != self.blocks.max()

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that may be linked with i."""
        n, m = int(self.n[i]), self.n[others]
        differing = np.bitwise_count(self.sketches[others] ^ self.sketches[i]).sum(1, dtype=np.int64)
        near = differing * (100 + self.percent) <= (100 - self.percent) * (n + m)
        return others[near & (np.maximum(n, m) * self.percent <= np.minimum(n, m) * 100)]

    def all_pairs(self) -> Iterator[tuple[int, int]]:
        """Every near pair of different classes; one of the two is outside the largest class."""
        left = np.ones(len(self.nodes), bool)
        for i in np.flatnonzero(self.classes != np.bincount(self.classes).argmax()):
            left[i] = False
            others = left & (self.classes != self.classes[i])
            if self.across:
                others &= self.blocks != self.blocks[i]
            for j in self.near(i, np.flatnonzero(others)):
                yield self.nodes[i], self.nodes[j]

    def forest(self) -> Iterator[tuple[int, int]]:
        """Near pairs that join the classes as far as all near pairs do, without more of them than that takes."""
        left = np.ones(len(self.nodes), bool)
        for start in range(len(self.nodes)):
            if not left[start]:
                continue
            open_ = list(np.flatnonzero(left & (self.classes == self.classes[start])))
            left[open_] = False
            while open_ and left.any():
                i = open_.pop()
                found = self.near(i, np.flatnonzero(left))
                if len(found):
                    new, at = np.unique(self.classes[found], return_index=True)
                    yield from ((self.nodes[i], self.nodes[j]) for j in found[at])
                    joined = np.flatnonzero(left & np.isin(self.classes, new))
                    left[joined] = False
                    open_ += list(joined)


def _near_pairs(members: DataFrame, parts: int, classes: DataFrame | None, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (bucket, a, b), a > b, to verify: of sets in one bucket that are near by their sketches.

    Without classes, enough pairs to join what the near pairs within a block do; with them, every near
    pair of sets in different classes. Pairs are looked for inside the task that holds a block, or two
    blocks of a bucket; a row is made only for near ones.
    """
    every = classes is not None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _and_end(batches):
            if batch is not None:
                held.append(batch)
                if _place(batch, -1) == _place(held[0], 0):
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held)
            places = np.stack([table.column(i).to_numpy() for i in range(3)])
            changed = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1
            end = len(table) if batch is None else int(changed[-1])
            cuts = np.array([0, *(int(c) for c in changed if c < end), end])
            pairs, rest = _twos(table, cuts, percent)
            if len(pairs):
                yield pa.record_batch(
                    [pa.array(places[0, pairs[:, 0]]), *(pa.array(x) for x in _larger_first(table.column(3).to_numpy()[pairs]))],
                    ["bucket", "a", "b"]
                )
            for a, b in zip(cuts[:-1][rest].tolist(), cuts[1:][rest].tolist(), strict=True):
                part = [table.column(c).slice(a, b - a).to_pylist() for c in range(3, 8)]
                if b - a > 1 and len(set(part[3])) > 1:
                    bucket = _Bucket(*part, percent)
                    found = bucket.all_pairs() if every else bucket.forest()
                    while pairs := list(islice(found, _PAIRS)):
                        yield pa.record_batch(
                            [pa.array(x, pa.int64()) for x in zip(*((places[0, a], max(p), min(p)) for p in pairs), strict=True)],
                            ["bucket", "a", "b"]
                        )
            held = table.slice(end).combine_chunks().to_batches()

    rows = members
    if every:
        placed = rows.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = saved(
            placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("bucket")
        )
        rows = placed.join(several, "bucket", "left_semi").withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        )
    else:
        rows = rows.withColumns({"component": F.col("node"), "other": F.col("block")})
    rows = rows.select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "component",
        "block"
    )
    dealt = rows.join(sketches, "node").select("bucket", "low", "high", "node", "n", "sketch", "component", "block")
    dealt = dealt.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    return dealt.mapInArrow(search, "bucket long, a long, b long")


#: Pairs of one row batch.
_PAIRS = 1 << 16


def _twos(table: pa.Table, cuts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (as rows of the table) of all buckets of two sets whose sketches are equally long, and the other buckets."""
    sketches = table.column(5).combine_chunks()
    _, offsets, data = sketches.buffers()
    offsets = np.frombuffer(offsets, np.int32)[sketches.offset : sketches.offset + len(sketches) + 1].astype(np.int64)
    width, n, classes = np.diff(offsets), table.column(4).to_numpy(), table.column(6).to_numpy()
    a = cuts[:-1]
    two = np.diff(cuts) == 2
    two[two] = width[a[two]] == width[a[two] + 1]
    out = []
    for w in np.unique(width[a[two]]):
        x = a[two][width[a[two]] == w]
        x = x[classes[x] != classes[x + 1]]
        for i in range(0, len(x), max(1, (1 << 22) // int(w))):
            p = x[i : i + max(1, (1 << 22) // int(w))]
            left, right = (np.frombuffer(data, np.uint8)[offsets[q][:, None] + np.arange(w)].view(np.uint64) for q in (p, p + 1))
            differing = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
            small, large = np.minimum(n[p], n[p + 1]), np.maximum(n[p], n[p + 1])
            near = (differing * (100 + percent) <= (100 - percent) * (small + large)) & (large * percent <= small * 100)
            out.append(np.stack([p[near], p[near] + 1], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64), np.flatnonzero(~two)


def _larger_first(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pairs.max(1), pairs.min(1)


def _place(batch: pa.RecordBatch, i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c in range(3))


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _linked(pairs: DataFrame, places: DataFrame, rows: DataFrame, percent: int, shingle: int, style: WordStyle) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, decided on the whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (p, q))
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            sets = _sets(chunk, shingle, style)
            data = [sets.elements[a:b].tobytes() for a, b in zip(sets.cuts[:-1], sets.cuts[1:], strict=True)]
            yield pa.record_batch({"node": pa.array(chunk.column("node")), "elements": pa.array(data, pa.binary())})

    chosen = saved(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(places, "node"))
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    # written once: a set that is in many pairs can then be dealt out to several tasks
    content = saved(
        rows.join(chosen, ["key", "salt"]).select("node", "text").mapInArrow(elements, "node long, elements binary").dropDuplicates(["node"])
    )
    full = pairs.join(content.toDF("a", "x"), "a").join(content.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return saved(full.mapInArrow(compare, "a long, b long"))


def link_classes(documents: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """Classes of documents connected by links between similar sets of word shingles.

    A set holds the distinct ``shingle``-word sequences of a text, its ASCII letters lower-cased; a text
    of fewer words has one, one without words (or null) has none and no links. Two sets are linked when
    100 * intersection >= ``percent`` * union. Returns key columns, ``doc_id``, ``n_shingles``,
    ``component_id``, the least doc_id reachable by links (its own at least; null doc_ids stay null
    and never are the least), and ``class``, which rows share if and only if they are connected (null
    without words). Equal texts are one set, whatever their number; rows are never paired within a
    group. Sets hold 64-bit hashes of their shingles and are told apart by 64 bits of these: what
    differs is taken for equal by chance only (one pair of 10**9 different sets with a probability of 3 %),
    as words are hashed under a key drawn for each call.
    """
    scheme, rows, parts, style = PartEnum(percent), keyed(documents), partitions(documents), LOWER.keyed()
    described = saved(_describe(rows, shingle, style))
    members = saved(_members(rows, parts, scheme, shingle, style, _bounds(described, scheme)))
    nodes = described.where("node is not null").groupBy("node")
    sketches, places = nodes.agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch")
    ), nodes.agg(F.min(F.struct("key", "salt")).alias("at")).select("node", "at.*")
    found = saved(_near_pairs(members, parts, None, sketches, percent))
    tested = saved(found.select("a", "b").distinct())
    links = _linked(tested, places, rows, percent, shingle, style)
    classes = saved(components(links))
    # where a near pair was no link after all, or its bucket has several blocks, classes may be linked by another pair
    failed = tested.join(links, ["a", "b"], "left_anti")
    again = saved(
        found.join(failed, ["a", "b"], "left_semi").select("bucket").union(members.where("blocks > 1").select("bucket")).distinct()
    )
    if not again.isEmpty():
        rest = _near_pairs(members.join(again, "bucket", "left_semi"), parts, classes, sketches, percent)
        rest = saved(rest.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            classes = saved(components(links.unionByName(_linked(rest, places, rows, percent, shingle, style))))
    # tables with one row a key are written before they are joined, so that Spark can split a large class's rows
    owners = saved(nodes.agg(F.min(doc_id()).alias("own")))
    least = saved(classes.join(owners, "node").groupBy("component").agg(F.min("own").alias("least")))
    of_node = saved(
        owners.join(classes.join(least, "component"), "node", "left").select(
            "node", F.coalesce("component", "node").alias("class"),
            F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("least")).alias("component_id")
        )
    )
    columns = ["key", "salt", doc_id(), F.col("n").alias("n_shingles")]
    linked = described.where("node is not null").join(of_node, "node").select(*columns, "component_id", "class")
    return linked.unionByName(
        described.where("node is null").select(*columns, doc_id().alias("component_id"), F.lit(None).cast("long").alias("class"))
    )
