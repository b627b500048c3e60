"""Token counts of documents that are edited, without encoding them anew.

A document keeps runs of pre-tokens in leaves, and the token and character counts of the leaves in
segment trees; ``build_trees`` makes a table of them, which a job can write and any later one edit.
Leaves part where a letter or digit is followed by one space and a letter: there the splitter parts
pre-tokens whatever else the text holds, so leaves can be encoded on their own. An edit touches the
leaves it overlaps; if a boundary of these no longer has that form, the leaf beyond it is taken in as
context. Only these leaves are encoded again, cut anew where they have grown, and only the sums on the
way from them to the root change. A tokenizer whose file has another splitter gets one leaf a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import doc_id, key_columns, saved
from .tokens import default_path, encoder

#: Characters of a leaf when it is cut; it is cut anew when it has grown to twice as many.
LEAF = 512
TREES = "key long, salt long, leaves array<string>, tokens array<long>, chars array<long>"


def _parts(before: str, after: str) -> bool:
    """Whether pre-tokens part between the two texts, by the characters next to the boundary."""
    return before[-1:].isalnum() and after[:1] == " " and after[1:2].isalpha()


def _cut(text: str) -> list[str]:
    """The text in leaves of ``LEAF`` characters at least, but for the last."""
    out, at = [], 0
    while at < len(text):
        end = text.find(" ", at + LEAF)
        while end >= 0 and not _parts(text[end - 1 : end], text[end : end + 2]):
            end = text.find(" ", end + 1)
        out.append(text[at : end if end >= 0 else len(text)])
        at += len(out[-1])
    return out


class CountTree:
    """Token counts of one text under edits. ``tokens`` and ``chars`` are trees: 1 is the root, 2i and 2i + 1 are below i."""

    def __init__(self, text: str, encode) -> None:
        self.encode, self.encoded = encode, 0
        leaves = self._cut(text)
        self._plant(leaves, [self._count(x) for x in leaves])

    @classmethod
    def kept(cls, leaves: list[str], tokens: list[int], chars: list[int], encode) -> CountTree:
        """A tree as it was written: nothing is encoded."""
        tree = cls.__new__(cls)
        tree.encode, tree.encoded, tree.leaves, tree.base = encode, 0, list(leaves), len(tokens) // 2
        tree.tokens, tree.chars = np.array(tokens, np.int64), np.array(chars, np.int64)
        return tree

    def _cut(self, text: str) -> list[str]:
        return _cut(text) if self.encode.parts_at_spaces else [text] if text else []

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encode(text)) if text else 0

    def _plant(self, leaves: list[str], counts: list[int]) -> None:
        """The sums over leaves whose counts are known."""
        self.leaves = leaves
        self.base = 1 << max(0, len(leaves) - 1).bit_length()
        self.tokens, self.chars = (np.zeros(2 * self.base, np.int64) for _ in range(2))
        self.tokens[self.base : self.base + len(leaves)] = counts
        self.chars[self.base : self.base + len(leaves)] = [len(x) for x in leaves]
        level = self.base
        while level > 1:
            for sums in (self.tokens, self.chars):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _set(self, leaf: int, text: str, count: int) -> None:
        i = self.base + leaf
        change = np.array([count, len(text)]) - (self.tokens[i], self.chars[i])
        self.leaves[leaf] = text
        while i:
            self.tokens[i] += change[0]
            self.chars[i] += change[1]
            i //= 2

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character position, and its own start."""
        i, start, at = 1, 0, min(at, int(self.chars[1]) - 1)
        while i < self.base:
            i *= 2
            if at >= start + self.chars[i]:
                start += int(self.chars[i])
                i += 1
        return i - self.base, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in place of the characters from start to end."""
        start, end = max(0, min(start, int(self.chars[1]))), max(0, min(end, int(self.chars[1])))
        if not self.chars[1]:
            leaves = self._cut(new)
            self._plant(leaves, [self._count(x) for x in leaves])
            return
        first, first_at = self._leaf(start)
        last = max(first, self._leaf(max(start, end - 1))[0])
        text = "".join(self.leaves[first : last + 1])
        text = text[: start - first_at] + new + text[max(start, end) - first_at :]
        while (
            before := next((i for i in range(first - 1, -1, -1) if self.leaves[i]), None)
        ) is not None and not _parts(self.leaves[before], text):
            text, first = self.leaves[before] + text, before
        while (
            after := next((i for i in range(last + 1, len(self.leaves)) if self.leaves[i]), None)
        ) is not None and not _parts(text, self.leaves[after]):
            text, last = text + self.leaves[after], after
        leaves = self._cut(text) if len(text) >= 2 * LEAF else [text]
        counts, places = [self._count(x) for x in leaves], last + 1 - first
        if len(leaves) > places:
            own = self.tokens[self.base : self.base + len(self.leaves)].tolist()
            self._plant([*self.leaves[:first], *leaves, *self.leaves[last + 1 :]], [*own[:first], *counts, *own[last + 1 :]])
            return
        for i in range(places):
            text, count = (leaves[i], counts[i]) if i < len(leaves) else ("", 0)
            if text or self.leaves[first + i]:
                self._set(first + i, text, count)


def build_trees(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The trees of all documents (``TREES``), one for each row. Null texts count as empty: a tree without leaves."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                trees = [CountTree(text.as_py() or "", encode) for text in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), *_columns(trees)], ["key", "salt", "leaves", "tokens", "chars"])

    return documents.select(*key_columns(), F.col("text").cast("string").alias("text")).mapInArrow(run, TREES)


def _columns(trees: list[CountTree]) -> list[pa.Array]:
    return [
        pa.array([t.leaves for t in trees], pa.list_(pa.string())), pa.array([t.tokens for t in trees], pa.list_(pa.int64())),
        pa.array([t.chars for t in trees], pa.list_(pa.int64()))
    ]


def edit_trees(trees: DataFrame, edits: DataFrame, tokenizer: str | None = None, keep: bool = True) -> DataFrame:
    """The trees after their edits, whose key columns stay; each tree is read as it was written.

    ``edits`` has doc_id, n (order), start, end (characters of the text as edited so far) and new_text;
    positions beyond the text are moved to its end, nulls count as 0 or empty, edits without a document
    are passed over, documents without edits come back as they are. Rows of one doc_id all get its edits.
    Adds ``n_tokens_before``, ``n_tokens``, ``n_chars`` and ``n_encoded``, the characters encoded again
    for the edits. Without ``keep``, the trees themselves are left out. A document's edits are gathered
    with it, and no others.
    """
    path = tokenizer or default_path()
    edit = F.struct(
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("start", "end")),
        F.coalesce("new_text", F.lit("")).alias("new_text")
    )
    # one row a key, written before it is joined, so that Spark can split the rows of a frequent doc_id
    lists = saved(
        edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(
            F.array_sort(F.collect_list(edit)).alias("edits")
        )
    )
    counts = "n_tokens_before long, n_tokens long, n_chars long, n_encoded long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            done, out = [], []
            for leaves, tokens, chars, own in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                tree = CountTree.kept(leaves.as_py(), tokens.values.to_numpy(), chars.values.to_numpy(), encode)
                before = tree.count
                for e in own.as_py() or ():
                    tree.replace(e["start"], e["end"], e["new_text"])
                done += [tree] if keep else []
                out.append((before, tree.count, int(tree.chars[1]), tree.encoded))
            names = ["key", "salt", *(["leaves", "tokens", "chars"] if keep else []), "n_tokens_before", "n_tokens", "n_chars", "n_encoded"]
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), *(_columns(done) if keep else []),
                    *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))
                ],
                names
            )

    rows = trees.join(lists, "key", "left").select("key", "salt", "leaves", "tokens", "chars", "edits")
    return rows.mapInArrow(run, f"{TREES}, {counts}" if keep else f"key long, salt long, {counts}")


def count_edited(documents: DataFrame, edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Token counts of all documents before and after their edits: ``build_trees``, then ``edit_trees``.

    Returns ``doc_id``, ``n_tokens``, ``n_tokens_edited``, ``n_chars_edited`` and ``n_encoded``. Null
    texts count as empty.
    """
    done = edit_trees(build_trees(documents, tokenizer), edits, tokenizer, keep=False)
    return done.select(
        doc_id(), F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
        F.col("n_chars").alias("n_chars_edited"), "n_encoded"
    )
