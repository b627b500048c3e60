"""Main text of web pages by a maximum-scoring subsequence of words and tags.

Each word scores a positive, each kind of tag a negative weight; the contiguous run of tokens with the
largest sum is the content region, found by one linear scan. Weights come from pages that label
themselves: those with exactly one article element. A word's weight is the share of content among the
words of its container (the innermost sectioning element, apart if marked as no article text). For tags, a structured perceptron lowers those that
wrongly taken regions hold and raises those that wrongly lost ones do, with a margin: outside words
count several times, inside words a part, while it learns. What an article holds of menus, forms and the like counts neither way. Within the region, markup, and elements
that are no article text by their name or class, are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content isn't text, and those that part blocks (fixed values of the HTML standard).
RAW = "script|style|noscript|template|iframe|textarea|title"
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and class, id or role words, of what is not article text; those of headers count outside of articles only.
SECTIONS = frozenset("article aside body dialog div footer form head header main nav section".split())
OTHER = frozenset("nav aside footer form button dialog menu svg math object select".split())
#: Elements of other languages: a slash at the end of their tag closes them.
FOREIGN = frozenset("svg math".split())
OTHER_CLASSES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies footer gdpr menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe".split()
)
HEADERS = frozenset("header masthead".split())
#: Elements that are the article or hold it; their class doesn't make them other.
WHOLE = frozenset("html body main article".split())

# A tag's quotes are such after "=" only, and an unclosed tag, comment or raw element reaches to the end:
# every "<" that begins a token also ends one, so that a page is read in one pass.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+(?:>|\Z)"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]|\Z){_ATTRIBUTES}.*?(?:</\1(?=[\s/>]|\Z)[^>]*+(?:>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I
)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: A token: start and end in the page, tag name ("" for text, "!" for what is skipped), 1 if it closes, marked as other (2 in an article), number of words, container.
Token = tuple[int, int, str, int, int, int, str]


def _is_other(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds no article text, by its name and its class, id or role.

    In an article only whole names count: "related" does, "related-work" doesn't. Elsewhere each word of them does.
    """
    if name in OTHER or name in HEADERS and not in_article:
        return True
    if name in WHOLE or "=" not in attributes:
        return False
    marks = [a.strip("\"'").lower() for a in _MARK.findall(attributes)]
    if in_article:
        return any(not OTHER_CLASSES.isdisjoint(a.split()) for a in marks)
    words = {w for a in marks for w in re.split(r"[^a-z]+", a)}
    return not words.isdisjoint(OTHER_CLASSES | HEADERS)


def tokens(page: str) -> list[Token]:
    """The page's tokens, in one pass over it."""
    out: list[Token] = []
    inside, open_, last = ["body"], {}, 0

    def text(start: int, end: int) -> None:
        if end > start:
            out.append((start, end, "", 0, 0, len(page[start:end].split()), inside[-1]))

    for m in _TOKEN.finditer(page):
        text(last, m.start())
        name = (m[3] or "!").lower()
        if name in FOREIGN and not m[2] and m[4].rstrip(">").endswith("/"):
            name = "!"
        in_article = bool(open_.get("article") or open_.get("main"))
        marked = int(name != "!" and not m[2] and _is_other(name, m[4], in_article)) * (1 + in_article)
        if name in SECTIONS and not m[2]:
            open_.setdefault(name, []).append(len(inside))
            inside.append(name + "*" * bool(marked))
        elif m[2] and open_.get(name):
            depth = open_[name][-1]
            for closed in inside[depth:]:
                open_[closed.rstrip("*")].pop()
            del inside[depth:]
        out.append((m.start(), m.end(), name, int(bool(m[2])), marked, 0, ""))
        last = m.end()
    text(last, len(page))
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, as start and end; the first and shortest of equals."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


@dataclass
class Weights:
    """Negative weights by tag name, positive ones of a word by its container; ``other`` are those of names never seen."""

    tags: dict[str, float]
    words: dict[str, float]
    other: tuple[float, float] = (-2.0, 0.5)

    def of(self, token: Token) -> float:
        return token[5] * self.words.get(token[6], self.other[1]) if token[2] in ("", "!") else self.tags.get(token[2], self.other[0])


def _elements(found: list[Token]) -> Iterator[tuple[int, int, int]]:
    """Begin, end and mark of the marked elements that are closed."""
    open_: dict[str, list[int]] = {}
    for i, (_, _, name, closes, *_) in enumerate(found):
        if not closes and name not in VOID:
            open_.setdefault(name, []).append(i)
        elif closes and open_.get(name):
            begin = open_[name].pop()
            if found[begin][4]:
                yield begin, i, found[begin][4]


def _counted(found: list[Token]) -> list[bool]:
    """Which tokens score: what marked elements of an article hold neither adds to a region nor parts it."""
    out = [True] * len(found)
    until = -1
    for begin, end in sorted((begin, end) for begin, end, mark in _elements(found) if mark == 2):
        if end > until:
            out[max(begin, until + 1) : end + 1] = [False] * (end + 1 - max(begin, until + 1))
            until = end
    return out


def learn(pages: list[str], rounds: int = 12, step: float = 0.5) -> Weights:
    """Learns from pages with exactly one article element; others are passed over."""
    examples, content, all_ = [], Counter(), Counter()
    for page in pages:
        found = tokens(page)
        ends = [i for i, t in enumerate(found) if t[2] == "article"]
        if len(ends) == 2 and not found[ends[0]][3] and found[ends[1]][3]:
            examples.append((found, ends[0] + 1, ends[1], _counted(found)))
            for i, t in enumerate(found):
                all_[t[6]] += t[5]
                content[t[6]] += t[5] * (ends[0] < i < ends[1])
    weights = Weights({}, {k: max(0.02, content[k] / n) for k, n in all_.items() if n})
    for _ in range(rounds):
        wrong = 0
        for found, a, b, counted in examples:
            x, y = region(
                [
                    counted[i] * weights.of(t) * ((0.5 if a <= i < b else 4.0) if t[2] in ("", "!") else 1.0) for i, t in enumerate(found)
                ]
            )
            for i in [*range(min(a, x), max(a, x)), *range(min(b, y), max(b, y))]:
                name = found[i][2]
                if name not in ("", "!"):
                    wrong += 1
                    moved = weights.of(found[i]) + (step if a <= i < b else -step)
                    weights.tags[name] = min(moved, -0.05)
        if not wrong:
            break
    return weights


def _skipped(found: list[Token], a: int, b: int) -> dict[int, int]:
    """Begin and end of what marked elements hold of the region from a to b, but for those with more than half of its words."""
    words = [0, *accumulate(t[5] for t in found)]
    out: dict[int, int] = {}
    for begin, end, _ in _elements(found):
        begin, end = max(begin, a), min(end, b - 1)
        if begin <= end and 2 * (words[end + 1] - words[begin]) <= words[b] - words[a]:
            out[begin] = max(end, out.get(begin, end))
    return out


def main_text(page: str, weights: Weights) -> str:
    """The text of the page's best region: blocks joined by line feeds, white space within one as a space.

    Elements marked as other are left out, but for one with more than half of the region's words.
    """
    found = tokens(page)
    a, b = region([weights.of(t) * c for t, c in zip(found, _counted(found), strict=True)])
    skipped, blocks, now, i = _skipped(found, a, b), [], [], a
    while i < b:
        start, end, name = found[i][:3]
        if name == "":
            if i not in skipped:
                now.append(page[start:end])
        elif name != "!":
            if name == "br" or name in BLOCKS:
                now.append(" ")
            if name in BLOCKS:
                blocks.append("".join(now))
                now = []
        i = skipped.get(i, i) + 1
    blocks.append("".join(now))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in blocks) if t)


def fit(pages: DataFrame, limit: int = 1000, longest: int = 200_000, budget: int = 20_000_000) -> Weights:
    """Learns from ``limit`` self-labelled pages of at most ``longest`` characters, those with the least hashes (the documented bound).

    Of these it takes as many as have ``budget`` characters together: all, but for pages that are long on
    average. Hashes alone are ranked; pages are brought to the driver once they are chosen.
    """
    labelled = pages.select(F.col("html").cast("string").alias("html")).where(
        F.col("html").contains("<article") & (F.length("html") <= longest)
    )
    hashed = labelled.select("html", F.xxhash64("html").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    chosen: list[str] = []
    for r in hashed.where(F.col("h") <= last).distinct().orderBy("h", "html").toLocalIterator() if last is not None else ():
        budget -= len(r.html)
        if budget < 0:
            break
        chosen.append(r.html)
    return learn(chosen)


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, ``text`` and ``n_chars`` (its code points) of every row, from its whole html.

    A null or empty html, and one without words, give an empty text; broken markup is read as far as
    it goes (an open comment or script hides the rest); rows are worked on alone, so ids may repeat or be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", weights) for page in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
