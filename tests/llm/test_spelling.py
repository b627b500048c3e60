"""Spelling variants against brute force, with every odd row."""

import random
import re
import zlib
from collections import Counter

import pytest

from skylog.llm import spelling
from skylog.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute_counts(rows, slip=None):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def shadows(w):
    """Names that two words share if and only if they are one edit apart or equal, but for chance."""
    return [("cut", w[:i] + w[i + 1 :]) for i in range(len(w))], [("put", w[:i] + "?" + w[i + 1 :]) for i in range(len(w))]


def brute_near(words):
    by, near = {}, {w: set() for w in words}
    for w in words:
        for s in set(shadows(w)[1]):
            by.setdefault(s, []).append(w)
        for _, s in shadows(w)[0]:
            if s in near and s != w:
                near[w].add(s)
                near[s].add(w)
    for group in by.values():
        for w in group:
            near[w] |= {x for x in group if x != w}
    return near


def brute_variants(counts):
    near, out = brute_near(counts), {}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts.get(form[w]), root)
    return out


def got_variants(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def some_words(seed, n, letters, longest):
    random.seed(seed)
    out = {}
    while len(out) < n:
        w = "".join(random.choice(letters) for _ in range(random.randint(1, longest)))
        for _ in range(random.randint(1, 4)):
            out[w] = random.choice([3, 3, 4, 7, 16, 40, 41, 100])
            p = random.randrange(len(w) + 1)
            w = random.choice([w[:p] + w[p + 1 :], w[:p] + random.choice(letters) + w[p:], w[:p] + random.choice(letters) + w[p + 1 :]]) or "a"
    return out


@pytest.mark.parametrize(("seed", "n", "letters", "longest"), [(1, 400, "ab", 7), (2, 500, "abcé", 12), (3, 300, "aé的😀", 30), (4, 3, "a", 4)])
def test_variants(spark, seed, n, letters, longest):
    counts = some_words(seed, n, letters, longest)
    words = spark.createDataFrame([(w, c, "x") for w, c in counts.items()], "word string, n long, node string").repartition(3)
    assert got_variants(spelling.variants(words)) == brute_variants(counts)


def test_long_words_chains_and_one_hot_prefix(spark):
    random.seed(5)
    hot = "".join(random.choice("abcde") for _ in range(60))
    long = "".join(random.choice("abcde") for _ in range(20_000))
    counts = {long: 3, long[:-1]: 6, long[:9000] + "x" + long[9001:]: 20, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "a" * 9: 48}
    counts |= {hot + "".join(random.choice("ab") for _ in range(random.randint(1, 6))): random.choice([3, 9, 27]) for _ in range(60)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = got_variants(spelling.variants(words))
    assert got == brute_variants(counts)
    assert got["aaaaa"][4] == "a" * 9
    assert got[long][2] == long[:9000] + "x" + long[9001:]


def test_no_words(spark):
    none = spark.createDataFrame([(None, 5), ("", 4)], "word string, n long")
    assert spelling.near_words(none).count() == 0
    assert spelling.variants(none.limit(0)).count() == 0


@pytest.mark.parametrize("slip", [None, 3])
def test_word_counts(spark, slip, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 20)
    rows = [
        (1, None), (2, ""), (3, "Straße ÀÉÎ× naïve"), (None, "Étude étude Étude hello hello hello"), (4, "naïve naïve-naïve Straße,STRASSE straSSe"),
        (5, "hello hello " * 500), (6, "x" * 3000 + " " + "x" * 3000), (6, "x" * 3000), (7, "的hello的 abcde\nabcdé abcde abcde"), (8, "-- 123 ö"), (8, "endsé"), (9, "éends"),
    ]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string").repartition(2)
    got = spelling.word_counts(docs, slip=slip).collect()
    assert {r.word: r.n for r in got} == brute_counts(rows, slip)
    assert len({r.word for r in got}) == len(got)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = got_variants(QUERIES["op11_spelling_variants"](spark, DATA))
    want = brute_variants(brute_counts(rows, 97))
    assert got == want
    assert sum(v[2] is not None for v in want.values()) > 50
