"""The operators that compare documents, against brute force on small tables with every odd row."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skylog.llm import decontaminate, ngram_join, substring_dedup
from skylog.llm.ngram_join import PartEnum
from skylog.llm.words import LOWER, split_words

SCHEMA = "doc_id long, text string, lang string, key string, salt string, node string, places string"


def table(spark, rows):
    """Documents with more columns, whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "k", None, "n", "p") for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 5))) for _ in range(150)]
    passage = [random.choice(vocabulary) for _ in range(45)]
    docs, texts = [], []
    for i in range(n):
        if texts and random.random() < 0.5:
            words = random.choice(texts).split()
            for _ in range(random.randint(0, 4)):
                if words:
                    words[random.randrange(len(words))] = random.choice(vocabulary)
        else:
            words = [random.choice(vocabulary) for _ in range(random.choice([3, 8, 40, 150, 400]))]
        if random.random() < 0.2:
            words = words[:10] + passage + words[10:]
        text = "".join(w + random.choice([" ", "  ", "\n", "\t"]) for w in words)
        texts.append(text)
        docs.append((i * 7, text))
    long = " ".join(random.choice(vocabulary) for _ in range(30_000))
    return docs + [
        (1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "One"), (1005, "a b c d"), (1006, long),
        (1007, long + " more"), (1008, "x" * 50_000), (None, "no id here but words enough to count"), (5, docs[0][1]),
        (0, docs[0][1])
    ]


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed", [1, 2])
def test_link_classes(spark, seed):
    rows = corpus(seed)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(table(spark, rows)).collect())
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    want = Counter((d, len(s[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows))
    assert got == want


def test_signatures_meet(spark):
    """Sets at the similarity bound share a kept signature, whatever their sizes."""
    random.seed(4)
    import numpy as np

    scheme = PartEnum(75)
    for n in (1, 2, 3, 4, 7, 12, 20, 33, 80, 400, 1500):
        for _ in range(12):
            a = {random.getrandbits(64) for _ in range(n)}
            b = set(a)
            for _ in range(random.randint(0, n // 5 + 1)):
                b.discard(random.choice(sorted(b))) if b and random.random() < 0.5 else b.add(random.getrandbits(64))
            if b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = ({band: set(v.tolist()) for band, v in scheme.signatures(np.array(sorted(z), np.uint64))} for z in (a, b))
                shared = {band: len(x[band] & y[band]) for band in x.keys() & y.keys()}
                assert any(k >= scheme.sure(band) for band, k in shared.items()) or any(shared.values())
    assert scheme.band(3) == scheme.band(4) != scheme.band(5)


def test_short_near_copies_meet(spark):
    """Pairs at the similarity bound are linked, though some parts are empty in both and nobody else shares their signatures."""
    rows, n = [], 0
    for size in range(11, 61):
        for _ in range(8):
            words = [f"w{n}x{i}" for i in range(size + 4 + size // 7)]
            rows += [(n, " ".join(words[: size + 4])), (n + 1, " ".join(words[size // 7 :]))]
            n += 2
    got = {r.doc_id: r.component_id for r in ngram_join.link_classes(table(spark, rows)).collect()}
    assert [i for i, c in got.items() if c != i - i % 2] == []


def test_signatures_left_out_once():
    """Of what sets at the bound share, a signature of a part that is not empty is left when each has left out its spare ones."""
    import numpy as np

    scheme, random_ = PartEnum(75), random.Random(11)
    for n in range(11, 61):
        for _ in range(10):
            both = [random_.getrandbits(64) for _ in range(n - n // 7)]
            signed = [
                {
                    b: (v, left) for b, v,
                    left in scheme.signed(np.array(sorted(both + [random_.getrandbits(64) for _ in range(n // 7)]), np.uint64))
                } for _ in range(2)
            ]
            met = False
            for band in signed[0].keys() & signed[1].keys():
                (x, i), (y, j) = signed[0][band], signed[1][band]
                shared = np.intersect1d(x, y)
                assert len(shared) >= scheme.sure(band) - min(i, j)
                met |= bool(len(shared[scheme.spare(band) - i :]) and len(shared[scheme.spare(band) - j :]))
            assert met


def thue_morse(k):
    """Two complementary words of 2**k letters, whose polynomial hashes modulo 2**64 are equal from 2**10 on."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [10, 11])
def test_words_that_fool_polynomial_hashes(spark, k):
    x, y = thue_morse(k)
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(1, x), (2, y), (3, f"{x} {rest}"), (4, f"{y} {rest}"), (5, " ".join(x)), (6, " ".join(y))]
    assert {r.doc_id: r.component_id for r in ngram_join.link_classes(table(spark, rows[:2])).collect()} == {1: 1, 2: 2}
    kept = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(table(spark, rows[2:4])).collect()}
    assert kept == {3: 0, 4: 0}
    words = [t.split() for _, t in rows[4:]]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for r in substring_dedup.remove_repeats(table(spark, rows[4:])).collect():
        w = words[r.doc_id - 5]
        hit = {p for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        assert r.n_removed == len(hit)


def test_buckets_in_blocks(spark, monkeypatch):
    """A bucket of near copies that is dealt out in small blocks gives the same classes."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    test_large_groups_of_copies(spark)
    test_link_classes(spark, 2)


def test_link_classes_of_nothing(spark):
    assert ngram_join.link_classes(table(spark, [])).count() == 0
    assert [r.component_id for r in ngram_join.link_classes(table(spark, [(3, None)])).collect()] == [3]


def test_large_groups_of_copies(spark):
    random.seed(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(i % 9):
            words[random.randrange(200)] = f"x{random.random()}"
        rows.append((i, " ".join(words if i % 3 else base)))
    got = {r.doc_id: r.component_id for r in ngram_join.link_classes(table(spark, rows)).collect()}
    s = [sets(t) for _, t in rows]
    for i in range(300):
        assert (got[i] == 0) == (got[0] == got[i])
        if 100 * len(s[i] & s[0]) >= 75 * len(s[i] | s[0]):
            assert got[i] == 0


@pytest.mark.parametrize("window", [35, 12])
def test_remove_repeats(spark, window):
    rows = corpus(3)
    got = Counter(
        (
            r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").encode().decode().split())
        ) for r in substring_dedup.remove_repeats(table(spark, rows), window).collect()
    )
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    want = Counter()
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        want[d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    assert got == want
    assert substring_dedup.remove_repeats(table(spark, []), window).count() == 0


def test_overlapping_repeats_of_one_text(spark):
    got = substring_dedup.remove_repeats(table(spark, [(1, "a " * 36), (2, "a " * 20)])).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == {1: (36, 36, ""), 2: (20, 0, "a " * 20)}


@pytest.mark.parametrize("block", [16 << 20, 400])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows = corpus(5)
    items = [
        (i, " ".join(t.split()[k : k + n])) for i, (_, t) in enumerate(rows[:20]) for k, n in [(2, 14 + i % 9)]
    ] + [(50, "one"), (51, "A, b; C d!"), (52, ""), (53, None), (None, "a b"), (7, rows[9][1][:120])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(
        (r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.contamination(table(spark, rows), bench).collect()
    )
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(len(w) - min(10, len(w)) + 1):
            if w:
                windows[tuple(w[a : a + min(10, len(w))])] |= set() if i is None else {i}
    want = Counter()
    for d, t in rows:
        w = split(t)
        hit, found = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    found |= windows[tuple(w[a : a + k])]
                    hit[a : a + k] = [True] * k
        want[d, len(w), sum(hit), ",".join(sorted(map(str, found)))] += 1
    assert got == want


def test_items_named_by_strings(spark):
    words = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([("b-10", " ".join(words[3:20])), ("b-9", "w1 w2"), ("a", "w1 w2")], "item_id string, text string")
    rows = decontaminate.contamination(table(spark, [(1, " ".join(words)), (2, "w2 w1")]), bench).collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in rows} == {1: (19, ["a", "b-10", "b-9"]), 2: (0, [])}


def test_contamination_without_benchmark(spark):
    rows = decontaminate.contamination(table(spark, corpus(5)), spark.createDataFrame([], "item_id long, text string"))
    assert rows.where("n_hit > 0").count() == 0 and rows.count() == 72
    assert hashlib.sha256(b"").hexdigest()[:8] == "e3b0c442"


def test_packed_records_come_back():
    import numpy as np

    from skylog.llm.exchange import Packer, unpack

    rng, kinds = np.random.default_rng(3), ("u8", "i8", "u4", "u1", "u2")
    columns = [rng.integers(0, 200, 500).astype(k) for k in kinds]
    columns[1] = rng.integers(-(1 << 62), 1 << 62, 500)
    part = rng.integers(0, 7, 500)
    packer = Packer(9, *kinds)
    rows = [
        r for b in [*packer.add(part, *columns), *packer.flush()] for r in zip(
            b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True
        )
    ]
    assert sorted(p for p, _ in rows) == sorted(set(part.tolist()))
    for p, data in rows:
        for got, column in zip(unpack(data, kinds), columns, strict=True):
            assert got.tolist() == column[part == p].tolist()


@pytest.mark.parametrize("bytes_", [1 << 20, 150])
def test_items_without_an_id_hit_all_the_same(spark, monkeypatch, bytes_):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", bytes_)
    words = [f"w{i}" for i in range(40)]
    items = [(None, " ".join(words[:12])), ("a", " ".join(words[20:32])), (None, " ".join(words[20:31])), (None, None), ("b", "")]
    docs = table(spark, [(1, "x " + " ".join(words[:11]) + " y"), (2, " ".join(words)), (3, "nothing here")])
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string"))
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in found.select("doc_id", "n_hit", "items").collect()}
    assert got == {1: (11, []), 2: (24, ["a"]), 3: (0, [])}


def test_made_clashes_of_words_link_nothing(spark):
    """Two words that hash alike under the standing key, found from its constants: their documents aren't linked."""
    clash = ["abcdefghijklmnop", "gamktdpszu)e`%]s"]
    hashes = [split_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), LOWER).hash[0] for w in clash]
    assert hashes[0] == hashes[1]
    rows = [(i, f"{w} b c d") for i, w in enumerate(clash)]
    assert {r.doc_id: r.component_id for r in ngram_join.link_classes(table(spark, rows)).collect()} == {0: 0, 1: 1}


def test_signatures_of_a_set_lie_together():
    """A set's signatures go to few partitions, all of which are used evenly, and its repeated name costs next to nothing there."""
    import pyarrow as pa

    from skylog.llm.exchange import Packer
    from skylog.llm.ngram_join import _SIGNED, Sets, _dealt

    scheme, parts, rng = PartEnum(75), 48, np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(10, 30, 3000), rng.integers(100, 300, 1500)])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    elements = rng.integers(0, 1 << 63, cuts[-1], dtype=np.uint64) << np.uint64(1)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        elements[a:b].sort()
    sets = Sets(elements, cuts)
    names = sets.names().view(np.uint64)
    bands, counts = np.unique([scheme.band(int(n)) for n in sizes], return_counts=True)
    bounds = scheme.bounds(dict(zip(bands.tolist(), counts.tolist(), strict=True)))
    packer, data, records, filled = Packer(parts, *_SIGNED), 0, 0, np.zeros(parts, int)
    for band, of, signs, left in scheme.signed_sets(sets):
        part = _dealt(signs, band, bounds, parts)
        filled += np.bincount(part, minlength=parts)
        records += len(signs)
        assert list(packer.add(part, signs & np.uint64(0xFFFFFFFF), (signs >> np.uint64(32)) & np.uint64(0xFF), names[of], np.full(len(signs), band), left)) == []
    for batch in packer.flush():
        data += sum(len(pa.compress(x.as_buffer(), "lz4_raw")) for x in batch.column(1))
    assert filled.min() > 0 and filled.max() < 3 * filled.mean()
    # 5 bytes are the signature's own; with partitions by hash alone a record took 13
    assert data < 9 * records
