"""The operators that work on single texts, and packing, scoring and the pipeline."""

import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylog.llm import fingerprints, html_text, lm_score, packing, token_counts, tokens, toxicity, url_lists
from skylog.llm.queries import QUERIES, SQL
from skylog.llm.words import ALNUM, split_words

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import assert_same, database

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "  \n"), (4, "One two. Two!"), (4, "One two. Two!"), (None, "no id"), (5, "é" * 3000 + " end"),
    (6, "w " * 40_000), (7, "stop <|endoftext|> here")
]


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, "k", "s", "x") for i, t in rows], "doc_id long, text string, key string, salt string, score string"
    )


def test_encoder_is_the_tokenizer(spark):
    path = tokens.default_path()
    full, fast = Tokenizer.from_file(path), tokens.encoder(path)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect() + [(t or "",) for _, t in ODD] + [("it's  a\ttest\n\n 12 €uro \x1c x",)]:
        assert fast(r[0]) == full.encode(r[0], add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [10, 64, 2048])
def test_plan_places_every_piece_once(capacity):
    random.seed(capacity)
    for _ in range(60):
        lengths = [
            random.choice(
                [random.randint(1, capacity), max(1, capacity // 3 + random.randint(-1, 1)), capacity]
            ) for _ in range(random.randint(0, 300))
        ]
        counts = Counter(lengths)
        ranks, sequences = defaultdict(list), defaultdict(list)
        for length, first, n, sequence, each, offset in packing.plan(dict(counts), capacity):
            for j in range(n):
                ranks[length].append(first + j)
                sequences[sequence + j // each].append((offset + j % each * length, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in pieces) <= 2
        assert len(sequences) <= -(-sum(lengths) // capacity) * 1.25 + 1 or any(2 * n > capacity for n in lengths)


def test_partners_are_chosen_by_the_gaps_that_shorter_pieces_fill():
    counts = dict.fromkeys((650, 660, 683, 684, 690, 700), 3333)
    runs = packing.plan(counts, 2048)
    sequences = {s + j for _, _, n, s, each, _ in runs for j in range(-(-n // each))}
    assert len(sequences) <= 6667 < packing._planned(counts, 2048, False)[1]


def test_pack(spark):
    rows = ODD + [(10 + i, "some words here " * (i * 7)) for i in range(40)]
    out = packing.pack(table(spark, rows), 256).collect()
    full = Tokenizer.from_file(tokens.default_path())
    want = Counter()
    for d, t in rows:
        ids, at = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for k in range(-(-len(ids) // 256)):
            n = (len(ids) - at) % 256 or 256
            want[d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == [0, *np.cumsum([n for _, n in sorted(pieces)])[:-1]]
        assert sum(n for _, n in pieces) <= 256
    assert packing.pack(table(spark, []), 256).count() == 0


def test_edits_count_as_encoding_anew(spark, monkeypatch):
    encode = tokens.encoder(tokens.default_path())
    random.seed(2)
    pool = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(40).collect()]
    for leaf in (8, 512):
        monkeypatch.setattr(token_counts, "LEAF", leaf)
        for k in range(60):
            text = random.choice(pool)[: random.choice([0, 5, 900, 3000])] if k % 3 else "".join(
                random.choice("ab '  \n\t1!sé") for _ in range(random.randint(0, 200))
            )
            tree = token_counts.CountTree(text, encode)
            for _ in range(4):
                a = random.randint(0, len(text) + 2)
                b, new = a + random.choice([0, 1, 20, 200]), random.choice(["", " ", "x", "'s", " foo\n\n bar", random.choice(pool)[:80]])
                tree.replace(a, b, new)
                text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
                assert tree.text == text and tree.count == len(encode(text))


def test_count_edited(spark):
    edits = spark.createDataFrame(
        [(4, 1, 0, 3, "Three"), (4, 2, 5, 5, " x"), (6, 1, 100, 120, None), (99, 1, 0, 0, "y"), (None, 1, 0, 0, "z"), (2, 1, 9, 12, "new")],
        "doc_id long, n int, start long, end long, new_text string"
    )
    got = Counter(
        (r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in token_counts.count_edited(table(spark, ODD), edits).collect()
    )
    n = lambda t: len(tokens.encoder(tokens.default_path())(t))
    after = {4: "Three x two. Two!", 2: "new", 6: ("w " * 40_000)[:100] + ("w " * 40_000)[120:]}
    assert got == Counter((d, n(t or ""), n(after.get(d, t or "")), len(after.get(d, t or ""))) for d, t in ODD)
    long = token_counts.count_edited(table(spark, [(6, "some words " * 9000)]), edits).first()
    assert long.n_encoded < 3000


def test_written_trees_are_edited_by_a_later_job(spark, tmp_path):
    rows = [*ODD, (8, "some words and more " * 2000)]
    token_counts.build_trees(table(spark, rows)).write.parquet(str(tmp_path / "trees"))
    texts = {d: t or "" for d, t in rows}
    for job, edits in enumerate(
        (
            [(8, 1, 100, 105, "other"), (8, 2, 20_000, 20_000, " new text" * 500), (4, 1, 0, 3, "Three")],
            [(8, 1, 21_000, 21_010, ""), (1, 1, 0, 0, "no longer empty")]
        )
    ):
        frame = spark.createDataFrame(edits, "doc_id long, n int, start long, end long, new_text string")
        before = {d: t for d, t in texts.items()}
        for d, _, a, b, new in edits:
            texts[d] = texts[d][:a] + new + texts[d][b:]
        source = str(tmp_path / "trees") if not job else str(tmp_path / "edited")
        done = token_counts.edit_trees(spark.read.parquet(source).select("key", "salt", "leaves", "tokens", "chars"), frame)
        done.write.parquet(str(tmp_path / ("edited" if not job else "again")))
        encode = tokens.encoder(tokens.default_path())
        for r in done.collect():
            d = r.key if r.key != -(1 << 63) else None
            assert "".join(r.leaves) == texts[d] and r.n_chars == len(texts[d])
            assert (r.n_tokens_before, r.n_tokens) == (len(encode(before[d])), len(encode(texts[d])))
            assert r.n_encoded == 0 if texts[d] == before[d] else 0 < r.n_encoded < 8000
            assert all(len(x) < 3 * token_counts.LEAF for x in r.leaves) or d in (5, 6)
    assert token_counts.build_trees(table(spark, [])).count() == 0


def test_other_tokenizer_files(spark, tmp_path):
    """A file with another splitter or normaliser goes to the library itself."""
    import json

    path = tokens.default_path()
    other = str(Path(path).parent / "word_bpe_49k.json")
    assert tokens.encoder(path).parts_at_spaces and not tokens.encoder(other).parts_at_spaces
    spec = json.load(open(path))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "changed.json").write_text(json.dumps(spec))
    for file in (other, str(tmp_path / "changed.json")):
        full = Tokenizer.from_file(file)
        want = Counter((d, len(full.encode(t or "", add_special_tokens=False).ids)) for d, t in ODD[:6])
        assert Counter(
            (r.doc_id, r.n_tokens) for r in token_counts.count_edited(
                table(spark, ODD[:6]), spark.createDataFrame([], "doc_id long, n int, start long, end long, new_text string"),
                file
            ).collect()
        ) == want


def test_fingerprints_estimate_weighted_likeness():
    random.seed(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(random.choices(words, weights=range(60, 0, -1), k=random.randint(20, 300))) for _ in range(40)]
    prints = fingerprints.fingerprints([t.encode() for t in texts], 512)
    errors = []
    for i in range(40):
        for j in range(i):
            a, b = Counter(texts[i].split()), Counter(texts[j].split())
            errors.append(fingerprints.likeness(prints[i], prints[j]) - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.12
    alone = fingerprints.fingerprints([texts[0].encode(), b"", b" ."], 512)
    assert (alone[0] == prints[0]).all() and not alone[1:].any()


def test_fingerprints_of_large_counts():
    for n in (60_000, 70_000):
        a, b, c = fingerprints.fingerprints([b"a " * n, b"a " * 2 * n, b"a " * n], 512)
        assert abs(fingerprints.likeness(a, b) - 0.5) < 0.1
        assert fingerprints.likeness(a, c) == 1


def test_compare_with_next(spark):
    rows = ODD + [(100 + i, f"text number {i} with some words " * (i % 5 + 1)) for i in range(30)]
    got = sorted(
        (
            (
                r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256
            ) for r in fingerprints.compare_with_next(table(spark, rows)).collect()
        )
    )
    import hashlib

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((d is not None, d or 0, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert got == sorted(want)
    assert fingerprints.compare_with_next(table(spark, [])).count() == 0
    one = fingerprints.compare_with_next(table(spark, [(1, "a b c")])).first()
    assert one.near_next == 1.0


PAGE = "<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class=\"ad\">Buy now</div><article><h1>Head &eacute;</h1><p>First  one<br>and <b>two<p>Second.</p>{extra}</article><footer>&copy; foot words go here</footer></body></html>"


def test_main_text(spark):
    train = [PAGE.format(extra=f"<p>{'words ' * n}</p>") for n in range(3, 40)]
    weights = html_text.learn(train)
    assert html_text.main_text(PAGE.format(extra=""), weights) == "Head é\nFirst one and two\nSecond."
    assert html_text.main_text(
        PAGE.format(
            extra="<aside>no</aside><p>yes yes yes yes yes yes yes yes</p><div class='comments'><p>no</p></div><form>no</form><!-- no -->"
        ),
        weights
    ) == "Head é\nFirst one and two\nSecond.\nyes yes yes yes yes yes yes yes"
    for page in ("", "plain words", "<article>", "</p></nav>", "<script>never closed", "<p " * 2000, "a < b > c &bogus; &#0; " * 100):
        html_text.main_text(page, weights)
    pages = spark.createDataFrame(
        [(1, "u", None, "t"), (1, None, "", "t"), (None, "u", PAGE.format(extra=""), "t")],
        "page_id long, url string, html string, text string"
    )
    got = html_text.extract(pages, html_text.fit(pages)).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 3
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


def test_region():
    assert html_text.region([1, -5, 2, 3, -1, 2, -9, 4]) == (2, 6)
    assert html_text.region([-1, -2]) == (0, 0) and html_text.region([]) == (0, 0)
    random.seed(12)
    for _ in range(300):
        scores = [random.randint(-4, 4) for _ in range(random.randint(0, 25))]
        every = [(sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max(every, default=(0, 0, 0))
        a, b = html_text.region(scores)
        assert sum(scores[a:b]) == max(0, best[0])


def test_tags_as_browsers_read_them():
    weights = html_text.Weights({}, {}, (-0.01, 1.0))
    texts = {
        "<p title=it's>I don't know</p>": "I don't know", "<p a='x>y' b=\"1>2\" c = z>text</p>": "text", "one <a href=x>two</a <b>three": "one twothree", "a <b title=\"open>lost": "a",
        "<div id='nav-bar'>no</div><p>yes more words here</p>": "yes more words here", "<header>Site name</header><article><header><h1>Title</h1></header><p>All the words</p></article>": "Title\nAll the words",
        "<div class='page with-sidebar'><p>most of the words</p></div>": "most of the words", "x<!-- a -- > b -->y": "xy", "<svg><title>t</title></svg>word": "word", "1 < 2 & 3 &gt; 2": "1 < 2 & 3 > 2", "a</ >b<!x>c<?y?>d": "abcd",
    }
    for page, text in texts.items():
        assert html_text.main_text(page, weights) == text, page


def article(inside):
    return f"<nav><a href=x>menu words</a></nav><article><h1>A head of words</h1><p>Some words before it all.</p>{inside}<p>{'Words that come after. ' * 8}</p></article><footer>foot words</footer>"


@pytest.mark.parametrize("element", [
    "<svg class=i />", "<svg class=i/>", "<math/>", "<object data=x>", "<form><select><option>a</form>", "<select>", "<svg><path/><title>no</title></svg>",
    "<svg><text>no</text></svg>", "<object><p>no</p></object>", "<select><option>no</select>", "<math><mi>no</mi></math>", "<form><select><option>no</select></form>",
])
def test_no_element_takes_the_text_after_it(element):
    import re

    weights = html_text.learn([PAGE.format(extra=f"<p>{'words ' * n}</p>") for n in range(3, 40)])
    plain = html_text.main_text(article(""), weights)
    got = html_text.main_text(article(element), weights)
    # an element that nothing closes is no element to leave out
    assert re.sub(r"\na$", "", got.replace("\na\n", "\n")) == plain
    assert plain.startswith("A head of words\nSome words") and plain.count("Words that come after.") == 8


@pytest.mark.parametrize("word", sorted(html_text.OTHER_CLASSES | html_text.HEADERS))
def test_a_word_of_a_class_drops_nothing_of_an_article(word):
    weights = html_text.learn([PAGE.format(extra=f"<p>{'words ' * n}</p>") for n in range(3, 40)])
    kept = "<ul class='{0}-issues'><li>a list item</li></ul><section id=the-{0}><p>a section</p></section><p class='x {0}_description'>a part</p>"
    text = html_text.main_text(article(kept.format(word)), weights)
    assert "\na list item\na section\na part\n" in text
    if word in html_text.OTHER_CLASSES:
        assert html_text.main_text(article(f"<div class='box {word}'><p>no text of it</p></div>"), weights) == html_text.main_text(article(""), weights)


@pytest.mark.parametrize(
    "part",
    [
        "<a ", "<a b='", "<!", "</", "<script>", "<nav>", "<div class=ad>", "</section>", "<div></section>", "<svg ", "&amp",
        "<a =", "<!--", "<p>x"
    ]
)
def test_pages_are_read_in_one_pass(part):
    import time

    began = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)), html_text.Weights({}, {}))
    assert time.process_time() - began < 4


def test_main_text_of_pages(spark):
    import re

    rows = {r.page_id: r for r in QUERIES["op2_html_text"](spark, DATA).collect()}
    for page in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        import html

        inner = re.search("<article>(.*)</article>", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert rows[page.page_id].text == "\n".join(b for b in blocks if b)


def test_url_lists(spark):
    day = lambda n: f"2024-01-{n:02d}"
    entries = spark.createDataFrame(
        [
            ("spam", "Bad.example.com", "add", day(5)), ("spam", "bad.example.com", "remove", day(10)),
            ("spam", "bad.example.com", "add", day(7)), ("spam", "example.org/x", "add", day(1)),
            ("allow", "example.com", "add", day(8)), ("spam", "gone.net", "remove", day(3)), ("spam", None, "add", day(1)),
            ("spam", "same.net", "add", day(2)), ("spam", "same.net", "remove", day(2))
        ],
        "list_name string, pattern string, action string, effective string"
    )
    captures = [
        (1, "http://bad.example.com/a", day(4)), (2, "https://www.bad.example.com:80/", day(5)),
        (3, "http://u@bad.example.com?q", day(9)), (4, "http://bad.example.com", day(10)),
        (5, "http://example.org/X/y", day(20)), (6, "http://example.org/xy", day(20)), (7, None, day(5)),
        (8, "not a url", day(5)), (9, "http://example.org/x", None), (2, "https://www.bad.example.com:80/", day(5)),
        (10, "http://same.net/", day(2))
    ]
    got = Counter(
        (r.capture_id, r.n_active, tuple(r.lists), r.blocked) for r in url_lists.judge(
            spark.createDataFrame(captures, "capture_id long, url string, fetched string"), entries
        ).collect()
    )
    none = (0, (), False)
    want = {
        1: none, 2: (1, ("spam",), True), 3: (2, ("allow", "spam"), False), 4: (1, ("allow",), False), 5: (1, ("spam",), True),
        6: none, 7: none, 8: none, 9: none, 10: none
    }
    assert got == Counter((i, *want[i]) for i, _, _ in captures)
    assert_same(QUERIES["op3_url_lists"](spark, DATA), database(DATA), SQL["op3_url_lists"])
    assert url_lists.judge(spark.createDataFrame([], "capture_id long, url string, fetched string"), entries).count() == 0


def test_very_long_urls(spark):
    import time

    entries = spark.createDataFrame([
        ("spam", "long.org/a/a", "add", "2024-01-01"), ("spam", "b.c", "add", "2024-01-01"), ("other", "x.b.c", "add", "2024-01-01"),
        ("spam", "long.org/a/a/b", "add", "2024-01-01"),
    ], "list_name string, pattern string, action string, effective string")
    urls = ["http://long.org" + "/a" * 500_000, "http://" + "a." * 500_000 + "x.b.c/", "http://long.org/" + "/" * 1_000_000 + "a//a/b", "http://long.org/" + "a" * 1_000_000]
    captures = spark.createDataFrame([(i, u, "2024-02-01") for i, u in enumerate(urls)], "capture_id long, url string, fetched string")
    url_lists.judge(captures.limit(0), entries).count()
    began = time.time()
    got = {r.capture_id: (r.n_active, r.lists) for r in url_lists.judge(captures, entries).collect()}
    assert got == {0: (1, ["spam"]), 1: (2, ["other", "spam"]), 2: (2, ["spam"]), 3: (0, [])}
    assert time.time() - began < 15


def toxic_table(spark, n=400):
    random.seed(9)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        sentences = [[random.choice(vocabulary) for _ in range(8)] for _ in range(random.randint(1, 12))]
        bad = random.random() < 0.3
        if bad:
            random.choice(sentences)[3] = random.choice(["vile", "Nasty"])
        rows.append((i, " ".join(" ".join(s) + random.choice([".", "!", "?\n"]) for s in sentences)))
        labels.append((i, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_locates(spark):
    rows, labels = toxic_table(spark)
    model = toxicity.fit(table(spark, rows), labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = {r.doc_id: r for r in toxicity.score(table(spark, rows), model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert np.mean([(scored[d].score >= 0.5) == bool(t) for d, t in truth.items()]) > 0.95
    for d, text in rows:
        for span in scored[d].offending:
            assert any(w in text.encode()[span.start : span.end].decode() for w in ("vile", "Nasty"))
    assert sum(len(r.offending) for r in scored.values()) > 90


def test_toxicity_is_the_noisy_or_of_sentences(spark):
    import re

    rows, labels = toxic_table(spark)
    rows += [r for r in ODD if r[0] != 6] + [(900, "Vile. NASTY!\nword1 word2? ... vile\u00e9 x")]
    model = toxicity.fit(table(spark, rows), labels)
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def weight(w):
        h = split_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), ALNUM).hash[0]
        at = np.flatnonzero(model.words == h)
        return float(model.weights[at[0]]) if len(at) else 0.0

    want = {}
    for d, t in rows:
        clean = 1.0
        parts = [word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), s)) for s in re.split(rb"[.!?\n]", (t or "").encode())]
        for p in [p for p in parts if p] or [[]]:
            clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(map(weight, p)))))
        want[d, t] = 1 - clean
    got = {(r.row.doc_id, r.row.text): r.score for r in toxicity.score_rows(table(spark, rows), model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_one_huge_text_keeps_no_other_out_of_the_sample(spark):
    docs = table(spark, [(0, "huge " * 40_000), *((i, f"text number {i}") for i in range(1, 60)), (None, "no id")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity._sample(docs, labels, 100, 64_000).collect()
    assert len(got) == 59 and max(len(r.text) for r in got) < 20
    assert toxicity._sample(docs, labels, 10, 64_000).count() == 10
    assert docs.select(toxicity.held_out(docs.doc_id).alias("h")).where("h is null").count() == 0


def test_toxicity_of_unknown_words(spark):
    """A word that training has not seen weighs nothing, however near its hash is to that of an insult."""
    rows, labels = toxic_table(spark)
    model = toxicity.fit(table(spark, rows), labels)
    data = " ".join(["vile", "nasty", *(f"q{i}" for i in range(400_000))]).encode()
    words = split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM)
    near = np.flatnonzero(np.isin(words.hash[2:] >> np.uint64(46), words.hash[:2] >> np.uint64(46)))
    assert len(near)
    texts = ["unheard", *(f"q{i}" for i in near)]
    scores = {r.doc_id: r.score for r in toxicity.score(table(spark, list(enumerate(texts))), model).collect()}
    assert set(scores.values()) == {scores[0]} and scores[0] < 0.5


def test_toxicity_of_odd_rows(spark):
    for labels in ([], [(4, 1)], [(None, 1), (4, None)]):
        model = toxicity.fit(table(spark, ODD), spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(table(spark, ODD), model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(table(spark, []), model).count() == 0


def brute_losses(counted, scored, target, within, weight=0.6, prior=20.0):
    """Mean losses of each scored row under target and background, from plain counts of the counted rows."""
    split = lambda t: ["", *(t or "").encode().lower().split()]
    kinds = {w for _, t in counted for w in split(t)[1:]}
    out = []
    for d, t in scored:
        words, counts = split(t), []
        for kept in (lambda i: i in target, lambda i: i not in target):
            c, pairs = Counter(), Counter()
            for x in (split(x) for i, x in counted if kept(i)):
                c.update(x if len(x) > 1 else [])
                pairs.update(zip(x, x[1:]))
            if within and kept(d) and len(words) > 1:
                c.subtract(words)
                pairs.subtract(zip(words, words[1:]))
            counts.append((c, pairs, sum(k for w, k in c.items() if w)))
        every, every_pairs, n = counts[0][0] + counts[1][0], counts[0][1] + counts[1][1], counts[0][2] + counts[1][2]
        losses = []
        for (c, pairs, size), (_, _, other) in (counts, counts[::-1]):
            scale, total = min(1, other / size) if size else 0, 0.0
            for v, w in zip(words, words[1:]):
                single = (every[w] + 1) / (n + len(kinds) + 1)
                shared = (every_pairs[v, w] + prior * single) / (every[v] + prior)
                seen = c[w] / size if scale else single
                total -= np.log(weight * (scale * pairs[v, w] + prior * shared) / (scale * c[v] + prior) + (1 - weight) * (single + seen) / 2)
            losses.append(total / (len(words) - 1) if len(words) > 1 else None)
        out.append((d, len(words) - 1, *losses))
    return out


def rounded(rows):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def test_lm_losses_are_those_of_plain_counts(spark):
    random.seed(8)
    docs = [
        (r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    ]
    odd = [(i, "w x " * 300 if i == 6 else t) for i, t in ODD]
    rows, target = docs + odd + [(5000, docs[3][1]), (5001, "Start only")], {d for d, _ in docs[::3]} | {4, 5000}
    ids = spark.createDataFrame([(i,) for i in target] + [(None,)], "doc_id long")
    columns = ("doc_id", "n_tokens", "loss_target", "loss_background")
    got = lm_score.score_within(table(spark, rows), ids)
    assert rounded(got.select(*columns).collect()) == rounded(brute_losses(rows, rows, target, True))
    assert got.where(
        "n_tokens > 0 and abs(loss_background - loss_target - score) > 1e-9 or n_tokens = 0 and score is not null"
    ).count() == 0
    models = lm_score.fit(table(spark, rows[:30]), ids)
    assert rounded(
        lm_score.score(table(spark, rows), models).select(*columns).collect()
    ) == rounded(brute_losses(rows[:30], rows, target, False))


def test_lm_scores_of_nothing(spark):
    target = spark.createDataFrame([(1,)], "doc_id long")
    empty = lm_score.fit(table(spark, []), target)
    got = lm_score.score(table(spark, ODD), empty).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) if r.n_tokens else r.score is None for r in got)
    assert lm_score.score_within(table(spark, []), target).count() == 0
    assert lm_score.score(table(spark, []), lm_score.fit(table(spark, ODD), target)).count() == 0


def test_lm_scores_tell_the_target(spark):
    random.seed(8)
    good = [f"alpha beta g{i % 7} delta" for i in range(30)]
    bad = [f"zeta eta b{i % 7} iota" for i in range(30)]
    rows = [(i, " ".join(random.choices(good if i % 2 else bad, k=20))) for i in range(200)]
    target = spark.createDataFrame([(i,) for i in range(1, 120, 2)], "doc_id long")
    scores = {r.doc_id: r.score for r in lm_score.score_within(table(spark, rows), target).collect()}
    assert min(scores[i] for i in range(1, 200, 2)) > max(scores[i] for i in range(0, 200, 2))


def test_lm_scores_are_centred_between_matched_models(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    quality = {r.doc_id: r.quality for r in read("labels").collect()}
    scores = lm_score.score_within(read("documents"), read("labels").where("quality = 1")).where("score is not null").collect()
    mean = {q: np.mean([r.score for r in scores if quality.get(r.doc_id) == q]) for q in (0, 1)}
    assert mean[1] > 0 > mean[0]


def test_lm_many_equal_rows_are_one_in_a_group(spark):
    rows = [(None, "many equal rows here")] * 9000 + [(1, "equal rows there"), (2, "other words")]
    documents = table(spark, rows).repartition(3)
    _, groups, _ = lm_score._grouped(documents, None)
    assert sorted((r.key, r.times) for r in groups.collect() if r.key > 0) == [(1, 1), (2, 1)]
    assert [r.times for r in groups.where("key < 0").collect()] == [9000]
    got = lm_score.score_within(documents, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert Counter(r.doc_id for r in got) == {None: 9000, 1: 1, 2: 1} and len({r.score for r in got if r.doc_id is None}) == 1
    want = brute_losses(rows, [rows[0], *rows[-2:]], {1}, True)
    assert set(rounded((r.doc_id, r.n_tokens, r.loss_target, r.loss_background) for r in got)) == set(rounded(want))


@pytest.mark.parametrize("parts", [4, 16, 64])
def test_lm_rows_are_sent_only_where_names_are(parts):
    names = np.sort(np.random.default_rng(parts).integers(0, 1 << 63, 8).astype(np.uint64) * np.uint64(2))
    sent = lm_score._rows(parts, 5, names, names, names)
    assert 0 < sent.num_rows <= min(parts, len(names)) and lm_score._rows(parts, 5, names[:0]).num_rows == 0
    back = np.concatenate([lm_score._unpacked_names(x.as_buffer(), True)[0] for x in sent.column("data")])
    assert (back == names).all()


def test_near_copies_keep_every_row_without_words(spark):
    import corpus_pipeline as cp

    odd = [
        (None, None, "en"), (None, None, "de"), (None, "", "en"), (None, "", "en"), (None, " \n\x0b", "fr"), (7, None, "en"),
        (7, None, "de")
    ]
    rows = odd + [(1, "é", "en"), (1, "é", "de"), (2, "\x1cx", "en"), (3, "É", "en"), (4, "É", "en")]
    docs = spark.createDataFrame(
        [(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = Counter((r.doc_id, r.text, r.lang) for r in cp.without_near_copies(spark, docs, DATA).collect())
    assert {k: n for k, n in got.items() if not (k[1] or "").strip(" \n\x0b")} == Counter(odd)
    assert sorted(k[0] for k in got if (k[1] or "").strip(" \n\x0b")) == [1, 2, 3]


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = docs
    for name, stage in cp.STAGES[:-1]:
        before, out = out, stage(spark, out, DATA).cache()
        assert out.dtypes == docs.dtypes, name
        assert out.count() <= before.count()
        if name == "substring_dedup":
            assert out.count() == before.count()
    assert 0.6 * docs.count() < out.count() < docs.count()
    packed = cp.STAGES[-1][1](spark, out, DATA)
    assert packed.select("doc_id").distinct().count() == out.count()
    odd = table(spark, ODD).selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "cast(1 as long) as n_chars", "key", "salt", "'r' as row",
        "array(1) as best"
    )
    kinds = odd.dtypes
    for _, stage in cp.STAGES[:-1]:
        odd = stage(spark, odd, DATA)
        assert odd.dtypes == kinds
    assert Counter((r.doc_id, r.text) for r in odd.collect()) == Counter({(d, "" if d == 6 else t): 1 for d, t in ODD})


def test_near_copies_of_null_and_clashing_ids(spark):
    """Rows are told apart by their texts: unrelated documents without an id, or with one id, all stay."""
    import corpus_pipeline as cp

    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, words(1)), (None, words(2)), (None, words(3)), (7, words(4)), (7, words(5)), (8, words(6))]
    more = [(9, words(6) + " end"), (None, words(4).upper()), (3, words(4)), (7, words(4))]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    assert Counter((r.doc_id, r.text) for r in cp.without_near_copies(spark, docs, DATA).collect()) == Counter(rows)
    docs = docs.union(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], docs.schema))
    want = rows[:3] + [(None, words(4).upper()), (7, words(5)), (8, words(6))]
    assert Counter((r.doc_id, r.text) for r in cp.without_near_copies(spark, docs, DATA).collect()) == Counter(want)


def brute_pipeline(rows, scores, bench):
    """The rows that the first four stages keep, by comparing all with all."""
    import re

    rows = [r for r in rows if scores[r] < 0.5]
    split = lambda t: (t or "").encode().split()
    sets = []
    for _, t in rows:
        w = [bytes(x).lower() for x in split(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i) if sets[i] else ("empty", i)].append(r)
    rows = [min(g) for g in groups.values()]
    count = Counter(tuple(w[i : i + 35]) for w in map(split, (t for _, t in rows)) for i in range(len(w) - 34))
    out = []
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((d, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    items = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    parts = lambda t: items.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = {tuple(w[i : i + 10]) for w in map(parts, bench) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in windows}
    return [
        (d, t) for d,
        t in out if not any(tuple(w[i : i + n]) in windows for w in [parts(t)] for n in sizes for i in range(len(w) - n + 1))
    ]


def test_pipeline_is_that_of_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet").where(~toxicity.held_out(F.col("doc_id"))))
    scores = {(r.doc_id, r.text): r.score for r in toxicity.score_rows(docs, model).select("row.doc_id", "row.text", "score").collect()}
    want = brute_pipeline(list(scores), scores, [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    out = docs
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, DATA)
    assert Counter((r.doc_id, " ".join(x.decode() for x in r.text.encode().split())) for r in out.collect()) == Counter(want)
