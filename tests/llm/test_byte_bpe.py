"""Byte-level BPE against the tiktoken library, round trips, offsets, and every odd row."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skylog.llm import byte_bpe
from skylog.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_path()), special_tokens={}
    )


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.default_path(), byte_bpe.default_pattern())


def odd_texts():
    random.seed(7)
    letters = [" ", "=", "-", "a", "ab", "=- ", "\n ", ".", "0", "é", "é", "的一", "😀", "'s t", "aA ", "()", "\t\n ", "ло", " x", "\x00\x1f"]
    texts = ["".join(random.choice(a) for _ in range(random.randint(1, 80))) for a in letters for _ in range(60)]
    return texts + ["", "<|endoftext|>", "👩‍👩‍👧 naïve ok", "x" * 5000, "ab " * 3000, "�\U0010ffff"]


def test_ids_are_those_of_tiktoken(bpe, plain):
    texts = odd_texts()
    ids, first = bpe.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [plain.encode_ordinary(t) for t in texts]
    data, where = bpe.decode(ids, first)
    assert [data[a:b].tobytes().decode() for a, b in zip(where[:-1], where[1:], strict=True)] == texts


def test_remembers_within_bounds(plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 7)
    monkeypatch.setattr(byte_bpe, "ENCODED_BYTES", 200)
    small = byte_bpe.ByteBpe(byte_bpe.default_path(), byte_bpe.default_pattern())
    for t in odd_texts()[::9]:
        ids, _ = small.encode([t])
        assert ids.tolist() == plain.encode_ordinary(t)
        assert len(small._place) <= max(50, len(t))


def test_offsets_of_split_characters(bpe):
    text = "a😀é的 b"
    ids, first = bpe.encode([text])
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = bpe.offsets(ids, first, data, np.array([0, len(data)]))
    at = 0
    for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        token = data[at : at + bpe.length[i]].tobytes()
        before, until = text.encode()[:at].decode(errors="ignore"), text.encode()[: at + len(token)]
        assert a == len(before)
        assert b == len(until.decode(errors="ignore")) + (until.decode(errors="ignore").encode() != until)
        at += len(token)
    assert ends[-1] == len(text)


def test_wrong_ids_and_files(bpe, tmp_path):
    for wrong in (-1, bpe.size):
        with pytest.raises(ValueError, match="is no token"):
            bpe.decode(np.array([0, wrong]), np.array([0, 2]))
    (tmp_path / "short.tiktoken").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.read_ranks(str(tmp_path / "short.tiktoken"))


def test_odd_rows(spark, plain):
    rows = [(1, None, "x"), (None, "no id", "x"), (2, "", "x"), (2, "é" * 40_000, "x"), (3, "same", "x"), (3, "same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(((i, plain.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    assert sorted(bytes(r.bytes) for r in got) == sorted((t or "").encode() for _, t, _ in rows)
    assert all(list(r.starts) == sorted(r.starts) and (r.ends or [0])[-1] == len(bytes(r.bytes).decode()) for r in got)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().bytes is None


def test_query(spark, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = QUERIES["op13_byte_bpe"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_chars) == (
            len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()), len(texts[r.doc_id])
        )


def test_query_over_texts_without_tokens(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, ""), (3, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {(r.doc_id, r.n_tokens, r.n_chars, r.decoded_sha256) for r in QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 0, sha("")), (2, 0, 0, sha("")), (None, 0, 0, sha("")), (3, 2, 3, sha("a b"))}


def test_long_pieces_by_stretches(plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STRETCH", 16)
    monkeypatch.setattr(byte_bpe, "ANEW", 1)
    small = byte_bpe.ByteBpe(byte_bpe.default_path(), byte_bpe.default_pattern())
    tried = []
    monkeypatch.setattr(small, "_stay", lambda a, b, stay=small._stay: tried.append(stay(a, b)) or tried[-1])
    random.seed(11)
    letters = ["a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éàü", "的一是不了", "=-", "ло", "0123456789"]
    pieces = ["".join(random.choices(a, k=n)) for a in letters for n in (90, 150, 400, 700)]
    pieces += ["".join(random.choices(a, k=7)) * 60 for a in letters]
    for p in pieces:
        assert np.concatenate(small._stretches(p.encode())).tolist() == plain.encode_ordinary(p)
    assert True in tried and False in tried  # also where the place where stretches meet has to move


def test_library_gets_bounded_pieces(bpe, monkeypatch):
    sizes = []
    monkeypatch.setattr(bpe, "_library_ids", lambda pieces, ids=bpe._library_ids: sizes.append(sum(map(len, pieces))) or ids(pieces))
    for text in ("xq" * 400_000, " ".join(f"{i:x}" * 40 for i in range(9000))):
        data = np.frombuffer(text.encode(), np.uint8)
        assert sum(len(ids) for ids in bpe.runs(data)) == len(bpe.encode([text])[0])
    assert max(sizes) < 2 * byte_bpe.STRETCH + 1


def test_parts_of_long_texts(bpe, plain, monkeypatch):
    texts = [*odd_texts()[::7], "".join(odd_texts()), "的一是不了" * 300, " " * 500 + "x", "it'll we'll 've 'r 're'l" * 40, "\n \n\n  a" * 90]
    whole = [(plain.encode_ordinary(t), [x.tolist() for x in bpe.offsets(*bpe.encode([t]), np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))]) for t in texts]
    monkeypatch.setattr(byte_bpe, "STRETCH", 64)
    for size in (4, 9, 50):
        monkeypatch.setattr(byte_bpe, "ENCODED_BYTES", size)
        for t, (ids, offsets) in zip(texts, whole, strict=True):
            got = list(bpe.parts(np.frombuffer(t.encode(), np.uint8)))
            assert [np.concatenate([p[i] for p in got] or [[]]).tolist() for i in range(3)] == [ids, *offsets]
            assert [p[3] for p in got] == [False] * (len(got) - 1) + [True] * bool(got)


def test_digests_of_parts(spark, plain, tmp_path):
    texts = {1: "naïve 的一 " * 90_000, 2: "short", 3: "", 4: "é" * 700_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    parts = byte_bpe.encode(docs, parts=True)
    assert {r.doc_id: r["count"] > 1 for r in parts.groupBy("doc_id").count().collect()} == {1: True, 2: False, 3: False, 4: True}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        ids = plain.encode_ordinary(t)
        assert got[i] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()), len(t))
    rows = byte_bpe.decode(parts).selectExpr("*", "0L as n_chars")
    for wrong in (rows.where("part != 1"), rows.where("not last"), rows.where("part > 0")):
        with pytest.raises(Exception, match="is due|is missing"):
            byte_bpe.digests(wrong).collect()
