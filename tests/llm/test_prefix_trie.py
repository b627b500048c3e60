"""The trie of conversation openings against brute force, with every odd row."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skylog.llm import prefix_trie
from skylog.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, name string, size string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}\n{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(conversations):
    """Rows by plain recursion over prefixes of {conv_id: turns}."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(c for c in m if len(conversations[c]) == len(p)))
        for p, m in members.items()
    )


def collected(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect())


def of_rows(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, "n", "s") for r in rows], SCHEMA).repartition(3)
    turns = prefix_trie.ordered_turns(table, **({"block": sizes["block"]} if "block" in sizes else {}))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(turns), **sizes)


def random_rows(seed, n):
    random.seed(seed)
    rows = []
    for c in random.sample(range(400), n):
        first = random.choice(["hot", "hot", "hot", "b", "c"])
        for t in range(random.choice([0, 1, 1, 2, 3, 5, 8, 20])):
            rows.append((c, t * random.choice([1, 1, 3]) if random.random() < 0.98 else None, random.choice(["user", "user", None]), first if not t else random.choice(["x", "yé", "", None])))
    return rows + [(None, 1, "user", "lost"), (7, 10**12, None, None), (7, 10**12, "user", "tie"), (7, 10**12, "user", "tie")]


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"component": 6}), (3, {"component": 30, "block": 3}), (4, {"component": 2, "block": 2})])
def test_trie(spark, seed, sizes):
    rows = random_rows(seed, 70)
    assert collected(of_rows(spark, rows, **sizes)) == brute(rebuilt(rows))


def test_long_chain_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 64)
    long = [(100 * c, t, "user", f"turn {t}") for c in (1, 2, 3) for t in range(300 - c)]
    copies = [(10_000 + c, t, "user", "same") for c in range(150) for t in range(7)]
    rows = long + copies
    want = brute(rebuilt(rows))
    assert collected(of_rows(spark, rows, component=100, block=50)) == want
    assert collected(of_rows(spark, rows)) == want


def test_turnless_negative_and_none(spark):
    rows = [(c, 0, "user", "only") for c in range(-5, 5)] + [(250 + c, 0, "user", str(c)) for c in range(8)]
    want = rebuilt([r for r in rows if r[0] >= 0])
    assert any(not turns for turns in want.values())
    assert collected(of_rows(spark, [r for r in rows if r[0] >= 0])) == brute(want)
    assert collected(of_rows(spark, rows))[0][1:4] == (0, -1, len(rows))
    assert collected(of_rows(spark, [])) == []
    assert collected(of_rows(spark, [(None, 1, "a", "b")])) == []


@pytest.mark.parametrize("seed", range(6))
def test_centroid_sums(seed):
    random.seed(seed)
    parent = np.array([-1 if random.random() < 0.03 or i == 0 else max(0, i - random.choice([1, 1, 1, 2, 9, i])) for i in range(500)])
    depth, weight = np.zeros(500, np.int64), np.array([random.choice([1, 1, 1, 50]) for _ in range(500)])
    values = np.array([[random.randint(-9, 9), 1 << 60 if i < 3 else 1] for i in range(500)])
    want = values.copy()
    for i in range(500):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else random.randint(0, 3)
    for i in range(499, 0, -1):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
            weight[parent[i]] += weight[i]
    assert (prefix_trie.centroid_sums(parent, depth, weight, values) == want).all()


def test_tasks_hold_whole_components(spark, monkeypatch):
    rows = random_rows(9, 60)
    monkeypatch.setattr(prefix_trie._inside_tasks, "__defaults__", (5,))
    assert collected(of_rows(spark, rows, component=20)) == brute(rebuilt(rows))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op12_prefix_trie"](spark, DATA)) == brute(rebuilt(rows))
