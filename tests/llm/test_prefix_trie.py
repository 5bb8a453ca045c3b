"""The trie against one made of whole paths in a dictionary."""

import hashlib
import random
from zlib import crc32

import pytest

from findery.llm import prefix_trie
from findery.llm.prefix_trie import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, n_convs int"


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        base, h = c - (abs(c) % 100) * (1 if c >= 0 else -1), crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(base, [])[:h] + ts[h:]) if rebuild else tuple(ts)
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q)
        listed = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in under), saved,
            hashlib.sha256(listed.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie(df, **how).collect()), key=str)


def made(rng, convs):
    rows = []
    for c in convs:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t, rng.choice(["user", "user", "bot", None]), rng.choice(["a", "b", "é𝄞", None, ""])))
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_against_brute_force(spark, monkeypatch, rebuild):
    # small tables, ranges and merges, so that each is met more than once
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(prefix_trie, "ENDS_SHIFT", 3)
    rng = random.Random(11)
    rows = made(rng, rng.sample(range(-250, 450), 150))
    assert run(spark, rows, rebuild=rebuild) == brute(rows, rebuild)


def test_small_tables(monkeypatch):
    """A table that is emptied at every turn gives the same sums."""
    rng = random.Random(3)
    whole, cut = prefix_trie.PartialTrie(), prefix_trie.PartialTrie()
    sums = {}
    for c in range(60):
        path = [(bytes([rng.randint(0, 2)]), 1) for _ in range(rng.randint(0, 6))]
        for t in (whole, cut):
            t.start(c)
            for turn in path:
                t.step(*turn)
                if t is cut:
                    for n, v in t.nodes.items():
                        s = sums.setdefault(n, [v[0], 0, c, [], v[5]])
                        s[1], s[2], s[3] = s[1] + v[2], min(s[2], v[3]), s[3] + v[4]
                    cut.batch(0)
            t.end()
    for n, v in cut.nodes.items():
        s = sums.setdefault(n, [v[0], 0, v[3], [], v[5]])
        s[1], s[2], s[3] = s[1] + v[2], min(s[2], v[3]), s[3] + v[4]
    assert {n: (v[0], v[2], v[3], sorted(v[4]), v[5]) for n, v in whole.nodes.items()} == {n: (s[0], s[1], s[2], sorted(s[3]), s[4]) for n, s in sums.items()}


def test_odd_rows(spark):
    long = "w" * 300_000
    rows = [
        (100, None, "user", "first"), (100, None, None, "before first"), (100, 5, "user", long), (100, 5, "user", long), (100, -1, "bot", None),
        (101, 0, None, None), (101, 1, "user", ""), (7, 0, "user", "no block"), (150, 3, "user", long), (None, 0, "user", "lost"), (None, None, None, None), (-3, 0, "a", "b"),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[1] == 0 and r[3] == 5 for r in got)
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [(c, 0, "user", "same") for c in range(500)]
    assert run(spark, only, rebuild=False) == brute(only, rebuild=False)
    # nothing but conversations without turns once they are rebuilt
    bare = [(c, 0, "user", "x") for c in range(1, 100) if crc32(str(c).encode()) % 6][:4]
    assert run(spark, bare) == brute(bare) and len(run(spark, bare)) == 1


def test_long_conversations(spark):
    rows = [(c, t, "user", str(t if t < 700 else c * t)) for c in (1, 2, 3) for t in range(800)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = {(r.depth, r.conv_id): r for r in trie(df, rebuild=False).collect()}
    assert len(got) == 1 + 700 + 300
    assert got[0, 1].n_leaves == 3 and got[700, 1].n_children == 3 and got[701, 2].n_leaves == 1
    assert got[0, 1].saved_tokens == 2 * sum(len(str(t)) for t in range(700))
    assert got[350, 1].saved_tokens == 2 * sum(len(str(t)) for t in range(349, 700))
