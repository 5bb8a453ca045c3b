"""Fingerprints and components against brute force."""

import random

import xxhash

from findery.llm.simhash import components, fingerprint, keep_one, links, near_duplicates


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


def slow_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_equal_brute_force():
    for text in ["", None, "one", "One two", "A b C d É e", "x " * 40, "\ta\nb  c\rd e f g"]:
        assert fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_links_lose_nothing_on_either_path(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:10]:
        for _ in range(25):
            fps.add(b ^ sum(1 << x for x in rng.sample(range(20), rng.randint(1, 4))))
    fps = dict(enumerate(f - (1 << 64) if f >> 63 else f for f in sorted(fps)))
    df = spark.createDataFrame(list(fps.items()), "node long, fp long")
    want = slow_components(fps)
    for limit in (2, 1000):
        got = {r.node: r.component for r in components(links(df, limit)).collect()}
        assert {i: got.get(i, i) for i in fps} == want


def test_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in components(df).collect()} == {0}


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 1), (3, "a b c d", 2), (9, "a b c d", 3), (7, " \n", 1), (11, "zz yy xx ww vv", 0), (None, "lone words here today", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 3), (11, 11), (None, None)}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "3", "None"]
    assert near_duplicates(docs.limit(0)).count() == 0
    more = [(1, "aa bb cc dd", 0), (1, "aa bb cc dd", 0), (1, "other words of one id", 0), (None, "aa bb cc dd", 0), (None, "free one two three", 0), (None, "free one two three", 0), (None, "free four five six seven", 0)]
    kept = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame(more, docs.schema)).collect()]
    assert sorted(str(i) for i, _ in kept) == ["1", "None", "None"]
    assert {t for i, t in kept if i is None} == {"free one two three", "free four five six seven"}
