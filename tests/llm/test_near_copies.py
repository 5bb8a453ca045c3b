"""Resemblance of copies against brute force."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from findery.llm.near_copies import near_copies, prefix_pairs, shingles
from findery.llm.simhash import keep_one
from test_simhash import slow_components, slow_fingerprint

SCHEMA = "doc long, text_hash long, body binary"


def changed(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(800)}"
    texts = []
    for _ in range(12):  # an original and its copies, near and far
        first = [word() for _ in range(rng.randint(60, 300))]
        texts += [first] + [changed(rng, first, rng.choice([0.004, 0.01, 0.02, 0.04, 0.1])) for _ in range(6)]
    crowd = [word() for _ in range(250)]
    texts += [crowd] + [changed(rng, crowd, 0.012) for _ in range(150)]
    passage = [word() for _ in range(120)]  # shared by texts that are otherwise different
    texts += [passage + [word() for _ in range(120)] for _ in range(60)]
    texts += [[word() for _ in range(100)] for _ in range(100)] + [[], ["one"], ["two", "words"]]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def brute(texts, similarity=0.8):
    sets = {i: {t.lower().split()[j] and tuple(t.lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} if t else set() for i, t in texts.items()}
    pairs = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
    up = {i: i for i in texts}
    for _ in texts:
        before = dict(up)
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
        if up == before:
            break
    return pairs, up


def test_groups_equal_brute_force(spark):
    texts = corpus()
    pairs, want = brute(texts)
    df = spark.createDataFrame([(i, 0, t.encode()) for i, t in texts.items()], SCHEMA)
    got = dict.fromkeys(texts)
    got |= {r.node: r.component for r in near_copies(df).collect()}
    linked = sum(got[a] is not None and got[a] == got[b] for a, b in pairs)
    assert linked >= 0.98 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items() if c is not None)  # no group joins what is not alike
    left = [i for i in texts if want[i] == i and got[i] not in (None, i)]
    assert not left


def test_one_of_each_group_stays(spark):
    texts = corpus()
    pairs, _ = brute(texts)
    near = slow_components({i: slow_fingerprint(t) for i, t in texts.items()})
    want = {i: i for i in texts}  # by either relation
    for _ in range(9):
        for a, b in [*pairs, *near.items()]:
            want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame([(i, t, "c", "x") for i, t in texts.items()], "doc_id long, text string, component string, keys string")
    out = keep_one(docs, similarity=0.8)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    originals = set(want.values())
    assert originals <= kept and len(kept) <= 1.05 * len(originals)
    assert keep_one(docs.limit(0), similarity=0.8).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", "", ""), (None, None, "", ""), (1, "a b c d e f", "", ""), (2, None, "", ""), (2, None, "", "")], docs.schema)
    assert sorted(str(r.doc_id) for r in keep_one(odd, similarity=0.8).collect()) == ["1", "2"]


def passages():
    """Texts that share seven eighths of their shingles and resemble no further, but for pairs and chains among them."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for share in (0.84, 0.88):
        passage = [word() for _ in range(200)]
        own = int(200 / share) - 200
        for _ in range(260):
            tail = [word() for _ in range(own)]
            texts.append(passage + tail)
            if rng.random() < 0.25:  # a partner with half of the rest, and one that resembles the partner only
                texts.append(passage + tail[: own // 2] + [word() for _ in range(own - own // 2)])
                if rng.random() < 0.5:
                    texts.append(passage[14:] + texts[-1][200:] + [word() for _ in range(4)])
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_crowded_blocks_are_searched_whole(spark):
    texts = passages()
    pairs, want = brute(texts)
    assert len(pairs) > 100
    df = spark.createDataFrame([(i, 0, t.encode()) for i, t in texts.items()], SCHEMA)
    got = {i: i for i in texts} | {r.node: r.component for r in near_copies(df).collect()}
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []
    assert got == want


def test_shingles():
    assert len(shingles(None)) == 0 and len(shingles(b" \n")) == 0 and len(shingles(b"a b")) == 1 and len(shingles(b"a b c d e f A B C D E F")) == 6


def test_parts_of_a_common_shingle_lose_no_pair(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = {i: " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 16))]) for i in range(90)}
    pairs, _ = brute(texts)
    rows = spark.createDataFrame([(i, 0, t.encode()) for i, t in texts.items()], SCHEMA)
    docs = spark.createDataFrame([(i, i // 2) for i in texts], "doc long, component long")
    found = {part: {tuple(r) for r in prefix_pairs(docs, rows, 0.8, part).collect()} for part in (7, 10**6)}
    assert found[7] == found[10**6]
    assert {p for p in pairs if p[0] // 2 != p[1] // 2} <= found[7]


def test_candidates_below_the_limit(spark):
    """A shared passage just below the limit makes no candidates; changed copies of one text do only close to it."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(370)]

    def mutated(k):
        out = list(base)
        for i in rng.sample(range(370), k):
            out[i] = word()
        return out

    def candidates(texts):
        rows = spark.createDataFrame([(i, i, " ".join(t).encode()) for i, t in enumerate(texts)], SCHEMA)
        return prefix_pairs(rows.selectExpr("doc", "doc AS component"), rows, 0.8).count()

    assert candidates([base + [word() for _ in range(48)] for _ in range(60)]) == 0  # resemblance 0.792
    assert candidates([mutated(12) for _ in range(60)]) == 0  # 0.51 to 0.64
    assert candidates([mutated(8) for _ in range(60)]) <= 60 * 59 // 2  # 0.64 to 0.75: most pairs, none of which is lost or linked
