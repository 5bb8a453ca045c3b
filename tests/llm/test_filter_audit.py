"""The audit of filters against every order walked over the documents themselves."""

import random
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from findery.llm.filter_audit import COLUMNS, audit, audit_part, polynomial, shapley, text_mask

DOCS = "doc_id long, text string, source string, part string, mask int, n int, good string"
LABELS = "doc_id long, quality int, toxic int, doc string"


def brute(docs, labels):
    """{(part, order, step): COLUMNS} by applying each order to each document."""
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in docs):
            fails.add("E")
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, share = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                share[part, f] = share.get((part, f), 0) + len(gone)
                all_f = [r for r in own if f in r[1]]
                out[part, "".join(order), step] = [
                    len(stay), len(gone), len(all_f) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
                left = stay
    return {k: [*v, share[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def run(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x", 1, 2, "y") for d in docs], DOCS)
    known = spark.createDataFrame([(*x, "z") for x in labels], LABELS)
    rows = audit(frame, known).collect()
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["few words", "A" * 50, "", None, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 90}" for i in range(200)), "x " * 300 + "#", "é" * 98 + "AB", "é" * 97 + "ABC"]
    texts += [" ".join(rng.choice("abc$D") * rng.randint(1, 3) for _ in range(rng.randint(150, 260))) for _ in range(30)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(250)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 250, 2)]
    labels += [(4, 1, 0), (6, None, 1), (999, 1, 1), (None, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    long = "word " * 200_000 + "Z"
    docs = [(1, long, "a"), (2, long, "b"), (2, long, "b"), (2, "other", "b"), (None, long, "a"), (None, None, None), (3, None, None), (4, "", ""), (4, "", ""), (1, long, "c"), (-7, "\x1c\x85  x", "a")]
    labels = [(2, 1, 1), (2, 0, 0), (4, None, None), (4, 1, None)]
    got = run(spark, docs, labels)
    assert got == brute(docs, labels)
    assert len(got) == 600 * 4
    empty = spark.createDataFrame([], DOCS)
    assert audit(empty, spark.createDataFrame([], LABELS)).count() == 0
    assert audit(spark.createDataFrame([(1, "a", "s", "x", 1, 2, "y")], DOCS), spark.createDataFrame([], LABELS)).count() == 600


def test_masks_at_the_limits():
    assert text_mask(b"") == 0b0001
    assert text_mask((" ".join(f"w{i}" for i in range(200))).encode()) == 0
    assert text_mask((" ".join(f"w{i % 99}" for i in range(199))).encode()) == 0b0011
    assert text_mask(("é" * 98 + "AB").encode()) & 4 == 0 and text_mask(("é" * 97 + "AB").encode()) & 4
    assert text_mask(b"a|b") & 8 and not text_mask(b"a@b") & 8


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.integers(1, 50), max_size=12))
def test_shares_are_the_sums_over_orders(counts):
    rows = audit_part({m: (n, n, 0) for m, n in counts.items()})
    poly = polynomial(counts, 5)
    for i, f in enumerate("ABCDE"):
        by_order = sum(r[3] for r in rows if r[0][r[1] - 1] == f)
        assert 120 * shapley(poly, i) == by_order == next(r[8] for r in rows if r[0][r[1] - 1] == f)
    # what all filters remove is shared out whole
    assert sum(shapley(poly, i) for i in range(5)) == sum(n for m, n in counts.items() if m)
