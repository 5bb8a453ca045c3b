"""Windows, cuts and the shuffle path against brute force."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from findery.llm.common import among, bits_of
from findery.llm.decontaminate import decontaminate, find_overlaps

DOCS = "doc_id long, text string, n_hit string, item_id int"
ITEMS = "item_id long, text string, doc_id int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        k = min(10, len(b))
        for g in {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else ():
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) == g:
                    hit.update(range(p, p + k))
                    found |= {str(i)} - {"None"}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def data():
    rng = random.Random(4)
    word = lambda: rng.choice("a b c d É é".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 10, 11, 14])))) for i in range(8)]
    items += [(None, "b b a c c"), (None, "unnamed"), (20, None), (21, " .. "), (3, "repeated id of other words in this item here now ok"), (22, "zebra"), (9, items[4][1])]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "!!"), (53, "x, ".join(["repeated", "id", "of", "other", "words", "in", "this", "item", "here", "now", "ok"])), (None, "a ZEBRA!"), (52, "zebra"), (55, "an unnamed one")]
    docs += [(54, "filler " * 30_000 + "zebra")]
    return docs, items


def test_both_paths_equal_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, "", 0) for x in docs], DOCS)
    b = spark.createDataFrame([(*x, 0) for x in items], ITEMS)
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    for limits in ({}, {"broadcast_chars": 0}, {"broadcast_windows": 10}):
        rows = find_overlaps(d, b, **limits).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want
        assert all(sum(s.last - s.first + 1 for s in r.spans) == r.n_hit for r in rows)
    assert find_overlaps(d.limit(0), b).count() == 0 and find_overlaps(d, b.limit(0)).where("contaminated").count() == 0
    assert find_overlaps(d, b.limit(0), broadcast_chars=-1).where("contaminated").count() == 0


def test_spans_are_cut_and_leaks_removed(spark):
    leak = "one two three four five six seven eight nine ten eleven"
    own = " ".join(f"own{i}" for i in range(20))
    rows = [(1, f"{own}. ONE, {leak[4:]} -- {own}"), (2, leak), (3, f"few {leak}"), (4, own), (5, None), (6, "one two three four five one " + leak[4:] + " six seven eight nine ten eleven " + own)]
    d = spark.createDataFrame([(*x, "", 0) for x in rows], DOCS)
    for limits in ({}, {"broadcast_windows": 1}):
        out = decontaminate(d, spark.createDataFrame([(1, leak, 0)], ITEMS), **limits)
        assert out.columns == d.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == {1: f"{own}.  -- {own}", 4: own, 5: None, 6: got[6]}
        assert own in got[6] and "eleven" not in got[6]


def test_cuts_are_equal_on_both_paths(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, "", 0) for x in docs], DOCS)
    b = spark.createDataFrame([(*x, 0) for x in items], ITEMS)
    one, two = (sorted(map(str, decontaminate(d, b, max_hit_share=0.9, **x).collect())) for x in ({}, {"broadcast_chars": 0}))
    assert one == two and len(one) > 5
    kept = find_overlaps(decontaminate(d, b, max_hit_share=0.9), b)
    assert kept.where("contaminated").count() == 0
    assert decontaminate(d, b.limit(0), broadcast_windows=-1).count() == len(docs)


def test_ids_that_are_not_whole_numbers(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "", 0), (2, "gamma", "", 0)], DOCS)
    for ids, kind in (([True, False], "boolean"), ([0.1, 2.0], "double"), ([datetime.date(2024, 1, 2), None], "date")):
        items = spark.createDataFrame([(ids[0], "alpha beta", 0), (ids[1], "gamma", 0)], ITEMS.replace("long", kind))
        one, two = (sorted(map(str, find_overlaps(docs, items, **x).collect())) for x in ({}, {"broadcast_chars": 0}))
        assert one == two


def test_few_windows_are_shuffled(spark):
    """The join of a large benchmark: windows that are none of it stop before the exchange."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(400)), "", 0) for i in range(200)], DOCS)
    items = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(100)), 0) for i in range(40)], ITEMS)
    found = find_overlaps(docs, items, broadcast_windows=0)
    assert found.count() == 200
    plan = found._jdf.queryExecution()
    found._jdf.queryExecution().executedPlan()
    text = plan.optimizedPlan().toString()
    assert "getbit" in text and text.index("Join Inner") < text.index("getbit")  # below the join of the windows
    seen = among(spark.createDataFrame([(i,) for i in range(100_000)], "n long").select(F.xxhash64("n").alias("h"), "n"), bits_of(spark.range(1000).select(F.xxhash64("id").alias("h"))))
    got = {r.n for r in seen.select("n").collect()}
    assert set(range(1000)) <= got and len(got) < 5000
    rest = among(spark.range(5000).select(F.xxhash64("id").alias("h"), "id"), bits_of(spark.range(1000).select(F.xxhash64("id").alias("h"))), inside=False)
    assert 3700 < rest.count() <= 4000 and rest.where("id < 1000").count() == 0
    none = bits_of(spark.range(0).select(F.xxhash64("id").alias("h")))
    assert among(spark.range(9).select(F.xxhash64("id").alias("h")), none).count() == 0
