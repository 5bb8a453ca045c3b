"""License spans on small documents."""

import random
import re

from findery.llm.license_texts import NOTICES, PHRASES
from findery.llm.licenses import find_licenses, op10_licenses

SCHEMA = "doc_id long, text string, labels string, size int"


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return {r.doc_id: r for r in find_licenses(df).collect()}


def test_notice_with_lost_and_added_words(spark):
    mit = NOTICES[2][1]
    words = mit.split()
    changed = " ".join(words[:30] + ["really"] + words[30:60] + words[62:])
    got = found(spark, [(1, "lead in " + changed + " and on"), (2, mit.upper()), (3, " ".join(words[:20])), (4, " ".join(w + " no" for w in words))])
    assert got[1].labels == ["mit"] and got[1].n_base == 0 and 0.8 < got[1].score < 1
    assert [(s.first) for s in got[1].spans] == [2]
    assert got[2].score == 1
    assert got[3].labels == [] and got[3].score == 0
    assert got[4].labels == []


def test_odd_rows(spark):
    got = found(spark, [(1, None), (2, ""), (3, "MIT license"), (4, " !? "), (5, "x " * 30_000 + "cc by"), (None, "apache license")])
    assert [got[i].n_words for i in (1, 2, 4)] == [0, 0, 0]
    assert (got[3].base_labels, got[3].score, got[3].first_word) == (["mit"], 0.5, 0)
    assert (got[5].first_word, got[5].labels) == (30_000, ["cc-by"])
    assert got[None].labels == ["apache"]
    twice = spark.createDataFrame([(1, NOTICES[0][1], "", 0)] * 2 + [(1, "other text", "", 0)], SCHEMA)
    assert sorted((r.n_base, r.labels) for r in find_licenses(twice).collect()) == [(0, []), (1, ["mit"]), (1, ["mit"])]
    assert find_licenses(twice.limit(0)).count() == 0


def test_base_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_licenses(spark, sf).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == (min([i for i, _ in at], default=None), max([i for i, _ in at], default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_short_notices_that_repeat(spark):
    note = "Released under the MIT License."
    got = found(spark, [(1, note), (2, f"{note} {note}"), (3, f"{note} Also. {note}"), (4, " ".join([note] * 9)), (5, "x " * 40 + note + " y" * 9 + " " + note)])
    assert [(len(got[i].spans), got[i].score) for i in range(1, 6)] == [(1, 1), (2, 1), (2, 1), (9, 1), (2, 1)]
    assert [(s.first, s.last) for s in got[3].spans] == [(0, 4), (6, 10)]


def test_spans_equal_brute_force(spark):
    rng = random.Random(9)
    notices = [("a", "alpha beta gamma delta epsilon zeta eta theta"), ("b", "one two three four five"), ("c", " ".join(f"w{i}" for i in range(60)))]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [f"filler{rng.randrange(99)}" for _ in range(rng.randint(0, 20))]
            words = rng.choice(notices)[1].split()
            if rng.random() < 0.3 and len(words) > 50:
                at = rng.randrange(10, 50)
                words = words[:at] + ["extra"] * rng.randint(0, 2) + words[at + rng.randint(0, 2) :]
            parts += words
        texts[i] = " ".join(parts)

    def slow(words):
        """Whole notices, and those with a few words changed in the middle: their ends stand in the text."""
        out = []
        for label, text in notices:
            t = text.split()
            at = [p for p in range(len(words)) if words[p : p + 4] == t[:4]]
            for p in at:
                end = next(e for e in range(p + 4, len(words) + 1) if words[e - 4 : e] == t[-4:])
                out.append((p, end - 1, label))
        return sorted(out)

    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], SCHEMA)
    for r in find_licenses(df, notices=notices).collect():
        assert [(s.first, s.last, s.label) for s in r.spans] == slow(texts[r.doc_id].split()), texts[r.doc_id]


def test_a_long_text_of_phrases():
    """Places are counted forward: time grows with the text, not with its square."""
    import time

    import pyarrow as pa

    from findery.llm.licenses import base

    batch = lambda n: pa.RecordBatch.from_pydict({"doc": [1], "text_hash": [1], "body": [b"x mit license" * 1 + b" mit license" * n]})
    start = time.perf_counter()
    (got,) = base(iter([batch(80_000)]))
    assert time.perf_counter() - start < 2
    row = got.to_pylist()[0]
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (160_003, 80_001, 1, 160_001)
