"""Entities against Python's regular expressions, and the terms that reveal them."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from findery.llm.pii import base_spans, counted, find_pii, op5_pii, placed_words, sanitise


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def only(d):
    return "".join(c for c in d if c in "0123456789")


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) <= 255 for x in h.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda h: 12 <= len(only(h)) <= 19 and luhn(only(h))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(only(h)) <= 15),
}
SCHEMA = "doc_id long, text string, base string, terms int"


def slow(text):
    out = []
    for rank, (kind, (p, ok)) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "") if ok(m[0])]
    return [x[2] for x in sorted(out)]


CASES = [
    None, "", "a@b.c", "x a@b.com.x_y@z.com, q", "a@b@c.d", "é a.b%+c@d-e.f-g.h.", "@a.b", "....@a.b..c@d.e", "a@b.c-d@e.f",
    "1.2.3.4 256.1.1.1 001.02.3.255 1.2.3.4.5.6.7.8 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 0000000000000 5  5", "4111111111111111 1.2.3.4",
    "+1 (603) 555-8791 +1 603 +12 (3)..-45 678 9- +1234567890123456 ++1 234567890", "😀 +1 234 567 890 😀 a@b.cd 😀 10.0.0.1",
    "9" * 60_000, "a" * 60_000, "a@" + "b." * 30_000 + "c", "1 " * 30_000, "+1" + "." * 50_000 + "2",
]


def test_base_equals_python(spark):
    rows = [(i, t, "", 0) for i, t in enumerate(CASES)]
    got = {r.doc: r.base for r in find_pii(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in sorted(got[i])] == slow(t), (t or "")[:80]


def test_query_equals_python(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op5_pii(spark, sf).collect():
        want = slow(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]


def corpus():
    rows = [(i, f"number{i} plain words that stand everywhere in the texts, group{i % 4}", "", 0) for i in range(60)]
    rows += [(100 + i, f"Ask Falconwing the common words {'xyzw'[i]}longer about it at boss@corp.com today", "", 0) for i in range(4)]
    rows += [(200, "FALCONWING again, without the address", "", 0), (201, "nothing falconwings here", "", 0)]
    return rows


def test_terms_that_reveal(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    got = {r.doc: {(s.kind, s.start, s.end) for s in r.more} for r in find_pii(df).collect()}
    n, n_e, n_te, n_t = 66, 4, 4, 5
    assert math.log(n_te * n / (n_t * n_e)) / math.log(n / n_e) > 0.85
    assert ("term", 4, 14) in got[100] and got[200] == {("term", 0, 10)} and got[201] == set() and got[5] == set()
    # words that stand with the entity alone are removed
    assert ("reveal", 40, 45) in got[100]
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert clean[200] == "[TERM] again, without the address"
    assert "boss@corp.com" not in clean[100] and "[EMAIL]" in clean[100]
    assert clean[5] == corpus()[5][1]


def test_odd_rows(spark):
    rows = [(1, None, "b", 1), (None, "x a@b.cd", "b", 2), (3, "x a@b.cd", "b", 3), (3, "x a@b.cd", "b", 3), (3, "other", "b", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sanitise(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [
        ("1", "None"), ("3", "other"), ("3", "x [EMAIL]"), ("3", "x [EMAIL]"), ("None", "x [EMAIL]"),
    ]
    assert find_pii(df).count() == 5
    assert sanitise(df.limit(0)).count() == 0


def test_seen_once_and_repeated_signatures(spark):
    common = "plain words that stand everywhere in all of these texts"
    rows = [(i, f"{common} group{i % 4} and she met Kim there" if i % 3 else common, "", 0) for i in range(4000)]
    rows += [(5000, f"{common} Zorblatt writes from {' '.join(f'group{i % 4}' for i in range(60))} zorb@corp.com", "", 0)]
    rows += [(5001 + i, f"{common} group{i % 4} Quenlow Ng sends regards, call +1 234 567 8901", "", 0) for i in range(40)]  # word for word
    rows += [(5100, "asked Quenlow and Ng about these words", "", 0)]
    got = {r.doc_id: r.text for r in sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "zorblatt" not in got[5000].lower() and "[EMAIL]" in got[5000]  # once, sixty words before its address
    assert all("Quenlow" not in got[i] and "Ng" not in got[i] and "[PHONE]" in got[i] for i in range(5001, 5041))
    assert got[5100] == "asked [TERM] and [TERM] about these words"
    assert all(got[i] == t for i, t, *_ in rows[:4000])


def test_accidental_company_stays(spark):
    common = "plain words that stand everywhere in all of these texts"
    rows = [(i, f"{common} group{i % 4} again", "", 0) for i in range(4000)]
    rows += [(5000, f"{common} once Blenkarn at blen@corp.com", "", 0), (5001, f"{common} where Blenkarn is a word like others", "", 0)]
    got = {r.doc_id: r.text for r in sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5001] == rows[4001][1] and "Blenkarn" in got[5000] and "[EMAIL]" in got[5000]


def slow_terms(texts, chance, generalise, remove, posterior):
    """Terms and their kinds by counting every word of every document with every entity."""
    splits = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    held = {}
    for i, t in texts.items():
        spans = sorted((m.start(), k, m) for k, (p, ok) in PATTERNS.items() for m in re.finditer(p, t) if ok(m[0]))
        entities = {(k, m[0].lower() if k == "email" else only(m[0])) for _, k, m in spans}
        bare = t
        for _, _, m in reversed(spans):
            bare = bare[: m.start()] + " " + bare[m.end() :]
        words = [w for w in re.split(splits, bare) if w and not w[0].isdigit()]
        words = {w.lower() for w in words}
        held[i] = (entities, words, words if entities else set())
    n, out = len(texts), {}
    for e in set().union(*[x[0] for x in held.values()]):
        with_e = [x for x in held.values() if e in x[0]]
        tried = set().union(*[x[2] for x in with_e])
        for t in tried:
            n_e, n_t, n_te = len(with_e), sum(t in x[1] for x in held.values()), sum(t in x[2] for x in with_e)
            ratio = n_te * n / (n_t * n_e)
            if ratio <= 1 or n_t == n or n_e == n or n_te < posterior * (n_t + 1):
                continue
            away = (n_e - n_te) * math.log((n_e - n_te) / n_e / (1 - n_t / n)) if n_e > n_te else 0
            if n_te * math.log(ratio) + away - math.log(len(tried)) < -math.log(chance):
                continue
            d = math.log(ratio) / math.log(n / n_e)
            if d >= generalise:
                out[t] = max(d, out.get(t, 0))
    return {t: "reveal" if d >= remove else "term" for t, d in out.items()}, {i: x[1] for i, x in held.items()}


def test_terms_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "brstk" for b in "aeiou" for c in ("nd", "lm", "rt", "sk")]
    texts = {}
    for i in range(700):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(3, 12))]
        if rng.random() < 0.4:
            who = rng.randrange(30)
            text.insert(rng.randint(0, len(text)), f"Name{chr(97 + who % 26)}{who} ")
            if rng.random() < 0.8:
                text.append(f"mail{who}@corp.com")
        texts[i] = " ".join(text)
    want, words = slow_terms(texts, 0.01, 0.85, 0.999, 0.5)
    assert len(want) > 10 and len(set(want.values())) == 2
    df = spark.createDataFrame([(i, t, "", 0) for i, t in texts.items()], SCHEMA)
    for r in find_pii(df).collect():
        got = {(texts[r.doc][s.start : s.end].lower(), s.kind) for s in r.more}
        assert got == {(t, want[t]) for t in words[r.doc] & want.keys()}, texts[r.doc]


def test_many_terms_in_a_long_text(spark):
    """Every word of a long text is a term, and all are placed."""
    words = [f"wörd{i}" for i in range(20_000)]
    rows = [(i, "plain words of no one", "", 0) for i in range(200)] + [(500 + i, f"{' - '.join(words)} a@b.cd,", "", 0) for i in range(8)]
    got = {r.doc: r for r in find_pii(spark.createDataFrame(rows, SCHEMA)).collect()}
    at = 0
    for s, w in zip(sorted(got[500].more), words, strict=True):
        assert (s.start, s.end, s.kind) == (at, at + len(w), "reveal")
        at += len(w) + 3
    assert got[3].more == []


def test_places(spark):
    texts = ["", "one", "  a.b -c9\n\u0130x ", "é𝄞z 1a a1", "." * 50, " ".join(f"w{i}" for i in range(1000)) + "!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {}
    for r in placed_words(rows, F.col("text"), "doc").collect():
        got.setdefault(r.doc, []).append((r.start, r.end, r.word))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", t)], t


def test_words_that_touch_an_entity(spark):
    """A word that is one only without the entity it touches counts where it is tried; elsewhere it stands in an entity alone."""
    rows = [(0, "filler ann@mail.exampleédam here"), (1, "card 4111111111111111zedword here"), (2, "write to édam+x@q.org here"), (3, "write zedword@q.org here")]
    rows += [(4, "both 5500005555555559zedword here"), (5, "a zedword here")] + [(10 + i, f"plain text number w{i} here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r.doc: r for r in counted(docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), "text", base_spans(F.col("text")).alias("base"))).collect()}
    assert held[1].apart == ["zedword"] and held[3].within == ["zedword", "q", "org"] and not held[10].apart
    found = {r.doc: {(s.start, s.end, s.kind) for s in r.more} for r in find_pii(docs).collect()}
    assert found[0] == {(0, 6, "reveal")} and found[5] == set()
