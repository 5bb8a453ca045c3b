"""Text functions, full text and the hybrid plan."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findery.functions import english, fulltext
from findery.functions.english import english_lexemes, lexemes, stem
from findery.functions.text import like_normalise, similarity, trigram_set, trigrams, with_repository
from findery.operators import ingest, scoring
from findery.operators.filters import live
from findery.operators.lookup import MediaCache, healthy, project
from findery.plans import search as hybrid
from findery.schema import PROJECTS, BadRequest, NotFound
from findery.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def projects(spark):
    return fixtures.projects(spark, SF).persist()


def test_trigrams(spark):
    assert trigrams("small ring") == ["  s", " sm", "sma", "mal", "all", "ll ", "  r", " ri", "rin", "ing", "ng "]
    texts = ["small ring", "Small-RING 7", "", None, "é", "!!", "aa aa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", trigram_set(F.col("t")).alias("g"), similarity(F.col("t"), "small rings").alias("s"), similarity(F.col("t"), "").alias("z")).collect():
        if r.t is None:
            assert r.s is None
        else:
            a, b = set(trigrams(r.t)), set(trigrams("small rings"))
            assert set(r.g) == a and math.isclose(r.s, len(a & b) / len(a | b)) and r.z == 0
    assert round(df.select(similarity(F.lit("small ring"), "small rings")).first()[0], 6) == 0.769231


def test_scores_are_worked_out_once(projects):
    """Five columns, one intersection each, wherever the score is read."""
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("array_intersect")
    found = scoring.trigram_matches(live(projects), "small ring")
    assert count(found) == 5 and count(hybrid.lexical_scores(projects, hybrid.parse_filters('"small ring"'))) == 5
    same = live(projects).where(scoring.trigram_match("small ring"))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in same.collect()) != []


def test_repository_paths(spark):
    cases = [
        ("https://example.com/user0/small-ring.git", "user0", "small-ring"), ("git@example.com:user1/red_widget.git", "user1", "red_widget"),
        ("https://example.com/user2/blue-bolt/", "user2", "blue-bolt"), ("https://example.com/o/r.git/", "o", "r.git"),
        ("https://example.com/user5/small_bolt/tree/main", "user5", "small_bolt"), ("example.com/user4/small-gizmo", "example.com", "user4"),
        ("HTTPS://example.com/user6/old-bolt", "HTTPS:", None), (None, None, None), ("", None, None), ("https://e.com/" + "o" * 51 + "/" + "r" * 81, None, None),
    ]
    df = spark.createDataFrame([(c[0], None) for c in cases], "code_url string, media_url string")
    got = [(r.inferred_username, r.inferred_repo) for r in with_repository(df).collect()]
    assert got == [c[1:] for c in cases]


def test_like_patterns(spark):
    assert [like_normalise(x) for x in ("a%_b", "a\\", "\\x", "\\%", "a\\\\b")] == ["a%_b", "a", "x", "\\%", "a\\\\b"]
    df = spark.createDataFrame([("axb",), ("a%b",)], "t string")
    assert df.where(F.col("t").like(like_normalise("a\\%b"))).count() == 1 and df.where(F.col("t").like(like_normalise("a\\xb"))).count() == 1


def test_stems():
    words = {
        "consign": "consign", "consigned": "consign", "consistency": "consist", "knightly": "knight", "knots": "knot", "running": "run", "hopping": "hop",
        "hoping": "hope", "happily": "happili", "relational": "relat", "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "generously": "generous",
        "general": "general", "skies": "sky", "exceedingly": "exceed", "proceeds": "proceed", "agreed": "agre", "luxuriated": "luxuri", "possibly": "possibl",
        "rings": "ring", "bolts": "bolt", "by": "by", "say": "say", "cry": "cri", "rational": "ration", "national": "nation", "adjustable": "adjust", "electricity": "electr",
    }
    assert {w: stem(w) for w in words} == words
    assert lexemes("The quick Foxes are jumping") == [("quick", 2), ("fox", 3), ("jump", 5)]


def test_queries_parse():
    p = fulltext.parse
    assert p("the") is None and p("") is None
    assert p("red -widget").parts[1].kind == "not"
    assert p("red or blue").kind == "or"
    assert p('"small rings"') == fulltext.Node("phrase", ("small", "ring"), gaps=(1,))
    assert p("small-ring").kind == "phrase"
    assert p('"ring of gold"').gaps == (2,)


def slow_holds(node, seen):
    if node.kind == "word":
        return node.value in seen
    if node.kind == "phrase":
        offsets = [sum(node.gaps[:i]) for i in range(len(node.parts))]
        return any(all(p + o in seen.get(w, ()) for w, o in zip(node.parts, offsets)) for p in seen.get(node.parts[0], ()))
    if node.kind == "not":
        return True
    return (all if node.kind == "and" else any)(slow_holds(p, seen) for p in node.parts)


def slow_density(entries, node):
    """Every extent tried: those that satisfy the query and hold no smaller one that does."""
    entries = sorted((p, w) for p, w in entries if w in fulltext.words_of(node))
    holds = lambda a, b: slow_holds(node, {w: {p for p, x in entries[a : b + 1] if x == w} for _, w in entries[a : b + 1]})
    good = [(a, b) for a in range(len(entries)) for b in range(a, len(entries)) if holds(a, b)]
    least = [(a, b) for a, b in good if not any((c, d) != (a, b) and a <= c and d <= b for c, d in good)]
    noise = lambda a, b: entries[b][0] - entries[a][0] - (b - a)
    return sum(0.1 / (1 + (n if (n := noise(a, b)) >= 0 else (b - a) / 2)) for a, b in least)


def test_cover_density(spark):
    import random

    rng = random.Random(4)
    texts = ["a b c a", "a b", "a x x b", "a b a", "a x b", "a b x a b", "a c", "a", "", "a a b b a b"] + [" ".join(rng.choice("abcdx") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", english.plain_lexemes(F.col("t")).alias("tsv")).persist()
    known = {"a": {0: 0.2}, "a b": {1: 0.1, 2: 0.1 / 3, 3: 0.2}, '"a b"': {4: 0, 5: 0.2}, "a or c": {6: 0.2}, "-b": {7: 0}}
    for q in [*known, "a b c", "a b or c", '"a b c" or d', 'a -c "b d"', '"a a"', "a or -b", "d", '"a b" "b a"', "a a"]:
        node = fulltext.parse(q, False)
        got = {r.i: r.rank for r in df.select("i", fulltext.rank(node)(F.col("tsv")).alias("rank")).collect()}
        for i, t in enumerate(texts):
            assert math.isclose(got[i], slow_density(list(enumerate(t.split(), 1)), node), abs_tol=1e-9), (q, t)
        for i, value in known.get(q, {}).items():
            assert math.isclose(got[i], value, abs_tol=1e-9)
    assert "Python" not in df.select(fulltext.rank(fulltext.parse('a "b c"', False))(F.col("tsv")))._jdf.queryExecution().executedPlan().toString()


#: Text and the tokens that it is made of, by hand.
CLASSES = {
    "Mail boss.x@Corp.com now": ["mail", "boss.x@corp.com", "now"],
    "see http://Example.com/stuff/index.html, or": ["see", "example.com/stuff/index.html,", "example.com", "/stuff/index.html,", "or"],
    "at example.org. And end.then": ["at", "example.org", "and", "end.then"],
    "https://x.io small-ring up-to-date": ["x.io", "small-ring", "small", "ring", "up-to-date", "up", "to", "date"],
    "12.5 2024-01-01 -x x- a--b a_b-c": ["12", "5", "2024", "01", "01", "x", "x", "a", "b", "a", "b-c", "b", "c"],
    "a@b x@y.z/w été-fin.fr/à 日本-語": ["a", "b", "x@y.z", "w", "été-fin.fr/à", "été-fin.fr", "/à", "日本-語", "日本", "語"],
    "a.b-c.de/": ["a.b-c.de/", "a.b-c.de", "/"],
}


def test_token_classes(spark):
    df = spark.createDataFrame([(t,) for t in CLASSES], "t string")
    for r in df.select("t", english.tokens(F.col("t")).alias("w")).collect():
        assert r.w == CLASSES[r.t], r.t
    assert fulltext.parse("small-ring").parts == ("small-ring", "small", "ring")
    got = df.select("t", english_lexemes(F.col("t")).alias("v")).where(fulltext.matches(F.col("v"), fulltext.parse("example.com small-rings or example.com"))).collect()
    assert [r.t for r in got] == ["see http://Example.com/stuff/index.html, or"]


def test_stored_lexemes(spark):
    texts = ["small ring", "a small red ring and a ring", "ring small", "red bolts", "", None, "Rings of small_things", "Straße ÉTÉ x2", *CLASSES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and [(x.lexeme, x.pos) for x in r[0]] for r in df.select(english_lexemes(F.col("t"))).collect()]
    assert [g or [] for g in got] == [lexemes(t or "") for t in texts] and got[5] is None


def test_search_reads_stored_lexemes(spark, projects):
    """What is stored is searched, not the text: no search stems a row again."""
    stored = ingest.with_lexemes(projects)
    ask = '"small ring" or bolts'
    assert hybrid.search(stored, None, ask).collect() == hybrid.search(projects, None, ask).collect()
    gone = projects.withColumn("tsv", F.array().cast(PROJECTS["tsv"].dataType))
    assert hybrid.search(gone, None, ask, branches=["fts"]).count() == 0 < hybrid.search(projects, None, ask, branches=["fts"]).count()


def test_user_filters():
    p = hybrid.parse_filters
    assert p("bolt user:user1") == hybrid.Parsed("user1", "bolt", "bolt")
    assert p("superuser:x").user is None
    assert p('user:a "x  y" user:b') == hybrid.Parsed("a", '"x  y"', "x y")
    assert p("user:50%").user == "50%" and p("user:a_b").text == ""


def test_weights_and_caps():
    assert hybrid.weights() == {"fts": 0.7 / 1.0, "semantic": 0.2 / 1.0, "trigram": 0.1 / 1.0} or math.isclose(sum(hybrid.weights().values()), 1)
    assert hybrid.weights(0, 0, 0) == {"fts": 0.7, "semantic": 0.2, "trigram": 0.1}
    assert hybrid.weights(-1, 3, 1) == {"fts": 0, "semantic": 0.75, "trigram": 0.25}
    for bad in (float("nan"), float("inf")):
        with pytest.raises(BadRequest):
            hybrid.weights(bad)
    assert hybrid.caps(10) == {"fts": 100, "phrase": 80, "semantic": 80, "trigram": 150, "literal": 120} and hybrid.caps(100)["literal"] == 1200


@settings(max_examples=50, deadline=None)
@given(*[st.one_of(st.none(), st.floats(-5, 5))] * 3)
def test_weights_sum_to_one(a, b, c):
    assert math.isclose(sum(hybrid.weights(a, b, c).values()), 1)


def test_literal_levels(projects, spark):
    df = spark.createDataFrame([("my-repo", None, "x", "http://a/my repo", None, "me", "my repo"), ("other", "My Repo two", "x", None, None, "my repo", "other")],
                               "inferred_repo string, display_name string, ysws string, code_url string, demo_url string, search_username string, search_repo string")
    score = lambda q: [r[0] for r in df.select(scoring.literal_score(scoring.raw_query(q))).collect()]
    assert score("My-Repo") == [4.0, 0.0] and score("my repo") == [2.4, 2.2] and score("epo") == [1.5, 1.35] and score("") == [0.0, 0.0] and score("m_ re") == [2.4, 2.2]


def test_hybrid_full(projects, spark):
    vectors = fixtures.embeddings(spark, SF)
    one = list(vectors.where("project_id = 1").first()["embedding"])
    rows = hybrid.search(projects, vectors, "small rings", limit=10, embed=lambda t: one).collect()
    assert len(rows) == 10 and rows[0].score == 1 and all(a.score >= b.score for a, b in zip(rows, rows[1:]))
    assert all(0 <= r.score <= 1 and r.total == rows[0].total for r in rows)
    second = hybrid.search(projects, vectors, "small rings", limit=10, page=2, embed=lambda t: one).collect()
    assert not {r.id for r in rows} & {r.id for r in second}
    # an empty query keeps the neighbours alone
    empty = hybrid.search(projects, vectors, '""', limit=5, embed=lambda t: one).collect()
    shown = {r.id for r in live(projects).where(F.length("description") > 50).collect()}
    assert empty and {r.id for r in empty} <= shown
    assert hybrid.search(projects, None, "zzzzqq", limit=5).count() == 0
    mine = hybrid.search(projects, vectors, "bolt user:user1", limit=50, embed=lambda t: one).collect()
    assert mine and all("user1" in f"{r.github_username} {r.inferred_username} {r.code_url}".lower() for r in mine)


def test_answer(projects, spark):
    got = hybrid.answer(projects, None, '"small ring"', limit=3)
    assert len(got.envelope.data) == 3 and got.envelope.total >= 3 and got.envelope.per_page == 3 and got.query_ms > 0 and got.embeddings_ms == 0
    assert "score" in got.envelope.data[0] and hybrid.answer(projects, None, "zzzzqq").envelope.total == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [-1.0, 0.0])], "project_id int, embedding array<float>")
    assert [(r.id, round(r.distance, 6)) for r in hybrid.nearest(df, [2.0, 0.0], 10).collect()] == [(1, 0.0), (2, 1.0), (5, 2.0)]
    assert hybrid.nearest(df, [0.0, 0.0], 10).count() == 0


def test_lookups(projects, spark):
    assert project(projects, "rec00000171").first().id == 171 and project(projects, 17).count() == 0 and project(projects, "999999999999").count() == 0
    now = [0.0]
    cache = MediaCache(projects, lambda: now[0])
    assert cache.get(17).endswith("/17.png") and cache.get(18) is None and cache.get("unknown") is None
    cache.projects = None  # held answers need no table
    assert cache.get("17").endswith("/17.png")
    with pytest.raises(NotFound):
        cache.redirect(18)
    now[0] = 3600.0
    with pytest.raises(AttributeError):
        cache.get(17)
    assert healthy(spark)


def test_words_tried_first_change_no_token(spark):
    draw = random.Random(5)
    parts = ["ab", "1", "é", "٣", "-", ".", "_", "%", "+", "@", ":", "/", " ", "://", "foo.com", "a@b.co", "well-known", "com5"]
    texts = [("".join(draw.choices(parts, k=draw.randint(0, 14))),) for _ in range(5000)]
    cut = lambda pattern: F.regexp_extract_all(F.lower("t"), F.lit(pattern), F.lit(0))
    df = spark.createDataFrame(texts, "t string")
    assert df.where(~cut(english.TOKEN).eqNullSafe(cut(english._SPARK_TOKEN))).count() == 0
