"""Line frequency and the base on small documents."""

from findery.llm.quality import judge, keep_good, without_boilerplate

SCHEMA = "doc_id long, text string, source string, kept int, n_words int"


def test_boilerplate_depletes(spark):
    own = " ".join(f"word{i}" for i in range(20))
    foot = "All of these   words stand on every single page of this host here"
    rows = [(i, f"{foot}\n{own} {i}", "a") for i in range(5)]
    rows += [(10 + i, f"{foot.upper()}\nthin {i}", "a") for i in range(3)]
    rows += [(20, f"{foot}\nthin", "b")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = {r.doc_id: r.kept for r in judge(df, max_docs=3).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 10: False, 11: False, 12: False, 20: True}
    # the first holder keeps its lines
    got = {r.doc_id: r.kept for r in judge(df.where("doc_id >= 10"), max_docs=2).collect()}
    assert got == {10: True, 11: False, 12: False, 20: True}
    kept = keep_good(df, max_docs=3)
    assert kept.columns == df.columns and kept.count() == 6
    assert judge(df, max_docs=100).where("kept").count() == 9


def test_repeats_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(60):
        k = rng.choice([2, 5, 50])
        rows.append((i, " ".join(rng.choice("abcdefghij" * 5)[0] * rng.randint(1, k) for _ in range(rng.randint(0, 40))), "s", 0, 0))
    got = {r.doc_id: r.n_repeat_words for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        w = text.split()
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        hit = {p for j, g in enumerate(grams) if grams.count(g) > 1 for p in range(j, j + 5)}
        assert got[i] == len(hit), (i, text)


def test_odd_rows(spark):
    long = "w" * 200_000 + " " + "rep " * 30_000
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (None, "x y", None), (4, long, "a"), (4, "same id", "a"), (5, "five words are not enough", None), (5, "five words are not enough", None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept, r.n_repeat_words) for r in judge(df).collect())
    assert got == [
        ("1", 0, True, False, 0), ("2", 0, True, False, 0), ("3", 0, True, False, 0), ("4", 2, True, False, 0),
        ("4", 30_001, True, False, 30_000), ("5", 5, True, False, 0), ("5", 5, True, False, 0), ("None", 2, True, False, 0),
    ]
    assert judge(df.limit(0)).count() == 0


def test_boilerplate_lines_go(spark):
    own = "\n".join(" ".join(f"word{j}x{i}" for i in range(10)) for j in range(3))
    foot = "Stands  on every page"
    texts = {i: f"{foot}\n{own} {i}\n\n{foot.upper()} \nend {i}" for i in range(5)}
    rows = [(i, t, "a", 0, 0) for i, t in texts.items()] + [(4, texts[4], "a", 0, 0), (9, texts[0], "b", 0, 0), (10, None, "a", 0, 0)]
    out = without_boilerplate(spark.createDataFrame(rows, SCHEMA), max_docs=3)
    assert out.columns == ["doc_id", "text", "source", "kept", "n_words"]
    got = sorted((r.doc_id, r.text) for r in out.collect())
    # the first holder of a line and other hosts keep it; own lines in more than max_docs documents go as well
    frequent = own.split("\n")[:2]
    bare = lambda i: "\n".join(x for x in texts[i].split("\n") if x not in frequent and x.lower().split() != foot.lower().split())
    assert got == [(0, texts[0]), *((i, bare(i)) for i in (1, 2, 3, 4, 4)), (9, texts[0])]
