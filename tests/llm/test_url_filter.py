"""As-of decisions on small lists."""

from findery.llm.url_filter import filter_captures, intervals

LISTS = "list string, entry string, action string, category string, since long"
CAPS = "page_id long, url string, fetched_at long, host string, entry int"


def decide(spark, records, captures):
    df = filter_captures(spark.createDataFrame([(*c, "x", 1) for c in captures], CAPS), spark.createDataFrame(records, LISTS))
    return sorted((str(r.page_id), r.blocked, r.entry, r.since, r.until) for r in df.collect())


def test_intervals_and_specificity(spark):
    records = [
        ("l", "bad.com", "block", "c", 10), ("l", "bad.com", "drop", "c", 20), ("l", "BAD.com/", "block", "c", 30),
        ("l", "ok.bad.com", "allow", "c", 15), ("l", "bad.com/a/b", "allow", "c", 35), ("m", "bad.com", "allow", "c", 40),
    ]
    caps = [
        (1, "http://bad.com/", 9), (2, "http://bad.com/", 10), (3, "http://x.bad.com:80/q", 19), (4, "https://bad.com", 20),
        (5, "http://ok.bad.com/", 19), (6, "http://u@ok.bad.com./a", 14), (7, "http://bad.com/a/b/c?x", 36), (8, "http://bad.com/a/bc", 36),
        (9, "http://notbad.com/", 12), (10, "http://bad.com/z", 41),
    ]
    assert decide(spark, records, caps) == sorted([
        ("1", False, None, None, None), ("2", True, "bad.com", 10, 20), ("3", True, "bad.com", 10, 20), ("4", False, None, None, None),
        ("5", False, "ok.bad.com", 15, None), ("6", True, "bad.com", 10, 20), ("7", False, "bad.com/a/b", 35, None),
        ("8", True, "bad.com", 30, None), ("9", False, None, None, None), ("10", False, "bad.com", 40, None),
    ])


def test_odd_rows(spark):
    records = [("l", "a.com", "block", None, 5), ("l", "a.com", "block", None, 5), ("l", None, "block", "c", 5), ("l", "b.com", None, "c", 5), ("l", "c.com", "block", "c", None)]
    caps = [(1, None, 6), (2, "", 6), (3, "no url", 6), (4, "http://a.com/" + "x/" * 20_000, 6), (None, "http://a.com", 6), (5, "http://a.com", None), (6, "http://a.com", 6), (6, "http://a.com", 6)]
    got = decide(spark, records, caps)
    assert [x[:3] for x in got] == [
        ("1", False, None), ("2", False, None), ("3", False, None), ("4", True, "a.com"), ("5", False, None),
        ("6", True, "a.com"), ("6", True, "a.com"), ("None", True, "a.com"),
    ]
    assert all(not x[1] for x in decide(spark, [], caps)) and decide(spark, records, []) == []
    assert intervals(spark.createDataFrame(records, LISTS)).count() == 1


def test_case_of_paths_and_hosts_of_one_label(spark):
    records = [("l", "Bad.com/En", "block", "c", 1), ("l", "zip.", "block", "c", 1), ("l", "LOCALHOST//a/", "block", "c", 1), ("l", "ok.zip", "allow", "c", 1)]
    caps = [
        (1, "http://bad.com/En/x", 5), (2, "http://BAD.com/en/x", 5), (3, "http://file.ZIP/", 5), (4, "http://zip.com/", 5),
        (5, "http://localhost:8080/a", 5), (6, "http://localhost/A", 5), (7, "http://x.ok.zip/", 5),
    ]
    got = {x[0]: x[1:3] for x in decide(spark, records, caps)}
    assert got == {
        "1": (True, "bad.com/En"), "2": (False, None), "3": (True, "zip"), "4": (False, None), "5": (True, "localhost/a"), "6": (False, None),
        "7": (False, "ok.zip"),
    }
