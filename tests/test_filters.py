"""The filter language: legality, value parsing, null logic, paging and envelopes."""

import pytest
from pyspark.sql import functions as F

from findery.operators.filters import (
    Envelope, Filter, Request, envelope, matching, page_of, parse_bool, parse_float, parse_int, parse_text, parse_timestamp, predicate, run_query,
    sanitise_filters,
)
from findery.schema import FIELDS, LEGAL, OPS, PUBLIC, BadRequest
from findery.sources import fixtures

SF = "/root/testdata/sf0.001"
VALUES = {"text": "x", "int": 1, "float": 1.5, "timestamp": "2024-01-01", "bool": True}


@pytest.fixture(scope="module")
def projects(spark):
    return fixtures.projects(spark, SF).persist()


@pytest.mark.parametrize("field", ["ysws", "hours", "true_hours", "created_at", "has_media"])
def test_matrix(spark, field):
    kind = FIELDS[field][1]
    for op in OPS:
        if op in LEGAL[kind]:
            predicate(Filter(field, op, VALUES[kind]))
        else:
            with pytest.raises(BadRequest):
                predicate(Filter(field, op, VALUES[kind]))


def test_values():
    assert [parse_text(v) for v in ("a", 5, True)] == ["a", "5", "true"]
    assert [parse_int(v) for v in (3, "-7", "+2")] == [3, -7, 2]
    assert [parse_float(v) for v in (3, "2.5", "inf", ".5", "1e3")] == [3.0, 2.5, float("inf"), 0.5, 1000.0]
    assert [parse_bool(v) for v in (True, "1", "false")] == [True, True, False]
    for parse, bad in [(parse_int, (3.0, "3.0", " 5", True, None, 2**63, "1_0")), (parse_float, ("x", True, " 1", "1_0")), (parse_bool, (1, "True", "yes")), (parse_timestamp, ("now", "infinity", ""))]:
        for v in bad:
            with pytest.raises(BadRequest):
                parse(v)


def test_errors_come_in_order(spark):
    for f in (Filter("id", "eq", 1), Filter("ysws", "like", "x"), Filter("ysws", "gt", "x"), Filter("hours", "eq"), Filter("hours", "eq", "x")):
        with pytest.raises(BadRequest):
            predicate(f)
    with pytest.raises(BadRequest, match="needs a value"):
        predicate(Filter("hours", "gt", None))


def test_nulls_are_not_unequal(projects):
    n = matching(projects, []).count()
    same, other = (matching(projects, [Filter("country", op, "en")]).count() for op in ("eq", "neq"))
    null = matching(projects, [Filter("country", "is_null")]).count()
    assert null > 0 and same + other + null == n
    assert matching(projects, [Filter("country", "not_contains", "zz")]).count() == n - null


def test_wildcards_match_themselves(spark):
    rows = [(1, "50%"), (2, "500"), (3, "a_b"), (4, "aXb"), (5, "c\\d"), (6, None)]
    df = spark.createDataFrame(rows, "id int, ysws string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    find = lambda op, v: [r.id for r in matching(df, [Filter("ysws", op, v)]).orderBy("id").collect()]
    assert find("contains", "0%") == [1] and find("contains", "_") == [3] and find("ends_with", "\\D") == [5] and find("starts_with", "A") == [3, 4]


def test_paging(projects):
    assert page_of(None, None, "query") == (25, 1, 0) and page_of(500, 3, "search") == (100, 3, 200) and page_of(10, -2, "recent") == (10, 1, 0)
    with pytest.raises(BadRequest):
        page_of(-1, 1, "query")
    whole = [r.id for r in matching(projects, []).orderBy(F.col("hours").asc_nulls_last(), "id").collect()]
    paged = [r.id for p in (1, 2) for r in run_query(projects, Request([], "hours", "AsC", 100, p)).collect()]
    assert paged == whole
    past = Request([], limit=10, page=10_000)
    assert envelope(run_query(projects, past), 10, 10_000, "query") == Envelope([], 0, 10_000, 10)
    got = envelope(run_query(projects, Request([], limit=3)), 3, None, "query")
    assert got.total == len(whole) and list(got.data[0]) == PUBLIC


def test_requests():
    r = Request.from_json('{"filters":[{"field":"hours","op":"gt","value":3},{"field":"ysws","op":"is_null"}],"limit":5}')
    assert r.filters == [Filter("hours", "gt", 3), Filter("ysws", "is_null")] and r.limit == 5
    for bad in ('{"filters":[{"op":"eq"}]}', '{"where":1}'):
        with pytest.raises(BadRequest):
            Request.from_json(bad)


def test_forms():
    raw = [{"field": "ysws", "op": "eq", "value": "gone"}, {"field": "ysws", "op": "contains", "value": " x "}, {"field": "hours", "op": "gt", "value": "abc"}, {"field": "country", "op": "eq", "value": " "}]
    raw += [{"field": "has_media", "op": "eq", "value": "yes"}, {"field": "country", "op": "is_null", "value": ""}, {"field": "true_hours", "op": "lt", "value": "2.5"}]
    assert sanitise_filters(raw, {"here"}) == [
        Filter("ysws", "contains", "x"), Filter("hours", "gt", 0), Filter("has_media", "eq", False), Filter("country", "is_null"), Filter("true_hours", "lt", 2.5),
    ]


def test_plan_is_pushed_down(spark, tmp_path, projects):
    projects.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    rows = run_query(df, Request([Filter("github_stars", "gte", 10)], limit=5))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(github_stars,10)" in plan and "TakeOrderedAndProject" in plan and "Window" not in plan


def test_collated_order(spark):
    from findery.operators.filters import BadRequest, order_of

    names = ["zebra", "Zoo", "\u00e9tage", "Etage", "eta", "\u00c4pfel", "apfel", "zoo", None]
    df = spark.createDataFrame(list(enumerate(names)), "id int, display_name string")
    got = lambda *how: [r.display_name for r in df.orderBy(*order_of("display_name", *how)).collect()]
    assert got("asc", "UNICODE") == ["apfel", "\u00c4pfel", "eta", "Etage", "\u00e9tage", "zebra", "zoo", "Zoo", None]
    assert got("asc") == ["Etage", "Zoo", "apfel", "eta", "zebra", "zoo", "\u00c4pfel", "\u00e9tage", None]
    assert got("desc", "UNICODE_CI_AI")[:3] == ["Zoo", "zoo", "zebra"]
    with pytest.raises(BadRequest):
        order_of("display_name", "asc", "x; y")
