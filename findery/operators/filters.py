"""The filter, sort and page language: requests become columns, with errors in the order of the request."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_escape, like_normalise
from ..schema import FIELDS, LEGAL, NULL_OPS, OPS, PAGE, PAGE_MOST, PUBLIC, BadRequest


def live(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("deleted_at").isNull())


def parse_text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def parse_int(value) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, str)) or not re.fullmatch(r"[+-]?[0-9]+", str(value)):
        raise BadRequest(f"not an integer: {value!r}")
    number = int(value)
    if not -(2**63) <= number < 2**63:
        raise BadRequest(f"integer out of range: {value!r}")
    return number


def parse_float(value) -> float:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    plain = r"[+-]?(?:inf(?:inity)?|nan|[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?)"
    if isinstance(value, str) and re.fullmatch(plain, value, re.I | re.A):
        return float(value)
    raise BadRequest(f"not a number: {value!r}")


def parse_bool(value) -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value in ("true", "1", "false", "0"):
        return value in ("true", "1")
    raise BadRequest(f"not a boolean: {value!r}")


def parse_timestamp(value) -> datetime:
    """ISO dates and times; without an offset they are UTC. Words such as 'now' are refused."""
    try:
        at = datetime.fromisoformat(parse_text(value).strip())
    except ValueError:
        raise BadRequest(f"not a timestamp: {value!r}") from None
    return at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)


PARSE = {"text": parse_text, "int": parse_int, "float": parse_float, "bool": parse_bool, "timestamp": parse_timestamp}
COMPARE = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "contains": lambda c, v: c.ilike(f"%{v}%"),
    "not_contains": lambda c, v: ~c.ilike(f"%{v}%"),
    "starts_with": lambda c, v: c.ilike(f"{v}%"),
    "ends_with": lambda c, v: c.ilike(f"%{v}"),
}


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object = None


def predicate(f: Filter) -> Column:
    if f.field not in FIELDS:
        raise BadRequest(f"unknown field: {f.field}")
    if f.op not in OPS:
        raise BadRequest(f"unknown operator: {f.op}")
    name, kind = FIELDS[f.field]
    if f.op not in LEGAL[kind]:
        raise BadRequest(f"{f.op} is not for {kind} field {f.field}")
    column = F.col(name)
    if f.op in NULL_OPS:
        return column.isNull() if f.op == "is_null" else column.isNotNull()
    if f.value is None:
        raise BadRequest(f"{f.op} on {f.field} needs a value")
    value = PARSE[kind](f.value)
    if kind == "bool":
        return column.isNotNull() if value == (f.op == "eq") else column.isNull()
    if kind == "timestamp":
        value = F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz").cast("timestamp")
    elif kind == "float":
        value = F.lit(value)
    elif kind == "text" and f.op not in ("eq", "neq"):
        value = like_escape(value)
    return COMPARE[f.op](column, value)


def user_predicate(user: str) -> Column:
    """Any of five columns holds the user's pattern; its wildcards are kept."""
    pattern = f"%{like_normalise(user)}%"
    columns = ("github_username", "inferred_username", "display_name", "code_url", "inferred_repo")
    return reduce(or_, [F.col(c).ilike(pattern) for c in columns])


@dataclass(frozen=True)
class Request:
    filters: list[Filter] = field(default_factory=list)
    order_by: str | None = None
    sort_direction: str | None = None
    limit: int | None = None
    page: int | None = None
    collation: str | None = None

    @classmethod
    def from_json(cls, text: str) -> Request:
        raw = json.loads(text)
        unknown = set(raw) - {"filters", "order_by", "sort_direction", "limit", "page", "collation"}
        if unknown:
            raise BadRequest(f"unknown keys: {sorted(unknown)}")
        try:
            filters = [Filter(f["field"], f["op"], f.get("value")) for f in raw.get("filters") or []]
        except (KeyError, TypeError, AttributeError):
            raise BadRequest("a filter needs a field and an op") from None
        return cls(filters, raw.get("order_by"), raw.get("sort_direction"), raw.get("limit"), raw.get("page"), raw.get("collation"))


def page_of(limit: int | None, page: int | None, endpoint: str) -> tuple[int, int, int]:
    """(limit, page, offset)."""
    size = PAGE[endpoint] if limit is None else limit
    if size < 0:
        raise BadRequest("limit is negative")
    size, number = min(size, PAGE_MOST), max(1, page or 1)
    return size, number, (number - 1) * size


def order_of(order_by: str | None, direction: str | None, collation: str | None = None) -> list[Column]:
    """Nulls last either way; the id settles ties. Text is ordered by its bytes, or by a collation of Spark's such as UNICODE."""
    if order_by is not None and order_by not in FIELDS:
        raise BadRequest(f"unknown field: {order_by}")
    name, kind = FIELDS[order_by or "approved_at"]
    column = F.col(name)
    if collation and kind in ("text", "bool"):  # a flag is ordered by the url behind it
        if not re.fullmatch("[A-Za-z0-9_]+", collation):
            raise BadRequest(f"no collation: {collation}")
        column = F.collate(column, collation)
    return [column.asc_nulls_last() if (direction or "").lower() == "asc" else column.desc_nulls_last(), F.col("id").asc()]


def matching(projects: DataFrame, filters: list[Filter]) -> DataFrame:
    return reduce(lambda df, p: df.where(p), [predicate(f) for f in filters], live(projects))


def run_query(projects: DataFrame, request: Request) -> DataFrame:
    """The page's public columns and, on every row, the total before paging."""
    found = matching(projects, request.filters)
    size, _, offset = page_of(request.limit, request.page, "query")
    rows = found.orderBy(*order_of(request.order_by, request.sort_direction, request.collation)).offset(offset).limit(size).select(*PUBLIC)
    # one narrow count beside the top-k, in place of a window over all rows in one partition
    return rows.withColumn("total", found.agg(F.count("*")).scalar())


@dataclass(frozen=True)
class Envelope:
    data: list[dict]
    total: int
    page: int
    per_page: int


def envelope(rows: DataFrame, limit: int | None, page: int | None, endpoint: str) -> Envelope:
    """At most one page of rows; an empty page says total 0."""
    size, number, _ = page_of(limit, page, endpoint)
    data = [r.asDict() for r in rows.collect()]
    total = data[0]["total"] if data else 0
    return Envelope([{k: v for k, v in d.items() if k != "total"} for d in data], total, number, size)


def sanitise_filters(filters: list[dict], programmes: set[str]) -> list[Filter]:
    """What a form sends: blank values and unknown programmes go, bad numbers become 0."""
    out = []
    for f in filters:
        name, op, value = f["field"], f["op"], str(f.get("value") or "").strip()
        kind = FIELDS[name][1]
        if op in NULL_OPS:
            out.append(Filter(name, op))
            continue
        if not value or (name == "ysws" and op in ("eq", "neq") and value not in programmes):
            continue
        if kind in ("int", "float"):
            try:
                number = float(value)
                number = 0.0 if math.isnan(number) or math.isinf(number) else number
            except ValueError:
                number = 0.0
            out.append(Filter(name, op, int(number) if kind == "int" else number))
        elif kind == "bool":
            out.append(Filter(name, op, value in ("true", "1")))
        else:
            out.append(Filter(name, op, value))
    return out
