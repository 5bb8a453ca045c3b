"""Presentation of results, as columns."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIELDS, LEGAL, OPS, PAGE_MOST

LOW_SCORE = 0.25


def score_bracket(score: Column) -> Column:
    """1 to 4: up to a quarter, a half, three quarters, and beyond; null is 1."""
    return F.when(score.isNull() | (score <= 0.25), 1).when(score <= 0.5, 2).when(score <= 0.75, 3).otherwise(4)


def number_text(x: Column) -> Column:
    """Whole numbers without decimals, others with one."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.1f", x))


def hours_label(true_hours: Column, hours: Column) -> Column:
    """Hours spent, with what was claimed where that differs."""
    spent, claimed = number_text(true_hours), number_text(hours.cast("double"))
    return (
        F.when(true_hours.isNull() & hours.isNull(), "—")
        .when(true_hours.isNull(), F.concat(claimed, F.lit(" h")))
        .when(hours.isNull() | (true_hours == hours), F.concat(spent, F.lit(" h")))
        .otherwise(F.concat(spent, F.lit(" h ("), claimed, F.lit(" h claimed)")))
    )


def title(inferred_repo: Column, id_: Column) -> Column:
    return F.coalesce(inferred_repo, F.concat(F.lit("Project #"), id_.cast("string")))


def truncate(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def preview(text: Column, n: int = 120) -> Column:
    """White space collapsed, cut with three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.left(flat, F.lit(n))), F.lit("..."))).otherwise(flat)


def user_label(github: Column, inferred: Column, display: Column) -> Column:
    """The first user name that is not empty, with the display name."""
    full = lambda c: F.nullif(c, F.lit(""))
    name = F.coalesce(full(inferred), full(github))
    return F.when(name.isNull(), F.coalesce(full(display), F.lit("—"))).when(full(display).isNull(), name).otherwise(F.concat(display, F.lit(" ("), name, F.lit(")")))


def approved_day(approved_at: Column) -> Column:
    """ISO date; null and 0 are a dash."""
    return F.when(approved_at.isNull() | (approved_at == 0), "—").otherwise(F.date_format(F.timestamp_seconds(approved_at), "yyyy-MM-dd"))


def media_path(id_: Column) -> Column:
    return F.concat(F.lit("/api/v1/media/"), id_.cast("string"), F.lit("/r"))


def hide_low_scores(rows: DataFrame, show_all: bool = False, least: float = LOW_SCORE) -> DataFrame:
    """Rows of at least the score, or all of them if none has it."""
    if show_all:
        return rows
    best = rows.agg(F.coalesce(F.max("score"), F.lit(0.0))).scalar()
    return rows.withColumn("_best", best).where((F.col("score") >= least) | (F.col("_best") < least)).drop("_best")


def page_count(total: int, per_page: int) -> int:
    return max(1, -(-total // per_page))


def clamp_page(page: int, total: int, per_page: int) -> int:
    return min(max(1, page), page_count(total, per_page))


def encode_view(state: dict) -> str:
    """A view as text for a link."""
    return base64.urlsafe_b64encode(json.dumps(state, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_view(text: str) -> dict:
    """The view of a link, made legal: unknown fields and operators are replaced, one sort key, page size 1 to 100."""
    raw = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    filters = []
    for f in raw.get("filters") or []:
        name = f.get("field") if f.get("field") in FIELDS else "ysws"
        legal = LEGAL[FIELDS[name][1]]
        op = f.get("op") if f.get("op") in legal else next(o for o in sorted(OPS) if o in legal and o == "eq")
        filters.append({"field": name, "op": op, "value": f.get("value")})
    sort = [s for s in raw.get("sort") or [] if s.get("field") in FIELDS][:1]
    return {"filters": filters, "sort": sort, "per_page": min(max(1, int(raw.get("per_page") or 50)), PAGE_MOST), "page": max(1, int(raw.get("page") or 1))}
