"""Scores of one row against a query: phrase, literal, trigram and vector."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_normalise, similarity
from ..schema import TRIGRAM_THRESHOLD

TRIGRAM_COLUMNS = ["display_name", "ysws", "github_username", "inferred_repo", "inferred_username"]
#: What a phrase earns where it is found.
PHRASE_COLUMNS = [("display_name", 1.0), ("description", 0.75), ("search_repo", 1.0), ("search_username", 0.75)]
#: Levels of a literal match; the best one counts.
EXACT = [("inferred_repo", 4.0), ("display_name", 3.5), ("ysws", 3.0)]
PREFIX = [("search_repo", 2.4), ("display_name", 2.2), ("search_username", 2.0)]
SUBSTRING = [("search_repo", 1.5), ("display_name", 1.35), ("search_username", 1.2), ("code_url", 1.0), ("demo_url", 1.0)]


def quoted_phrases(query: str) -> list[str]:
    return re.findall(r'"([^"]+)"', query)


def raw_query(query: str) -> str:
    """The query without quotes, in lower case, trimmed of spaces."""
    return query.replace('"', "").strip(" ").lower()


def phrase_score(phrases: list[str]) -> Column | None:
    """The sum over the phrases; None without a phrase."""
    if not phrases:
        return None
    part = lambda c, w, p: F.when(F.lower(F.coalesce(c, F.lit(""))).contains(p.lower()), w).otherwise(0.0)
    return reduce(add, [part(c, w, p) for p in phrases for c, w in PHRASE_COLUMNS])


def literal_score(raw: str) -> Column:
    """Greatest level that the raw query reaches, 0 if none or if it is empty. Its wildcards count in prefixes."""
    if not raw:
        return F.lit(0.0)
    level = lambda test, w: F.when(test, w).otherwise(0.0)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    prefix = like_normalise(raw) + "%"
    return F.greatest(
        *[level(low(c) == raw, w) for c, w in EXACT],
        *[level(low(c).like(prefix), w) for c, w in PREFIX],
        *[level(low(c).contains(raw), w) for c, w in SUBSTRING],
    )


def trigram_score(query: str) -> Column:
    """Greatest similarity over five columns; 0 where all are null."""
    return F.coalesce(F.greatest(*[similarity(F.col(c), query) for c in TRIGRAM_COLUMNS]), F.lit(0.0))


def trigram_matches(rows: DataFrame, query: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """The rows that match with their score, generated so that it is worked out once a row."""
    return rows.select("*", F.explode(F.array(trigram_score(query))).alias("score")).where(F.col("score") >= threshold)


def trigram_match(query: str, threshold: float = TRIGRAM_THRESHOLD) -> Column:
    """Whether any of the columns reaches the threshold."""
    return F.coalesce(reduce(or_, [F.coalesce(similarity(F.col(c), query) >= threshold, F.lit(False)) for c in TRIGRAM_COLUMNS]), F.lit(False))


def cosine_distance(embedding: Column, query: list[float]) -> Column:
    """1 - cosine, in double precision; null for a vector of zeros or of another dimension."""
    norm = math.sqrt(sum(x * x for x in query))
    if not norm:
        return F.lit(None).cast("double")
    wanted = F.array(*[F.lit(float(x) / norm) for x in query])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    dot = total(F.zip_with(embedding, wanted, lambda a, b: a.cast("double") * b))
    length = F.sqrt(total(F.transform(embedding, lambda a: a.cast("double") * a.cast("double"))))
    return F.when(F.size(embedding) == len(query), 1 - F.try_divide(dot, length))


def semantic_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))
