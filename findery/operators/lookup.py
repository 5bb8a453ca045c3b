"""Point lookups, recent rows, programmes, media and the search for a user alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MEDIA_TTL, PUBLIC, NotFound
from .filters import live, page_of, user_predicate


def _key(value: str | int):
    """An integer of 32 bits is an id, anything else an external id."""
    try:
        number = int(str(value))
        if str(value).strip() == str(value) and -(2**31) <= number < 2**31 and "_" not in str(value):
            return F.col("id") == number
    except ValueError:
        pass
    return F.col("airtable_id") == str(value)


def project(projects: DataFrame, key: str | int) -> DataFrame:
    """No row or one."""
    return live(projects).where(_key(key)).select(*PUBLIC).limit(1)


def recent(projects: DataFrame, limit: int | None = None) -> DataFrame:
    size, *_ = page_of(limit, 1, "recent")
    return live(projects).orderBy(F.col("created_at").desc_nulls_first(), "id").limit(size).select(*PUBLIC)


def programmes(projects: DataFrame) -> DataFrame:
    """Names of all programmes, those of deleted rows too."""
    return projects.select("ysws").distinct()


def complete(names: DataFrame, typed: str) -> DataFrame:
    """Names that hold what was typed, in any case; all of them for a blank."""
    needle = typed.strip().lower()
    return names.where(F.lower("ysws").contains(needle)) if needle else names


def media(projects: DataFrame, key: str | int) -> DataFrame:
    """The media url, of deleted rows too; no row where the project is unknown."""
    return projects.where(_key(key)).select("media_url").limit(1)


class MediaCache:
    """Look-aside cache of media urls; unknown projects and missing urls are remembered as None."""

    def __init__(self, projects: DataFrame, clock, ttl: int = MEDIA_TTL) -> None:
        self.projects, self.clock, self.ttl = projects, clock, ttl
        self.held: dict[str, tuple[float, str | None]] = {}

    def get(self, key: str | int) -> str | None:
        name, now = str(key), self.clock()
        if name in self.held and self.held[name][0] > now:
            return self.held[name][1]
        row = media(self.projects, key).first()
        url = row["media_url"] if row else None
        self.held[name] = (now + self.ttl, url)
        return url

    def redirect(self, key: str | int) -> str:
        url = self.get(key)
        if url is None:
            raise NotFound(f"no media of {key}")
        return url


def user_search(projects: DataFrame, user: str, limit: int | None = None, page: int | None = None) -> DataFrame:
    """Projects of a user, newest approval first and unapproved before all, each with score 1."""
    size, _, offset = page_of(limit, page, "search")
    found = live(projects).where(user_predicate(user))
    order = [F.col("approved_at").desc_nulls_first(), F.col("id")]
    rows = found.orderBy(*order).offset(offset).limit(size).select(*PUBLIC, F.lit(1.0).alias("score"))
    return rows.withColumn("total", found.agg(F.count("*")).scalar())


def healthy(spark) -> bool:
    return spark.range(1).count() == 1
