"""Applying a feed to the catalogue: change-detecting upsert, media update, tombstones. Pure functions of tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.english import placed_words, stemmed
from ..functions.text import search_text, with_repository
from ..schema import PROJECTS
from ..sources.shared import small_batches

COLUMNS_A = [
    "ysws", "approved_at", "code_url", "country", "demo_url", "description", "github_username", "hours", "github_stars", "display_name",
    "archived_demo", "archived_repo",
]
COLUMNS_B = ["ysws", "approved_at", "code_url", "demo_url", "github_username", "true_hours"]
ID_BLOCKS = 256


class DuplicateKey(ValueError):
    """A feed names a project twice."""


def with_lexemes(rows: DataFrame, stale: Column | None = None, letters: int | None = None) -> DataFrame:
    """rows with tsv, the lexemes of their search text; made anew only where stale, if that is given."""
    small_batches(rows.sparkSession)
    # a null text costs nothing in Python
    text = search_text(letters) if stale is None else F.when(stale, search_text(letters))
    made = stemmed(F.col("_words"))
    worded = rows.withColumn("_words", placed_words(text))
    return worded.withColumn("tsv", made if stale is None else F.when(stale, made).otherwise(F.col("tsv"))).drop("_words")


def check_keys(feed: DataFrame) -> None:
    """Every function that takes a feed does this once, unless it is told that it was done."""
    twice = feed.groupBy("airtable_id").count().where("count > 1").select("airtable_id").first()
    if twice:
        raise DuplicateKey(f"{twice[0]} is in the feed more than once")


def numbered(rows: DataFrame, start: Column, key: str) -> DataFrame:
    """rows with id: start + 1, start + 2, ... without a gap, by blocks so that no one task ranks all."""
    blocked = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(ID_BLOCKS)))
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # ID_BLOCKS rows
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    placed = blocked.withColumn("_rank", rank).join(F.broadcast(offsets), "_block")
    return placed.withColumn("id", (start + F.col("_before") + F.col("_rank")).cast("int")).drop("_block", "_rank", "_before")


def upsert(
    projects: DataFrame, feed: DataFrame, columns: list[str], now, insert_only: tuple[str, ...] = (), checked: bool = False, last_id: Column | None = None,
    fed: bool = False,
) -> DataFrame:
    """The next snapshot with a column `changed`: inserted rows, and rows where a column differs or a tombstone falls.

    Rows that do not change keep their updated_at and lexemes. insert_only columns are written for new rows alone.
    New ids follow last_id, where projects are a part of the catalogue. With fed there is a column _fed, whether the
    feed names the project, which spares soft_delete a join.
    """
    if not checked:
        check_keys(feed)
    if "tsv" not in projects.columns:  # a table from before lexemes were stored: all are made now
        projects = projects.withColumn("tsv", F.lit(None).cast(PROJECTS["tsv"].dataType))
    at = F.lit(now).cast("timestamp")
    new = feed.select(F.col("airtable_id").alias("_key"), *[F.col(c).alias(f"_{c}") for c in [*columns, *insert_only]])
    both = projects.join(new, projects["airtable_id"] == F.col("_key"), "left")
    differs = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]) | F.col("deleted_at").isNotNull()
    changed = F.col("_key").isNotNull() & differs
    kept = both.withColumns({"changed": changed, "_fed": F.col("_key").isNotNull()})
    kept = kept.withColumns(
        {c: F.when(F.col("changed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
        | {"deleted_at": F.when(~F.col("changed"), F.col("deleted_at")), "updated_at": F.when(F.col("changed"), at).otherwise(F.col("updated_at"))}
    )
    fresh = feed.join(projects.select("airtable_id"), "airtable_id", "left_anti").select("airtable_id", *columns, *insert_only)
    fresh = numbered(fresh, F.coalesce(projects.agg(F.max("id")).scalar() if last_id is None else last_id, F.lit(0)), "airtable_id")
    have = {"id", "airtable_id", *columns, *insert_only}
    defaults = {"github_stars": F.lit(0), "created_at": at, "updated_at": at}
    fresh = fresh.withColumns({f.name: defaults.get(f.name, F.lit(None)).cast(f.dataType) for f in PROJECTS if f.name not in have})
    names = [f.name for f in PROJECTS]
    yes = F.lit(True)
    out = with_repository(kept.select(*names, "changed", "_fed").union(fresh.select(*names, yes.alias("changed"), yes.alias("_fed"))))
    return with_lexemes(out, F.col("changed") | F.col("tsv").isNull()).select(*names, "changed", *(["_fed"] if fed else []))


def upsert_a(projects: DataFrame, feed: DataFrame, now, checked: bool = False, last_id: Column | None = None, fed: bool = False) -> DataFrame:
    return upsert(projects, feed, COLUMNS_A, now, insert_only=("media_url",), checked=checked, last_id=last_id, fed=fed)


def upsert_b(projects: DataFrame, feed: DataFrame, now, checked: bool = False, last_id: Column | None = None, fed: bool = False) -> DataFrame:
    return upsert(projects, feed, COLUMNS_B, now, checked=checked, last_id=last_id, fed=fed)


def update_media(projects: DataFrame, feed: DataFrame, now, checked: bool = False) -> DataFrame:
    """media_url as the feed has it, null too, for the projects it names."""
    if not checked:
        check_keys(feed)
    new = feed.select(F.col("airtable_id").alias("_key"), F.col("media_url").alias("_media"))
    both = projects.join(new, projects["airtable_id"] == F.col("_key"), "left")
    changed = F.col("_key").isNotNull() & ~F.col("media_url").eqNullSafe(F.col("_media"))
    both = both.withColumn("changed", changed).withColumns(
        {
            "media_url": F.when(F.col("changed"), F.col("_media")).otherwise(F.col("media_url")),
            "updated_at": F.when(F.col("changed"), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")),
        }
    )
    return both.withColumn("has_media", F.col("media_url").isNotNull()).drop("_key", "_media").select(*projects.columns, "changed")


def soft_delete(projects: DataFrame, feed: DataFrame, now, *, allow_empty: bool = False, scope: Column | None = None) -> DataFrame:
    """A tombstone for every live row (of the scope) that the feed lacks. An empty feed is refused unless allowed."""
    if not allow_empty and feed.isEmpty():
        raise ValueError("an empty feed would delete every project")
    if "_fed" in projects.columns:
        both, absent = projects, ~F.col("_fed")
    else:
        keys = feed.select(F.col("airtable_id").alias("_key")).distinct()
        both, absent = projects.join(keys, projects["airtable_id"] == F.col("_key"), "left"), F.col("_key").isNull()
    gone = absent & F.col("deleted_at").isNull()
    if scope is not None:
        gone = gone & scope
    at = F.lit(now).cast("timestamp")
    both = both.withColumn("changed", gone)
    both = both.withColumns({c: F.when(F.col("changed"), at).otherwise(F.col(c)) for c in ("deleted_at", "updated_at")})
    return both.select(*[c for c in projects.columns if c != "_fed"], "changed")


def changes(snapshot: DataFrame) -> int:
    """Rows that a snapshot changes; one that is written tells it by the way (Catalogue.merge)."""
    return snapshot.where("changed").count()


def apply_feed_a(projects: DataFrame, feed: DataFrame, now, *, checked: bool = False, last_id: Column | None = None, **how) -> DataFrame:
    """Upsert, then tombstones; changed if either changed the row."""
    one = upsert_a(projects, feed, now, checked, last_id, fed=True).withColumnRenamed("changed", "_first")
    return _either(soft_delete(one, feed, now, **how))


def apply_feed_b(projects: DataFrame, feed: DataFrame, now, *, checked: bool = False, last_id: Column | None = None, **how) -> DataFrame:
    one = upsert_b(projects, feed, now, checked, last_id, fed=True).withColumnRenamed("changed", "_first")
    two = _either(update_media(one, feed, now, checked=True)).withColumnRenamed("changed", "_first")
    return _either(soft_delete(two, feed, now, **how))


def _either(df: DataFrame) -> DataFrame:
    return df.withColumn("changed", F.col("changed") | F.col("_first")).drop("_first")
