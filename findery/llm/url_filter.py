"""URL filters by a temporal list join (operator 9). DataFrame functions only.

Lists are dated: a record says that from its time on an entry (a host, or a host with a path) is blocked,
allowed or dropped. Each record becomes a validity interval that ends where the next record of the same list
and entry begins. A capture is expanded to the entries that could cover it (its host's suffixes, a single label
too, with the path's leading segments, as deep as the deepest entry) and joined to the intervals as of
its fetch time. Hosts are compared without regard to case and final dots, paths with it. The most specific active entry decides: more host labels, then more path segments; among
equals an allowing one, then the first list, then the first category.

Both sides meet in an equi-join on the entry that Spark may broadcast by its own measure or split where a
host is hot; nothing is collected.

Defined results: a null or unreadable url, or a null fetch time, matches nothing and is allowed; records with a
null list, entry, action or time are ignored; of records of one list, entry and time the last by action and
category in sort order holds; repeated rows give one result each; an empty list allows all, an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

DAY = 86_400
#: The fixture list: list, entry, action, category, day from which it holds.
LIST = [
    ("spam", "spam-farm.example.org", "block", "spam", "2024-02-01"),
    ("spam", "spam-farm.example.org", "drop", "spam", "2024-07-15"),
    ("spam", "spam-farm.example.org", "block", "spam", "2024-10-01"),
    ("spam", "cheap-pills.example.com", "block", "pharma", "2023-11-20"),
    ("spam", "cheap-pills.example.com/en", "allow", "pharma", "2024-05-05"),
    ("spam", "cheap-pills.example.com/en", "drop", "pharma", "2024-09-09"),
    ("adult", "blog.tionsh.example.com", "block", "adult", "2024-03-01"),
    ("adult", "blog.tionsh.example.com", "allow", "adult", "2024-06-01"),
    ("adult", "blog.tionsh.example.com/es", "block", "adult", "2024-04-15"),
    ("regional", "example.net/es", "block", "region", "2024-01-10"),
    ("regional", "example.net/es", "drop", "region", "2024-12-01"),
    ("regional", "ththan.example.net", "allow", "region", "2024-01-01"),
    ("regional", "tionble.example.org", "block", "region", "2025-06-01"),
    ("regional", "Tionble.Example.org/DE", "block", "region", "2024-01-01"),
    ("suffixes", "org", "allow", "suffix", "2024-08-01"),
    ("suffixes", "zip", "block", "suffix", "2024-01-01"),
]
#: Captures of the fixture are spread over a year by their page id: seconds since 1970.
FETCH_START, FETCH_STEP, FETCH_SPAN = 1_704_067_200, 7_919_000, 31_536_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or a final dot; '' if there is none."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:@]*+)", 1)
    return F.regexp_replace(F.lower(raw), r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*+://[^/?#]*+([^?#]*+)", 1)


def depth(entry: Column) -> Column:
    return F.size(F.split(entry, "/")) - 1


def labels(entry: Column) -> Column:
    return F.size(F.split(F.split(entry, "/")[0], r"\."))


def normal_entry(entry: Column) -> Column:
    """The host in lower case without final dots, then the path as it is without empty segments."""
    parts = F.filter(F.split(entry, "/"), lambda x: x != "")
    host = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"\.+$", "")
    return F.array_join(F.concat(F.array(host), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def intervals(records: DataFrame) -> DataFrame:
    """(list, entry, action, category, since, until) of blocking and allowing records; until is null while open."""
    clean = records.select("list", normal_entry(F.col("entry")).alias("entry"), "action", F.coalesce("category", F.lit("")).alias("category"), "since")
    clean = clean.where(F.col("list").isNotNull() & F.col("entry").isNotNull() & F.col("action").isNotNull() & F.col("since").isNotNull())
    one = clean.groupBy("list", "entry", "since").agg(F.max(F.struct("action", "category")).alias("last"))
    later = F.lead("since").over(Window.partitionBy("list", "entry").orderBy("since"))
    dated = one.select("list", "entry", "last.*", "since", later.alias("until"))
    return dated.where(F.col("action").isin("block", "allow"))


def entries_of(host: Column, path: Column, deepest: Column) -> Column:
    """Every entry that would cover a host and path."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    steps = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, deepest)
    heads = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.concat(F.when(n > 0, F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(steps, 1, n), "/")))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h))))


def filter_captures(captures: DataFrame, records: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row a capture: blocked, and the deciding entry with its list, category and interval."""
    spans = intervals(records)
    deepest = spans.agg(F.coalesce(F.max(depth(F.col("entry"))), F.lit(0))).scalar()
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).cast("long").alias("_at"))
    rows = rows.withColumn("_host", host_of(F.col("_url")))
    keyed = rows.distinct().where(F.col("_at").isNotNull() & (F.col("_host") != "")).withColumn("deepest", deepest)
    keyed = keyed.select("_id", "_url", "_at", F.explode(F.array_distinct(entries_of(F.col("_host"), path_of(F.col("_url")), F.col("deepest")))).alias("entry"))
    active = keyed.join(spans, "entry").where((F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    # the smallest in this order decides
    order = F.struct(
        (-labels(F.col("entry"))).alias("labels"), (-depth(F.col("entry"))).alias("depth"), "action", "list", "category", "entry", "since", "until"
    )
    decided = active.groupBy("_id", "_url", "_at").agg(F.min(order).alias("d"), F.count("*").alias("n"))
    decided = decided.select(F.col("_id").alias("i"), F.col("_url").alias("u"), F.col("_at").alias("t"), "d", "n")
    same = F.col("_id").eqNullSafe(F.col("i")) & (F.col("_url") == F.col("u")) & (F.col("_at") == F.col("t"))
    return rows.join(decided, same, "left").select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_at").alias(time_col), F.nullif("_host", F.lit("")).alias("host"),
        F.coalesce(F.col("d.action") == "block", F.lit(False)).alias("blocked"), F.col("d.list").alias("list"), F.col("d.entry").alias("entry"),
        F.col("d.category").alias("category"), F.col("d.since").alias("since"), F.col("d.until").alias("until"),
        F.coalesce("n", F.lit(0)).alias("n_active"),
    )


def fixture_list(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(LIST, "list string, entry string, action string, category string, day string")
    return rows.withColumn("since", F.unix_date(F.to_date("day")).cast("long") * DAY)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    at = F.lit(FETCH_START) + (F.col("page_id") * FETCH_STEP) % FETCH_SPAN
    captures = table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))
    return filter_captures(captures, fixture_list(spark))


_VALUES = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in LIST)
ORACLE = rf"""
WITH rec AS (SELECT l AS list, lower(split_part(e, '/', 1)) || substr(e, length(split_part(e, '/', 1)) + 1) AS entry, a AS action, c AS category, epoch(CAST(d AS TIMESTAMP))::BIGINT AS since FROM (VALUES {_VALUES}) AS v(l, e, a, c, d)),
iv AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, entry ORDER BY since) AS until FROM rec) WHERE action IN ('block', 'allow')),
cap AS (SELECT page_id, url, {FETCH_START} + (page_id * {FETCH_STEP}) % {FETCH_SPAN} AS fetched_at,
  lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]*)', 1)) AS host,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT cap.*, iv.*, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(split_part(entry, '/', 1), '.')) DESC,
    len(string_split(entry, '/')) DESC, action, list, category, entry) AS r, count(*) OVER (PARTITION BY page_id) AS n
  FROM cap JOIN iv ON since <= fetched_at AND (until IS NULL OR fetched_at < until)
    AND (host = split_part(entry, '/', 1) OR ends_with(host, '.' || split_part(entry, '/', 1)))
    AND (len(string_split(entry, '/')) = 1 OR starts_with(path || '/', '/' || split_part(entry, '/', 2) || '/')))
SELECT cap.page_id, cap.url, cap.fetched_at, cap.host, coalesce(action = 'block', false) AS blocked, list, entry, category, since, until, coalesce(n, 0) AS n_active
FROM cap LEFT JOIN (SELECT * FROM j WHERE r = 1) j USING (page_id)
"""
