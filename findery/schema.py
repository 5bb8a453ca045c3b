"""Tables, fields and limits of the project catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 7  # of the schema and of what lexemes are; a catalogue's path carries it

_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType()),
    "lexemes": T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("pos", T.IntegerType())])),
}


def _table(columns: str) -> T.StructType:
    """Built without a session, so that workers can import this module."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in columns.split(","))])


PROJECTS = _table(
    "id int, airtable_id string, ysws string, approved_at bigint, code_url string, country string, demo_url string, "
    "description string, github_username string, hours int, true_hours double, media_url string, has_media boolean, "
    "github_stars int, display_name string, archived_demo string, archived_repo string, created_at timestamp, "
    "updated_at timestamp, deleted_at timestamp, inferred_username string, inferred_repo string, "
    "tsv lexemes"  # of the search text, with positions; made when a row changes, not when it is searched
)
EMBEDDINGS = _table(
    "project_id int, embedding vector, model string, created_at timestamp, updated_at timestamp"
)

#: What is shown of a project. Media, tombstone and bookkeeping columns are not.
PUBLIC = [
    "id", "airtable_id", "ysws", "approved_at", "code_url", "country", "demo_url", "description", "github_username", "hours",
    "true_hours", "has_media", "github_stars", "display_name", "archived_demo", "archived_repo", "inferred_repo", "inferred_username",
]

#: Fields that a query may name: (column, kind).
FIELDS = {
    **{f: (f, "text") for f in (
        "airtable_id", "ysws", "country", "description", "github_username", "display_name", "code_url", "demo_url", "archived_demo",
        "archived_repo", "inferred_repo", "inferred_username",
    )},
    **{f: (f, "int") for f in ("hours", "github_stars", "approved_at")},
    "true_hours": ("true_hours", "float"),
    **{f: (f, "timestamp") for f in ("created_at", "updated_at")},
    "has_media": ("media_url", "bool"),
}

NULL_OPS = {"is_null", "is_not_null"}
ORDER_OPS = {"gt", "gte", "lt", "lte"}
PATTERN_OPS = {"contains", "not_contains", "starts_with", "ends_with"}
OPS = {"eq", "neq"} | NULL_OPS | ORDER_OPS | PATTERN_OPS
LEGAL = {
    "text": {"eq", "neq"} | NULL_OPS | PATTERN_OPS,
    "int": {"eq", "neq"} | NULL_OPS | ORDER_OPS,
    "float": {"eq", "neq"} | NULL_OPS | ORDER_OPS,
    "timestamp": {"eq", "neq"} | NULL_OPS | ORDER_OPS,
    "bool": {"eq", "neq"} | NULL_OPS,
}

#: Page sizes: default by endpoint, and the most for all.
PAGE = {"query": 25, "search": 10, "recent": 20}
PAGE_MOST = 100
#: Candidates of a branch: multiple of the page size, least and most.
CAPS = {
    "fts": (10, 100, 2000),
    "phrase": (8, 80, 1500),
    "semantic": (8, 80, 1250),
    "trigram": (15, 150, 3000),
    "literal": (12, 120, 2500),
}
WEIGHTS = {"fts": 0.7, "semantic": 0.2, "trigram": 0.1}
TRIGRAM_THRESHOLD = 0.3
EMBED_LETTERS, SHOW_LETTERS = 35, 50  # descriptions of so many are embedded, of more are found by vector
EMBED_BATCH = 128
EMBED_TTL, MEDIA_TTL = 86_400, 3_600


class BadRequest(ValueError):
    """What the caller asked for is not legal."""


class NotFound(LookupError):
    """No such row."""
