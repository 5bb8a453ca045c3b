"""The two JSON feeds: landing, tolerant decoding with VARIANT, and failing on what cannot be decoded."""

from __future__ import annotations

import codecs
import json
import re
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import retried

TIMEOUTS = {"a": 120, "b": 180}


def fetch(url: str, timeout: int, open_url: Callable = urllib.request.urlopen) -> str:
    """The body of a URL, in up to three attempts; any status but success fails one."""

    def once() -> str:
        with open_url(url, timeout=timeout) as reply:
            if not 200 <= reply.status < 300:
                raise OSError(f"status {reply.status}")
            return reply.read().decode()

    return retried(once)


SPACE = re.compile(r"[\s]*")


def array_items(chunks: Iterable[str]) -> Iterator[object]:
    """The items of one JSON array that comes in pieces; no more than an item and a piece are held."""
    decoder, held, at, begun = json.JSONDecoder(), "", 0, False
    for chunk in chunks:
        held, at = held[at:] + chunk, 0
        while True:
            at = SPACE.match(held, at).end()
            if not begun:
                if at == len(held):
                    break
                if held[at] != "[":
                    raise ValueError("a feed is a JSON array")
                begun, at = True, at + 1
                continue
            if at < len(held) and held[at] == ",":
                at += 1
                continue
            if at < len(held) and held[at] == "]":
                if held[at + 1 :].strip():
                    raise ValueError("the feed goes on after its array")
                return
            try:
                item, end = decoder.raw_decode(held, at)
            except json.JSONDecodeError:
                break  # the item is not whole yet
            if end == len(held):
                break  # a number may go on in the next piece
            yield item
            at = end
    raise ValueError("the feed ends within its array")


def pieces(reply, size: int = 1 << 20) -> Iterator[str]:
    """A reply's text in pieces."""
    decode = codecs.getincrementaldecoder("utf-8")().decode
    while raw := reply.read(size):
        yield decode(raw)
    yield decode(b"", final=True)


def land(spark: SparkSession, url: str, folder: str, timeout: int, open_url: Callable = urllib.request.urlopen) -> str:
    """Fetch a feed, in up to three attempts, into a file of JSON lines in a folder of any file system; returns its path.

    The file appears whole, by a rename, so that whoever follows the folder never reads half a feed. Lines are what
    Spark splits among tasks: no task holds a feed.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    name = uuid.uuid4().hex
    draft, final = path(f"{folder}/.{name}"), path(f"{folder}/{name}.jsonl")

    def once() -> str:
        with open_url(url, timeout=timeout) as reply:
            if not 200 <= reply.status < 300:
                raise OSError(f"status {reply.status}")
            out = fs.create(draft, True)
            try:
                lines: list[str] = []
                for item in array_items(pieces(reply)):
                    lines.append(json.dumps(item, ensure_ascii=False) + "\n")
                    if len(lines) == 1000:
                        out.write("".join(lines).encode())
                        lines = []
                out.write("".join(lines).encode())
            finally:
                out.close()
        if not fs.rename(draft, final):
            raise OSError(f"{final} cannot be put in place")
        return final.toString()

    return retried(once)


def records(lines: DataFrame) -> DataFrame:
    """(record VARIANT) of rows (value): each a record of its own or an array of them."""
    v = lines.where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    many = F.schema_of_variant("v").startswith("ARRAY")
    items = F.when(many, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return v.select(F.explode(items).alias("record"))


def read_feed(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(record VARIANT) of the files of a folder: each one JSON array, or with whole=False JSON lines as `land` makes them."""
    return records(spark.read.text(path, wholetext=whole))


def _at(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "variant")


def _kind(value: Column) -> Column:
    """BIGINT, DECIMAL(...), DOUBLE, STRING, BOOLEAN, ARRAY<...>, OBJECT<...>, VOID for JSON null; null where absent.

    It walks the whole value. Where each condition of a chain begins with it, Spark works it out once for all of them.
    """
    return F.schema_of_variant(value)


def _fail(path: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"cannot decode {path}: "), F.coalesce(F.to_json(value), F.lit("absent"))))


def _absent(value: Column, required: bool, path: str, kind: str) -> Column:
    return (_fail(path, value) if required else F.lit(None)).cast(kind)


def timestamp(record: Column, path: str, required: bool = True) -> Column:
    """Epoch seconds; an ISO date is its midnight in UTC; '', 'null' and null are null."""
    v = _at(record, path)
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return (
        F.when(kind.isNull(), _absent(v, required, path, "bigint"))
        .when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when((kind == "VOID") | ((kind == "STRING") & text.isin("", "null")), F.lit(None).cast("bigint"))
        .when((kind == "STRING") & day.isNotNull(), F.unix_seconds(day))
        .otherwise(_fail(path, v).cast("bigint"))
    )


def null_int(record: Column, path: str, required: bool = True) -> Column:
    """An integer; null and any string are null."""
    v = _at(record, path)
    kind = _kind(v)
    return (
        F.when(kind.isNull(), _absent(v, required, path, "int"))
        .when(kind == "BIGINT", F.try_variant_get(v, "$", "int"))
        .when(kind.isin("VOID", "STRING"), F.lit(None).cast("int"))
        .otherwise(_fail(path, v).cast("int"))
    )


def plain_int(record: Column, path: str) -> Column:
    """An integer; absent is 0."""
    v = _at(record, path)
    kind = _kind(v)
    return (
        F.when(kind.isNull(), F.lit(0))
        .when(kind == "BIGINT", F.try_variant_get(v, "$", "int"))
        .otherwise(_fail(path, v).cast("int"))
    )


def plain_string(record: Column, path: str) -> Column:
    v = _at(record, path)
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(_fail(path, v).cast("string"))


def null_string(record: Column, path: str, required: bool = True) -> Column:
    """A string, or an array's first element if that is one; 'null' and null are null."""
    v = _at(record, path)
    kind = _kind(v)
    keep = lambda kind, path: F.when(kind == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("null")))
    return (
        F.when(kind.isNull(), _absent(v, required, path, "string"))
        .when(kind.isin("VOID", "STRING"), keep(kind, "$"))
        .when(kind.startswith("ARRAY"), keep(_kind(_at(v, "$[0]")), "$[0]"))
        .otherwise(_fail(path, v).cast("string"))
    )


def null_float(record: Column, path: str, required: bool = True) -> Column:
    """A number, or an array's first element which must be one; null and any string are null."""
    v = _at(record, path)
    kind = _kind(v)
    number = lambda kind: kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return (
        F.when(kind.isNull(), _absent(v, required, path, "double"))
        .when(number(kind), F.try_variant_get(v, "$", "double"))
        .when(kind.isin("VOID", "STRING"), F.lit(None).cast("double"))
        .when(kind.startswith("ARRAY") & F.coalesce(number(_kind(_at(v, "$[0]"))), F.lit(False)), F.try_variant_get(v, "$[0]", "double"))
        .otherwise(_fail(path, v).cast("double"))
    )


#: Levels of arrays and objects that a screenshot's URL is looked for in; deeper ones cannot be decoded.
LEVELS = 12


def first_url(value: Column, levels: int = LEVELS) -> Column:
    """The first URL in a variant: a string, an object's url, or the first in its values (by key) or items.

    One expression, unfolded as many times as there are levels. Nothing after the first URL is looked at, values that
    hold one are not asked for their kind, and an object is taken apart once: a path that is not there costs Spark more than the map.
    """
    items, by_key = F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "map<string,variant>")
    text = F.try_variant_get(value, "$", "string")
    scalar = F.when((_kind(value) == "STRING") & ~text.isin("", "null"), text)
    if not levels:
        return F.when(items.isNotNull() | by_key.isNotNull(), _fail("a URL nested so deeply", value).cast("string")).otherwise(scalar)

    def found(by_key: Column) -> Column:
        url = F.element_at(by_key, F.lit("url"))
        inner = F.coalesce(items, F.transform(F.array_sort(F.map_keys(by_key)), lambda k: F.element_at(by_key, k)))
        first = F.aggregate(inner, F.lit(None).cast("string"), lambda u, x: F.coalesce(u, first_url(x, levels - 1)))
        return F.when(_kind(url) == "STRING", F.nullif(F.try_variant_get(url, "$", "string"), F.lit(""))).otherwise(F.coalesce(first, scalar))

    return F.get(F.transform(F.array(by_key), found), F.lit(0))


def screenshot(record: Column, path: str) -> Column:
    return first_url(_at(record, path))


def decode_feed_a(records: DataFrame) -> DataFrame:
    """Rows of flat records; those without a programme go."""
    r = F.col("record")
    text = {c: null_string(r, f"$.{c}") for c in ("ysws", "code_url", "country", "demo_url", "description", "github_username", "display_name", "archived_demo", "archived_repo")}
    rows = records.select(
        plain_string(r, "$.id").alias("airtable_id"), *[v.alias(k) for k, v in text.items()],
        timestamp(r, "$.approved_at").alias("approved_at"), null_string(r, "$.screenshot_url").alias("media_url"),
        null_int(r, "$.hours").alias("hours"), plain_int(r, "$.github_stars").alias("github_stars"),
    )
    return rows.where(F.col("ysws").isNotNull())


def decode_feed_b(records: DataFrame) -> DataFrame:
    """Rows of records with nested fields; any may be absent; those without a programme go."""
    r = F.col("record")
    field = lambda name: f"$.fields['{name}']"
    rows = records.select(
        plain_string(r, "$.id").alias("airtable_id"),
        null_string(r, field("YSWS–Name"), False).alias("ysws"),
        timestamp(r, field("Approved At"), False).alias("approved_at"),
        null_string(r, field("Code URL"), False).alias("code_url"),
        null_string(r, field("Playable URL"), False).alias("demo_url"),
        null_string(r, field("GitHub Username"), False).alias("github_username"),
        null_float(r, field("Hours Spent"), False).alias("true_hours"),
        screenshot(r, field("Screenshot")).alias("media_url"),
    )
    return rows.where(F.col("ysws").isNotNull())
