"""Secret scans with multipart linking (operator 4). DataFrame functions only.

A base of three patterns is always reported. Beside it weak candidates are collected: identifiers (a login
name in an assignment), keys (long mixed tokens of high entropy) and endpoints. Each plays a part, as do the
spans of the base (an access id identifies; an assigned or hexadecimal value is a key). Parts and candidates
of a document meet in an interval join on bins of `scope` code points, the parts summarised to the first and
last place of each role in a bin, so that no pairs are listed. A weak candidate is reported when a strong
part of another role, or parts of both other roles, start within `scope` code points of it.

Defined results: a null or empty text has no spans; repeated rows give one result each; a weak candidate that
overlaps a span of the base is no candidate; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPAN, count_kind, kept_spans, let, span_list, stored, table

#: Code points between the starts of parts that belong together.
SCOPE = 300
#: Bits a character that a key's text needs at least.
MIN_ENTROPY = 3.5
#: Share of digits that a key with letters of one case needs: drawn from 36 characters, 28 % are digits.
MIN_DIGITS = 0.15

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Lengths are in the patterns where a shorter match could not hold a longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
BASE = ["assign", "access", "hex"]

WEAK_ID = r"""(?i)(?<![A-Za-z0-9])(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
WEAK_KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"
WEAK_ENDPOINT = r"(?i)(?<![A-Za-z0-9])(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}+|(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,12}:[0-9]{2,5})"
WEAK = ["id", "key", "endpoint"]

#: The part that each kind plays, and whether it is strong.
ROLES = {"assign": ("key", True), "access": ("id", True), "hex": ("key", True), "id": ("id", False), "key": ("key", False), "endpoint": ("endpoint", False)}


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))

    return let(F.split(text, ""), bits)


def mixed(hit: Column) -> Column:
    """Whether a token is like a drawn key: both cases, or one with enough digits, and of high entropy over its whole length."""
    n_digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    return ((hit.rlike("[a-z]") & hit.rlike("[A-Z]")) | (n_digits >= MIN_DIGITS * F.length(hit))) & (entropy(hit) >= MIN_ENTROPY)


def base_spans(text: Column) -> Column:
    return F.concat(
        kept_spans(text, "assign", 0, ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6),
        kept_spans(text, "access", 1, ACCESS),
        kept_spans(text, "hex", 2, HEX),
    )


def weak_spans(text: Column) -> Column:
    return F.concat(kept_spans(text, "id", 3, WEAK_ID), kept_spans(text, "key", 4, WEAK_KEY, mixed), kept_spans(text, "endpoint", 5, WEAK_ENDPOINT))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc, text_hash, spans): the weak candidates with complementary parts, of rows (doc, text_hash, base, weak)."""
    holders = found.where(F.size("weak") > 0).select("doc", "text_hash", "base", "weak").distinct()
    role = F.create_map(*[F.lit(x) for k, (r, _) in ROLES.items() for x in (k, r)])
    strong = F.col("part.kind").isin([k for k, (_, s) in ROLES.items() if s])
    parts = holders.select("doc", "text_hash", F.explode(F.concat("base", "weak")).alias("part"))
    parts = parts.select("doc", "text_hash", "part", role[F.col("part.kind")].alias("role"), strong.alias("strong"), F.floor(F.col("part.start") / scope).alias("bin"))
    bins = parts.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), "bin", F.col("role").alias("other"), F.col("strong").alias("sure")).agg(
        F.min("part.start").alias("low"), F.max("part.start").alias("high")
    )
    weak = parts.where(~F.col("strong")).select("doc", "text_hash", "part", "role", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"))
    start = F.col("part.start")
    # a bin is as long as the scope, so its first or last place tells whether anything in it is near enough
    near = (F.col("low").between(start - scope, start + scope)) | (F.col("high").between(start - scope, start + scope))
    same = weak["doc"].eqNullSafe(bins["_doc"]) & (weak["text_hash"] == bins["_hash"]) & (weak["bin"] == bins["bin"])
    met = weak.join(bins, same).where((F.col("role") != F.col("other")) & near)
    proven = met.groupBy("doc", "text_hash", "part").agg(F.max("sure").alias("sure"), F.count_distinct("other").alias("others"))
    proven = proven.where(F.col("sure") | (F.col("others") == 2))
    return proven.groupBy("doc", "text_hash").agg(F.collect_list("part").alias("spans"))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row a document: base and linked, arrays of SPAN."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), base_spans(text).alias("base"), weak_spans(text).alias("weak"))
    clear = lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    found = stored(rows.withColumn("weak", F.filter("weak", clear)))
    more = linked(found, scope).withColumnsRenamed({"doc": "_doc", "text_hash": "_hash", "spans": "linked"})
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    return found.join(more, same, "left").select(
        F.col("doc").alias(id_col), "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked")
    )


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.concat("base", "linked")).alias("spans"),
    )
