"""Text expressions: patterns, trigrams, repository paths and the columns that search matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_escape(value: str) -> str:
    """A value that matches itself in LIKE."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_normalise(pattern: str) -> str:
    """A user's pattern, wildcards kept: a backslash before an ordinary character or the end stands for what follows it."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            if i < len(pattern):
                out.append(like_escape(pattern[i]))
        else:
            out.append(c)
        i += 1
    return "".join(out)


def trigrams(value: str) -> list[str]:
    """The distinct trigrams of a string: words of letters and digits, two spaces before and one behind."""
    grams: dict[str, None] = {}
    for word in re.findall(r"[^\W_]+", value.lower()):
        padded = f"  {word} "
        grams.update(dict.fromkeys(padded[i : i + 3] for i in range(len(word) + 1)))
    return list(grams)


def trigram_set(c: Column) -> Column:
    """The same for a column."""
    grams = lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))
    )
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), grams)))


def similarity(c: Column, query: str) -> Column:
    """Shared trigrams over all trigrams, null for null, 0 if both have none."""
    wanted = F.array(*[F.lit(g) for g in trigrams(query)]).cast("array<string>")
    # each of the sets and counts is bound once
    counts = F.transform(F.array(trigram_set(c)), lambda g: F.struct(F.size(g).alias("own"), F.size(F.array_intersect(g, wanted)).alias("shared")))
    ratio = F.transform(counts, lambda n: F.coalesce(F.try_divide(n["shared"], n["own"] + F.size(wanted) - n["shared"]), F.lit(0.0)))[0]
    return F.when(c.isNotNull(), ratio)


#: What is cut from a repository's URL, one after the other, and how long its owner's and its own name may be.
URL_CUTS = ("^git@[^:]+:", "^[a-z]+://[^/]+/", "[.]git$|/$")
OWNER_MOST, REPO_MOST = 50, 80


def repository_path_sql(url: str) -> str:
    """The same as SQL of any dialect, for fixtures and oracles."""
    for cut in URL_CUTS:
        url = f"regexp_replace({url}, '{cut}', '')"
    return url


def with_repository(df):
    """inferred_username and inferred_repo from code_url, has_media from media_url."""
    path = F.coalesce("code_url", F.lit(""))
    for cut in URL_CUTS:
        # a $ also stands before a last line end in Java, and at the end alone in SQL
        path = F.regexp_replace(path, cut.replace("$", r"\z"), "")
    part = lambda n: F.split_part(path, F.lit("/"), F.lit(n))
    return df.withColumns(
        {
            "inferred_username": F.when(F.length(part(1)).between(1, OWNER_MOST), part(1)),
            "inferred_repo": F.when(F.length(part(2)).between(1, REPO_MOST), part(2)),
            "has_media": F.col("media_url").isNotNull(),
        }
    )


def with_search_columns(df):
    """search_username and search_repo, which prefixes, substrings and phrases are looked for in."""
    return df.withColumns(
        {
            "search_username": F.coalesce("github_username", "inferred_username", F.lit("")),
            "search_repo": F.translate("inferred_repo", "-_", "  "),
        }
    )


def search_text(letters: int | None = None) -> Column:
    """The text that full-text search reads; of the description all, or only so many letters."""
    description = F.col("description") if letters is None else F.left(F.col("description"), F.lit(letters))
    parts = [
        F.coalesce("ysws", F.lit("")),
        F.coalesce(description, F.lit("")),
        *[F.coalesce(c, F.lit("")) for c in ("country", "display_name", "github_username", "inferred_username")],
        F.translate(F.coalesce("inferred_repo", F.lit("")), "-_", "  "),
    ]
    return F.concat_ws(" ", *parts)
