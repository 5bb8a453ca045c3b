"""Quality rules by cross-document line frequency (operator 7). DataFrame functions only.

Lines are normalised (white space collapsed, trimmed, lower case) and hashed; for each host the distinct
documents of a line are counted, a line in more than `max_docs` of them is boilerplate there, and a document
whose different lines hold too few words without the boilerplate is depleted and rejected. The first document (smallest
id) that holds a line keeps it: its text is then still somewhere in the corpus, and of a large group of
copies the first stays whole for de-duplication to name. A base of plain rules rejects short and repetitive
texts. `without_boilerplate` gives the kept documents with those lines taken out of their texts.

Defined results: a null, empty or wordless text has no words and fails the base; a null host is a host of
its own; repeated rows count as one document and each get its verdict; ids that repeat with other texts are
one document for the line counts and judged row by row; an empty table gives an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, table, wrapped

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Distinct documents of a host in which a line may stand.
MAX_DOCS = 100
#: Below this share of its words, or this many words, a document without its boilerplate is depleted.
MIN_SHARE, MIN_WORDS = 0.3, 10
#: The base: fewest words, most percent of words in repeated windows.
BASE_WORDS, BASE_REPEAT = 10, 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def repeated_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that occur more than once in the text; near-linear in its length."""

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        again = lambda s: F.filter(
            s, lambda e, i: (F.get(s, i - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(e["h"]))
        )
        places = lambda s: F.sort_array(F.transform(again(s), lambda e: e["at"]))
        widths = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        total = lambda p: F.aggregate(widths(p), F.lit(0), lambda a, x: a + x)
        return let(placed, lambda s: let(places(s), total))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, counted)).cast("long")


def measures(text: Column) -> Column:
    """struct of the base's figures for one text."""
    repeats = lambda x: let(lines(x), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.coalesce(F.length(F.array_join(w, "")), F.lit(0)).cast("long").alias("word_chars"),
            F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
            repeats(text).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.aggregate(
                F.array_distinct(F.transform(lines(text), normal)), F.lit(0), lambda a, x: a + F.size(F.split(x, " "))
            ).cast("long").alias("line_words"),
        ),
    )


def document_lines(docs: DataFrame, *, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row for each different normalised line of a document, with its words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = F.transform(
        F.array_distinct(F.transform(lines(text), normal)),
        lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).cast("long").alias("words")),
    )
    rows = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.inline(counted),
    )
    return rows.distinct()


def boilerplate(by_line: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, first): lines of more than max_docs distinct documents, and the smallest id that holds them."""
    once = by_line.select("host", "line", "doc").distinct()
    counted = once.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    return counted.where(F.col("n") > max_docs).select("host", "line", "first")


def judge(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS,
    min_share: float = MIN_SHARE, min_words: int = MIN_WORDS, by_line: DataFrame | None = None,
) -> DataFrame:
    """One row a document: the base's figures, base_failed, the words lost to boilerplate lines, and kept.

    by_line are the document_lines, if they are at hand.
    """
    if by_line is None:
        by_line = stored(document_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col))
    lost = (
        by_line.join(boilerplate(by_line, max_docs), ["host", "line"])
        .where(~F.col("doc").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("host").alias("_host"))
        .agg(F.sum("words").alias("_lost"))
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), host.alias("host"), measures(text).alias("m"))
    same = (
        F.col("doc").eqNullSafe(F.col("_doc")) & F.col("text_hash").eqNullSafe(F.col("_hash")) & F.col("host").eqNullSafe(F.col("_host"))
    )
    rows = rows.select("doc", "text_hash", "host", "m.*")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    lost_words = F.coalesce("_lost", F.lit(0))
    left = F.col("line_words") - F.col("lost_words")
    depleted = (F.col("lost_words") > 0) & ((left < min_words) | (left < min_share * F.col("line_words")))
    out = rows.join(lost, same, "left").withColumn("base_failed", failed).withColumn("lost_words", lost_words)
    return out.select(
        F.col("doc").alias(id_col), "text_hash", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "line_words", "lost_words", (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that are kept, with all their columns and whole texts."""
    judged = judge(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits)
    good = judged.where("kept").select(F.col(id_col).alias("_doc"), F.col("text_hash").alias("_hash"), F.col("host").alias("_host"))
    rows = wrapped(docs, id_col, text_col).withColumn("host", F.coalesce(F.col("row")[host_col].cast("string"), F.lit("")))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & (F.col("host") == F.col("_host"))
    return rows.join(good, same, "left_semi").select("row.*")


def without_boilerplate(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, **limits
) -> DataFrame:
    """The documents that are kept, with all their columns; lines over the limit go from all but the first that holds them."""
    by_line = stored(document_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col))
    good = keep_good(docs, id_col=id_col, text_col=text_col, host_col=host_col, max_docs=max_docs, by_line=by_line, **limits)
    over = by_line.join(boilerplate(by_line, max_docs), ["host", "line"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    over = over.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("host").alias("_host"))
    over = over.agg(F.collect_set("line").alias("over"))
    rows = wrapped(good, id_col, text_col).withColumn("host", F.coalesce(F.col("row")[host_col].cast("string"), F.lit("")))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & (F.col("host") == F.col("_host"))
    text = F.col("row")[text_col].cast("string")
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("over", F.xxhash64(normal(x))))
    new = F.when(F.col("over").isNull(), text).otherwise(F.array_join(left, "\n"))
    return rows.join(over, same, "left").select(F.col("row").withField(text_col, new).alias("row")).select("row.*")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
again AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN again USING (doc_id, gram)) GROUP BY doc_id),
nl AS (SELECT DISTINCT doc_id, host, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM (SELECT doc_id, host, unnest(ls) AS l FROM w)),
freq AS (SELECT host, line, min(doc_id) AS first FROM nl GROUP BY ALL HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
lw AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS lw FROM nl GROUP BY doc_id),
lost AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS lost FROM nl JOIN freq USING (host, line) WHERE doc_id <> first GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(lw, 0) AS lw
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN lw USING (doc_id)),
f AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (lost > 0 AND (lw - lost < {MIN_WORDS} OR lw - lost < {MIN_SHARE} * lw)) AS kept FROM f
"""
