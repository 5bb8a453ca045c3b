"""Hybrid search: five branches, each cut to its cap, fused with weights and normalised."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import english, fulltext
from ..functions.text import search_text, with_search_columns
from ..operators import scoring
from ..operators.filters import Envelope, envelope, live, page_of, user_predicate
from ..operators.lookup import user_search
from ..sources.inverted import SearchIndex
from ..sources.shared import small_batches
from ..sources.vectors import VectorCells
from ..schema import CAPS, PUBLIC, SHOW_LETTERS, TRIGRAM_THRESHOLD, WEIGHTS, BadRequest

BRANCHES = ["fts", "phrase", "literal", "semantic", "trigram"]


@dataclass(frozen=True)
class Parsed:
    """A search string taken apart: the user, the rest, and what is embedded."""

    user: str | None
    text: str
    embed: str


def parse_filters(query: str) -> Parsed:
    found = re.search(r"\buser:(\S+)", query)
    text = re.sub(r"\buser:(\S+)", "", query).strip() if found else query
    return Parsed(found[1] if found else None, text, " ".join(text.replace('"', "").split()))


def weights(fts: float | None = None, semantic: float | None = None, trigram: float | None = None) -> dict[str, float]:
    """Given weights, or the defaults, without negatives and with sum 1."""
    given = {"fts": fts, "semantic": semantic, "trigram": trigram}
    for v in given.values():
        if v is not None and not math.isfinite(v):
            raise BadRequest("weights must be finite")
    used = {k: max(0.0, WEIGHTS[k] if v is None else v) for k, v in given.items()}
    total = sum(used.values())
    return {k: v / total for k, v in used.items()} if total > 0 else dict(WEIGHTS)


def caps(limit: int) -> dict[str, int]:
    return {k: min(max(times * limit, least), most) for k, (times, least, most) in CAPS.items()}


def lexemes(projects: DataFrame, stemmed: bool = True, letters: int | None = None):
    """The stored lexemes, or where a table has none (a fixture, a plain search) those of its text, see search_text."""
    if not stemmed:
        return english.plain_lexemes(search_text(letters))
    small_batches(projects.sparkSession)
    return F.col("tsv") if "tsv" in projects.columns else english.english_lexemes(search_text(letters))


def lexical_scores(projects: DataFrame, parsed: Parsed, stemmed: bool = True, branches=BRANCHES) -> DataFrame:
    """id and the four lexical scores of live rows that any branch can take, in one pass over the table.

    A score is null where its branch does not take the row. The user's filter holds for all but the trigram
    branch, which is cut to its cap before it.
    """
    node = fulltext.parse(parsed.text, stemmed) if "fts" in branches else None
    raw, phrases = scoring.raw_query(parsed.text), scoring.quoted_phrases(parsed.text)
    rows = with_search_columns(live(projects)).withColumn("_mine", user_predicate(parsed.user) if parsed.user else F.lit(True))
    mine, none = F.coalesce("_mine", F.lit(False)), F.lit(None).cast("double")
    phrase = scoring.phrase_score(phrases)
    scored = F.struct((scoring.trigram_score(raw) if raw else none).alias("_trigram"), (none if phrase is None else phrase).alias("_phrase"))
    # generated, so that a score is worked out once and not again in each filter and column that reads it
    rows = rows.select("*", F.inline(F.array(scored)))
    near = F.coalesce(F.col("_trigram") >= TRIGRAM_THRESHOLD, F.lit(False))
    worded = mine & F.coalesce(F.col("_phrase") > 0, F.lit(False))
    if node is not None:
        rows = rows.withColumn("_tsv", lexemes(projects, stemmed))
        rows = rows.withColumn("_hit", mine & F.coalesce(fulltext.matches(F.col("_tsv"), node), F.lit(False)))
    else:
        rows = rows.withColumn("_hit", F.lit(False))
    rows = rows.where(F.col("_hit") | near | worded)
    # only what was found is ranked, and of it only the query's words
    rank = fulltext.rank(node)(F.when(F.col("_hit"), F.col("_tsv"))) if node is not None else none
    return rows.select(
        "id",
        F.when(F.col("_hit"), rank).alias("fts"),
        F.when(worded, F.col("_phrase")).alias("phrase"),
        F.when(mine & near, scoring.literal_score(raw)).alias("literal"),
        F.when(near, F.col("_trigram")).alias("trigram"),
    )


def indexed_scores(projects: DataFrame, parsed: Parsed, index: SearchIndex, branches=BRANCHES) -> DataFrame:
    """The same as lexical_scores from an index of lexemes and trigrams: a row's text is read only if the index found it.

    Phrases are substrings of descriptions, which no index holds; a query with quotes scans their columns, and nothing
    else. A query that texts without any of its words match is left to the scan of all rows.
    """
    node = fulltext.parse(parsed.text) if "fts" in branches else None
    if node is not None and fulltext.matches_nothing(node):
        return lexical_scores(projects, parsed, branches=branches)
    spark, raw, phrase = projects.sparkSession, scoring.raw_query(parsed.text), scoring.phrase_score(scoring.quoted_phrases(parsed.text))
    none = F.lit(None).cast("double")
    found = []
    if node is not None:
        found.append(index.matches(spark, node).select("id", "version", fulltext.rank(node)(F.col("tsv")).alias("_fts"), none.alias("_trigram")))
    if raw:
        found.append(index.similar(spark, raw).select("id", "version", none.alias("_fts"), F.col("score").alias("_trigram")))
    parts = []
    rows = with_search_columns(live(projects)).withColumn("_mine", F.coalesce(user_predicate(parsed.user), F.lit(False)) if parsed.user else F.lit(True))
    if found:
        both = reduce(DataFrame.union, found).groupBy("id", "version").agg(F.max("_fts").alias("_fts"), F.max("_trigram").alias("_trigram"))
        # former states of a project are in the index too, but its updated_at is another one now
        kept = rows.withColumn("version", F.col("updated_at")).join(both, ["id", "version"])
        near = F.col("_trigram").isNotNull()
        literal = F.when(F.col("_mine") & near, scoring.literal_score(raw))
        parts.append(kept.select("id", F.when(F.col("_mine"), F.col("_fts")).alias("fts"), none.alias("phrase"), literal.alias("literal"), F.col("_trigram").alias("trigram")))
    if phrase is not None:
        worded = rows.where("_mine").select("id", none.alias("fts"), phrase.alias("phrase"), none.alias("literal"), none.alias("trigram"))
        parts.append(worded.where("phrase > 0"))
    if not parts:
        return lexical_scores(projects, parsed, branches=branches)
    return reduce(DataFrame.union, parts)


def nearest(embeddings: DataFrame, vector: list[float], cap: int) -> DataFrame:
    """The closest vectors of all that are stored, whatever their projects."""
    distance = scoring.cosine_distance(F.col("embedding"), vector)
    scored = embeddings.select(F.col("project_id").alias("id"), distance.alias("distance")).where(F.col("distance").isNotNull())
    return scored.orderBy("distance", "id").limit(cap)


def candidates(
    projects: DataFrame, embeddings: DataFrame | VectorCells | None, parsed: Parsed, vector: list[float] | None, limit: int, branches=BRANCHES, stemmed: bool = True,
    index: SearchIndex | None = None,
) -> DataFrame:
    """id and the five scores of every row that survives a branch's cap; 0 where a branch has not got it."""
    most = caps(limit)
    lexical = lexical_scores(projects, parsed, stemmed, branches) if index is None or not stemmed else indexed_scores(projects, parsed, index, branches)
    chosen = [b for b in BRANCHES if b != "semantic" and b in branches] or ["fts"]
    scored = lexical.select("id", F.inline(F.array(*[F.struct(F.lit(b).alias("branch"), F.col(b).alias("score")) for b in chosen]))).where("score IS NOT NULL")
    # one scan for all branches: each task keeps its best of a branch before anything moves
    place = F.row_number().over(Window.partitionBy("branch").orderBy(F.col("score").desc(), "id"))
    ranked = scored.withColumn("place", place).where(F.col("place") <= max(most[b] for b in chosen))
    cap = F.create_map(*[F.lit(x) for b in chosen for x in (b, most[b])])
    every = ranked.where(F.col("place") <= cap[F.col("branch")]).select("id", "branch", "score")
    if vector is not None and embeddings is not None and "semantic" in branches:
        close = embeddings.nearest(projects.sparkSession, vector, most["semantic"]) if isinstance(embeddings, VectorCells) else nearest(embeddings, vector, most["semantic"])
        shown = live(projects).where(F.length("description") > SHOW_LETTERS)
        if parsed.user:
            shown = shown.where(user_predicate(parsed.user))
        close = close.join(shown.select("id"), "id", "left_semi")
        every = every.union(close.select("id", F.lit("semantic").alias("branch"), scoring.semantic_score(F.col("distance")).alias("score")))
    # one aggregation in place of five joins
    score = lambda b: F.coalesce(F.max(F.when(F.col("branch") == b, F.col("score"))), F.lit(0.0)).alias(b)
    found = every.groupBy("id").agg(*[score(b) for b in BRANCHES])
    if parsed.user:
        found = found.join(live(projects).where(user_predicate(parsed.user)).select("id"), "id", "left_semi")
    return found


def fused(scores: DataFrame, w: dict[str, float]) -> DataFrame:
    """raw, the weighted sum, and score, raw over the greatest raw of all candidates."""
    raw = (
        F.col("fts") * w["fts"]
        + F.col("phrase") * max(w["fts"], w["semantic"])
        + F.col("literal") * max(w["fts"], w["trigram"])
        + F.col("semantic") * w["semantic"]
        + F.col("trigram") * w["trigram"]
    )
    whole = Window.partitionBy()  # of candidates, which are no more than the caps' sum
    scored = scores.withColumn("raw", raw).withColumn("best", F.max("raw").over(whole))
    return scored.withColumn("score", F.when(F.col("best") > 0, F.try_divide("raw", "best")).otherwise(0.0)).drop("best")


def search(
    projects: DataFrame, embeddings: DataFrame | VectorCells | None, query: str, *, limit: int | None = None, page: int | None = None,
    fts: float | None = None, semantic: float | None = None, trigram: float | None = None,
    embed: Callable[[str], list[float]] | None = None, branches=BRANCHES, stemmed: bool = True, index: SearchIndex | None = None,
) -> DataFrame:
    """A page of public columns with score and total. A query for a user alone lists that user's projects.

    With an index its tables are searched in place of all rows; embeddings may be cells of vectors, of which the nearest are read.
    """
    size, _, offset = page_of(limit, page, "search")
    parsed = parse_filters(query)
    if parsed.user and not parsed.text:
        return user_search(projects, parsed.user, limit, page)
    w = weights(fts, semantic, trigram)
    vector = embed(parsed.embed) if embed else None
    # at most the caps' sum of rows
    scored = fused(candidates(projects, embeddings, parsed, vector, size, branches, stemmed, index), w)
    scored = scored.withColumn("total", F.count("*").over(Window.partitionBy()))
    rows = live(projects).join(F.broadcast(scored.select("id", "raw", "score", "total")), "id")
    shown = rows.orderBy(F.col("raw").desc(), F.col("approved_at").desc_nulls_last(), F.col("id")).offset(offset).limit(size)
    return shown.select(*PUBLIC, "score", "total")


@dataclass(frozen=True)
class Answer:
    """An envelope with what the embedding and the query took, in milliseconds."""

    envelope: Envelope
    embeddings_ms: int
    query_ms: int


def answer(projects: DataFrame, embeddings: DataFrame | None, query: str, *, limit: int | None = None, page: int | None = None, embed=None, **how) -> Answer:
    """The search's page as rows on the driver, at most PAGE_MOST of them."""
    spent = 0.0

    def timed(text: str) -> list[float]:
        nonlocal spent
        start = time.perf_counter()
        vector = embed(text)
        spent = time.perf_counter() - start
        return vector

    start = time.perf_counter()
    found = envelope(search(projects, embeddings, query, limit=limit, page=page, embed=timed if embed else None, **how), limit, page, "search")
    return Answer(found, round(1000 * spent), round(1000 * (time.perf_counter() - start - spent)))
