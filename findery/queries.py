"""The catalogue's queries on the synthetic tables, and the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import english, fulltext, present
from .functions.text import OWNER_MOST, REPO_MOST, repository_path_sql, search_text, similarity, with_repository, with_search_columns
from .operators import cached, embed, ingest, lookup, scoring
from .operators.filters import Filter, Request, live, matching, run_query
from .plans import search as hybrid
from .schema import PUBLIC
from .sources import feeds, fixtures
from .sources.inverted import SearchIndex
from .sources.shared import shared_folder
from .sources.vectors import VectorCells
from .sources.catalogue import Catalogue
from .sources.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PUB = ", ".join(PUBLIC)
NOW = datetime(2025, 1, 1)
NOW_SQL = "TIMESTAMP '2025-01-01 00:00:00'"


def query(name: str, sql: str | None = None):
    """Register a function of (projects, spark, sf_dir) under a name, with its SQL over the fixture's views."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(fixtures.projects(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return register


# filters

FILTERS = {
    "filter_eq": ([("display_name", "eq", "small ring")], "display_name = 'small ring'"),
    "filter_neq": ([("country", "neq", "en")], "country <> 'en'"),
    "filter_gt": ([("github_stars", "gt", 40)], "github_stars > 40"),
    "filter_gte": ([("approved_at", "gte", "1700360000")], "approved_at >= 1700360000"),
    "filter_lt": ([("true_hours", "lt", "3.55")], "true_hours < 3.55"),
    "filter_lte": ([("hours", "lte", 5)], "hours <= 5"),
    "filter_contains": ([("display_name", "contains", "RING")], "display_name ILIKE '%ring%'"),
    "filter_contains_escaped": ([("code_url", "contains", "_r")], r"code_url ILIKE '%\_r%' ESCAPE '\'"),
    "filter_not_contains": ([("display_name", "not_contains", "small")], "display_name NOT ILIKE '%small%'"),
    "filter_starts_with": ([("display_name", "starts_with", "Small")], "display_name ILIKE 'small%'"),
    "filter_ends_with": ([("inferred_repo", "ends_with", "BOLT")], "inferred_repo ILIKE '%bolt'"),
    "filter_is_null": ([("country", "is_null", None)], "country IS NULL"),
    "filter_is_not_null": ([("archived_demo", "is_not_null", None)], "archived_demo IS NOT NULL"),
    "filter_bool_media": ([("has_media", "eq", True)], "media_url IS NOT NULL"),
    "filter_bool_no_media": ([("has_media", "neq", "1")], "media_url IS NULL"),
    "filter_timestamp": ([("created_at", "gte", "2024-01-01T01:30:00")], "created_at >= TIMESTAMP '2024-01-01 01:30:00'"),
    "filter_conjunction": (
        [("display_name", "starts_with", "small"), ("github_stars", "gte", 10), ("country", "neq", "de"), ("hours", "is_not_null", None)],
        "display_name ILIKE 'small%' AND github_stars >= 10 AND country <> 'de' AND hours IS NOT NULL",
    ),
}
for _name, (_filters, _where) in FILTERS.items():

    @query(_name, f"SELECT {PUB} FROM live WHERE {_where}")
    def _filtered(p, spark, sf_dir, filters=_filters):
        return matching(p, [Filter(*f) for f in filters]).select(*PUBLIC)


def _paged(name: str, request: Request, where: str, order: str, limit: int, offset: int = 0) -> None:
    sql = f"SELECT {PUB}, (SELECT count(*) FROM live WHERE {where}) AS total FROM live WHERE {where} ORDER BY {order}, id LIMIT {limit} OFFSET {offset}"
    query(name, sql)(lambda p, spark, sf_dir: run_query(p, request))


_SMALL = [Filter("display_name", "starts_with", "small"), Filter("github_stars", "gte", 10)]
_SMALL_SQL = "display_name ILIKE 'small%' AND github_stars >= 10"
_paged("filter_sort_page_total", Request(_SMALL, limit=5, page=2), _SMALL_SQL, "approved_at DESC NULLS LAST", 5, 5)
_paged("sort_asc_nulls_last", Request([], "true_hours", "ASC", 100), "true", "true_hours ASC NULLS LAST", 100)
_paged("sort_by_media", Request([], "has_media", "desc", 50), "true", "media_url DESC NULLS LAST", 50)
_paged("empty_page_total_zero", Request(_SMALL, limit=100, page=1000), _SMALL_SQL, "approved_at DESC NULLS LAST", 100, 99_900)

_FOLDED = "display_name COLLATE NOCASE"
query("sort_text_collated", f"SELECT {PUB}, (SELECT count(*) FROM live) AS total FROM live ORDER BY {_FOLDED} DESC NULLS LAST, id LIMIT 100")(
    lambda p, *_: run_query(p, Request([], "display_name", "desc", 100, collation="UNICODE_CI"))
)

# look-ups

query("project_by_id", f"SELECT {PUB} FROM live WHERE id = 171")(lambda p, *_: lookup.project(p, "171"))
query("project_by_key", f"SELECT {PUB} FROM live WHERE airtable_id = 'rec00000023'")(lambda p, *_: lookup.project(p, "rec00000023"))
query("recent", f"SELECT {PUB} FROM live ORDER BY created_at DESC, id LIMIT 20")(lambda p, *_: lookup.recent(p))
query("program_list", "SELECT DISTINCT ysws FROM projects")(lambda p, *_: lookup.programmes(p))
query("program_complete", "SELECT DISTINCT ysws FROM projects WHERE contains(lower(ysws), 'c1')")(lambda p, *_: lookup.complete(lookup.programmes(p), " C1 "))
query("media_lookup", "SELECT media_url FROM projects WHERE id = 17")(lambda p, *_: lookup.media(p, 17))
query("media_lookup_null", "SELECT media_url FROM projects WHERE airtable_id = 'rec00000018'")(lambda p, *_: lookup.media(p, "rec00000018"))


def _user_sql(pattern: str) -> str:
    columns = ("github_username", "inferred_username", "display_name", "code_url", "inferred_repo")
    return "(" + " OR ".join(f"coalesce({c} ILIKE '{pattern}', false)" for c in columns) + ")"


def _user_search(name: str, user: str, pattern: str, limit: int, page: int) -> None:
    where = _user_sql(pattern)
    sql = (
        f"SELECT {PUB}, 1.0::DOUBLE AS score, (SELECT count(*) FROM live WHERE {where}) AS total FROM live WHERE {where} "
        f"ORDER BY approved_at DESC NULLS FIRST, id LIMIT {limit} OFFSET {limit * (page - 1)}"
    )
    query(name, sql)(lambda p, *_: hybrid.search(p, None, f"user:{user}", limit=limit, page=page))


_user_search("user_search", "user1", "%user1%", 20, 2)
_user_search("user_search_wildcard", "user_5", "%user_5%", 100, 1)

# scalars of text

_RAW = "small ring"
query("infer_repo", "SELECT id, inferred_username, inferred_repo, has_media FROM projects")(
    lambda p, *_: with_repository(p.drop("inferred_username", "inferred_repo", "has_media")).select("id", "inferred_username", "inferred_repo", "has_media")
)
_SEARCH_SQL = "coalesce(github_username, inferred_username, '') AS search_username, translate(inferred_repo, '-_', '  ') AS search_repo"
query("search_columns", f"SELECT id, {_SEARCH_SQL} FROM live")(lambda p, *_: with_search_columns(live(p)).select("id", "search_username", "search_repo"))


def grams_sql(c: str) -> str:
    word = "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))"
    return rf"list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda w: {word})))"


def similarity_sql(c: str, text: str) -> str:
    a, b = grams_sql(c), grams_sql(f"'{text}'")
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce({shared} / nullif(len({a}) + len({b}) - {shared}, 0), 0)::DOUBLE END"


def trigram_sql(text: str) -> str:
    return "coalesce(greatest(" + ", ".join(similarity_sql(c, text) for c in scoring.TRIGRAM_COLUMNS) + "), 0)"


def phrase_sql(phrases: list[str]) -> str:
    parts = [f"CASE WHEN contains(lower(coalesce({c}, '')), '{p}') THEN {w} ELSE 0 END" for p in phrases for c, w in scoring.PHRASE_COLUMNS]
    return "(" + " + ".join(parts) + ")::DOUBLE"


def literal_sql(raw: str) -> str:
    low = lambda c: f"lower(coalesce({c}, ''))"
    levels = [f"CASE WHEN {low(c)} = '{raw}' THEN {w} ELSE 0 END" for c, w in scoring.EXACT]
    levels += [f"CASE WHEN {low(c)} LIKE '{raw}%' THEN {w} ELSE 0 END" for c, w in scoring.PREFIX]
    levels += [f"CASE WHEN contains({low(c)}, '{raw}') THEN {w} ELSE 0 END" for c, w in scoring.SUBSTRING]
    return f"greatest({', '.join(levels)})::DOUBLE"


query("trigram_similarity", f"SELECT id, round({similarity_sql('display_name', 'small rings')}, 6) AS similarity FROM live")(
    lambda p, *_: live(p).select("id", F.round(similarity(F.col("display_name"), "small rings"), 6).alias("similarity"))
)
query("trigram_match", f"SELECT id, round({trigram_sql(_RAW)}, 6) AS score FROM live WHERE {trigram_sql(_RAW)} >= 0.3")(
    lambda p, *_: scoring.trigram_matches(live(p), _RAW).select("id", F.round("score", 6).alias("score"))
)
_SEARCHED = f"(SELECT *, {_SEARCH_SQL} FROM live)"
query("phrase_score", f"SELECT id, {phrase_sql(['small ring', 'the'])} AS score FROM {_SEARCHED} WHERE {phrase_sql(['small ring', 'the'])} > 0")(
    lambda p, *_: with_search_columns(live(p)).select("id", scoring.phrase_score(scoring.quoted_phrases('x "small ring" "The"')).alias("score")).where("score > 0")
)
query("literal_score", f"SELECT id, {literal_sql(_RAW)} AS score FROM {_SEARCHED}")(
    lambda p, *_: with_search_columns(live(p)).select("id", scoring.literal_score(scoring.raw_query(' "Small Ring" ')).alias("score"))
)

# vectors


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(fixtures.embeddings(spark, sf_dir).where("project_id = 0").first()["embedding"])


_DISTANCE = "list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM project_embeddings WHERE project_id = 0))"
_NEAREST = f"(SELECT project_id AS id, {_DISTANCE} AS distance FROM project_embeddings ORDER BY distance, id LIMIT 80)"
_SEMANTIC = f"SELECT n.id, greatest(0, least(1, 1 - distance / 2)) AS score FROM {_NEAREST} n JOIN live USING (id) WHERE length(description) > 50"


@query("vector_topk", f"SELECT id, round(distance, 6) AS distance FROM {_NEAREST}")
def vector_topk(p, spark, sf_dir):
    found = hybrid.nearest(fixtures.embeddings(spark, sf_dir), _vector(spark, sf_dir), 80)
    return found.select("id", F.round("distance", 6).alias("distance"))


@query("semantic_similarity_gated", f"SELECT id, round(score, 6) AS score FROM ({_SEMANTIC})")
def semantic_similarity_gated(p, spark, sf_dir):
    near = hybrid.nearest(fixtures.embeddings(spark, sf_dir), _vector(spark, sf_dir), 80)
    shown = near.join(live(p).where(F.length("description") > 50).select("id"), "id", "left_semi")
    return shown.select("id", F.round(scoring.semantic_score(F.col("distance")), 6).alias("score"))


# fusion


def fusion_sql(raw: str, phrases: list[str], limit: int, user: str | None, final: str, rank: str | None = None) -> str:
    """The branches, with full text where its rank is given, with caps and default weights; `final` reads fused(id, ..., raw, score)."""
    most = hybrid.caps(limit)
    mine = _user_sql(user) if user else "true"
    s = f"s AS (SELECT *, {trigram_sql(raw)} AS tri, {literal_sql(raw)} AS lit, {phrase_sql(phrases) if phrases else '0.0'} AS phr, {mine} AS mine, {rank or 'NULL'} AS ft FROM {_SEARCHED})"
    cut = lambda c, where, n: f"(SELECT id, {c} AS score FROM s WHERE {where} ORDER BY {c} DESC, id LIMIT {n})"
    semantic = _SEMANTIC.replace("LIMIT 80", f"LIMIT {most['semantic']}") + (f" AND {mine}" if user else "")
    branches = {
        "trigram": cut("tri", "tri >= 0.3", most["trigram"]), "literal": cut("lit", "mine AND tri >= 0.3", most["literal"]),
        "phrase": cut("phr", "mine AND phr > 0", most["phrase"]), "semantic": f"({semantic})", "fts": cut("ft", "mine AND ft > 0", most["fts"]),
    }
    every = " UNION ALL ".join(f"SELECT id, '{b}' AS branch, score FROM {q}" for b, q in branches.items())
    scores = ", ".join(f"coalesce(max(CASE WHEN branch = '{b}' THEN score END), 0) AS {b}" for b in branches)
    w = hybrid.weights()
    raw_sql = f"phrase * {max(w['fts'], w['semantic'])} + literal * {max(w['fts'], w['trigram'])} + semantic * {w['semantic']} + trigram * {w['trigram']} + fts * {w['fts']}"
    kept = "c AS (SELECT * FROM every" + (" WHERE id IN (SELECT id FROM s WHERE mine)" if user else "") + ")"
    return (
        f"SELECT * FROM (WITH {s}, every AS ({every}), {kept}, g AS (SELECT id, {scores} FROM c GROUP BY id), r AS (SELECT *, {raw_sql} AS raw FROM g), "
        f"fused AS (SELECT *, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0 END AS score FROM r) {final})"
    )


_NO_FTS = [b for b in hybrid.BRANCHES if b != "fts"]
_PAGE_SQL = f"SELECT {PUB}, round(score, 6) AS score, (SELECT count(*) FROM fused) AS total FROM fused JOIN live USING (id) ORDER BY raw DESC, approved_at DESC NULLS LAST, id LIMIT 10"


def _search(p, spark, sf_dir, text, **how) -> DataFrame:
    vector = _vector(spark, sf_dir)
    found = hybrid.search(p, fixtures.embeddings(spark, sf_dir), text, embed=lambda _: vector, **how)
    return found.withColumn("score", F.round("score", 6))


query("hybrid_no_fts", fusion_sql("small ring", ["small ring"], 10, None, _PAGE_SQL))(
    lambda p, spark, sf_dir: _search(p, spark, sf_dir, '"small ring"', branches=_NO_FTS)
)
query("hybrid_user_filtered", fusion_sql("bolt", [], 10, "%user1%", _PAGE_SQL))(
    lambda p, spark, sf_dir: _search(p, spark, sf_dir, "bolt user:user1", branches=_NO_FTS)
)


def _fused(p, spark, sf_dir) -> DataFrame:
    parsed = hybrid.parse_filters('"small ring"')
    scores = hybrid.candidates(p, fixtures.embeddings(spark, sf_dir), parsed, _vector(spark, sf_dir), 10, _NO_FTS)
    return hybrid.fused(scores, hybrid.weights())


query("candidates_union", fusion_sql("small ring", ["small ring"], 10, None, "SELECT id FROM fused"))(lambda p, spark, sf_dir: _fused(p, spark, sf_dir).select("id"))
query(
    "score_normalised",
    fusion_sql("small ring", ["small ring"], 10, None, "SELECT id, phrase, literal, round(semantic, 6) AS semantic, round(trigram, 6) AS trigram, round(score, 6) AS score FROM fused"),
)(
    lambda p, spark, sf_dir: _fused(p, spark, sf_dir).select(
        "id", "phrase", "literal", *[F.round(c, 6).alias(c) for c in ("semantic", "trigram", "score")]
    )
)

# full text; the plain forms neither stem nor stop

_TEXT_SQL = (
    "concat_ws(' ', coalesce(ysws, ''), coalesce(left(description, 1000), ''), coalesce(country, ''), coalesce(display_name, ''), "
    "coalesce(github_username, ''), coalesce(inferred_username, ''), translate(coalesce(inferred_repo, ''), '-_', '  '))"
)
#: Letters of a description that the queries below read; the exceptions read all, and their SQL too.
LETTERS = 1000
_whole = lambda sql: sql.replace(f"left(description, {LETTERS})", "description")
_WORDS = rf"(SELECT id, regexp_extract_all(lower({_TEXT_SQL}), '[\p{{L}}\p{{N}}]+') AS w FROM live)"


#: The tokens of the text and what they are made of, as english.tokens has them.
_TOKEN_RE = english.TOKEN.replace("'", "''")
_BARE = "regexp_replace(t, '^[a-z]+://', '')"
_TOKEN_LIST = (
    f"flatten(list_transform(regexp_extract_all(lower({_TEXT_SQL}), '{_TOKEN_RE}'), lambda t: CASE WHEN contains(t, '@') AND NOT contains(t, '/') THEN [t] "
    f"WHEN contains({_BARE}, '/') THEN [{_BARE}, split_part({_BARE}, '/', 1), regexp_replace({_BARE}, '^[^/]*', '')] "
    f"WHEN contains({_BARE}, '.') OR NOT contains({_BARE}, '-') THEN [{_BARE}] ELSE list_concat([{_BARE}], string_split({_BARE}, '-')) END))"
)
_TOKENS = f"(SELECT id, {_TOKEN_LIST} AS w FROM live)"


def _plain(text: str, ranked: bool = False):
    def run(p, *_):
        node = fulltext.parse(text, stemmed=False)
        rows = live(p).select("id", english.plain_lexemes(search_text(LETTERS)).alias("tsv")).where(fulltext.matches(F.col("tsv"), node))
        return rows.select("id", F.round(fulltext.rank(node)(F.col("tsv")), 6).alias("rank")) if ranked else rows.select("id")

    return run


_TWO = "len(list_filter(range(1, len(w)), lambda i: w[i] = 'small' AND w[i + 1] = 'ring')) > 0"
query("fts_match_plain", f"SELECT id FROM {_WORDS} WHERE list_contains(w, 'small') AND list_contains(w, 'bolt')")(_plain("Small bolt"))
query("fts_or_plain", f"SELECT id FROM {_WORDS} WHERE list_contains(w, 'small') OR list_contains(w, 'bolt')")(_plain("small or bolt"))
query("fts_phrase_plain", f"SELECT id FROM {_WORDS} WHERE {_TWO}")(_plain('"small ring"'))
query("fts_negation_plain", f"SELECT id FROM {_WORDS} WHERE list_contains(w, 'red') AND NOT list_contains(w, 'widget')")(_plain("red -widget"))
query("fts_rank_plain", f"SELECT id, round(len(list_filter(w, lambda x: x = 'ring')) * 0.1::DOUBLE, 6) AS rank FROM {_WORDS} WHERE list_contains(w, 'ring')")(_plain("ring", True))


#: The fixture's words of three stems; of what else the stemmer makes no word becomes one of these.
_FAMILIES = {stem: [stem, f"{stem}s", f"{stem}ed", f"{stem}ing"] for stem in ("small", "ring", "bolt")}
_STEM_SQL = "CASE " + " ".join(f"WHEN x IN ({', '.join(map(repr, ws))}) THEN '{s}'" for s, ws in _FAMILIES.items()) + " END"
_PLACED = f"(SELECT id, pos, {_STEM_SQL} AS x FROM (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM {_TOKENS}))"


@query("fts_token_classes", f"SELECT id, pos, x AS token FROM (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM {_TOKENS}) WHERE regexp_matches(x, '[^\\p{{L}}\\p{{N}}]')")
def fts_token_classes(p, spark, sf_dir):
    """Addresses, URLs, hosts and compounds, with their places among all tokens."""
    placed = live(p).select("id", F.posexplode(english.tokens(search_text(LETTERS))).alias("pos", "token"))
    return placed.where(F.col("token").rlike(r"[^\p{L}\p{N}]")).select("id", (F.col("pos") + 1).cast("long").alias("pos"), "token")


@query("fts_lexemes")
def fts_lexemes(p, spark, sf_dir):
    return live(p).select("id", hybrid.lexemes(p).alias("tsv"))


@query("fts_lexeme_places", f"SELECT id, x AS lexeme, pos FROM {_PLACED} WHERE x IS NOT NULL")
def fts_lexeme_places(p, spark, sf_dir):
    """Lexemes and positions of the words of three stems; stop words count for positions."""
    placed = live(p).select("id", F.inline(hybrid.lexemes(p, letters=LETTERS)))
    return placed.where(F.col("lexeme").isin(list(_FAMILIES))).select("id", "lexeme", F.col("pos").cast("long").alias("pos"))


_STOPS_SQL = ", ".join(map(repr, sorted(english.STOP_WORDS)))


@query("fts_lexeme_positions", f"SELECT id, pos FROM (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM {_TOKENS}) WHERE x NOT IN ({_STOPS_SQL})")
def fts_lexeme_positions(p, spark, sf_dir):
    """Where the lexemes of all words stand: what is cut into words and what is stopped."""
    return live(p).select("id", F.inline(hybrid.lexemes(p, letters=LETTERS))).select("id", F.col("pos").cast("long").alias("pos"))


# small & ring | bolt: the shortest extents are each bolt, and a small and a ring with none of the three between
_RANK_SQL = (
    "SELECT id, round(sum(CASE WHEN x = 'bolt' THEN 0.1::DOUBLE WHEN x <> before AND before <> 'bolt' THEN 0.1::DOUBLE / (pos - place) ELSE 0 END), 6) AS rank FROM "
    f"(SELECT *, lag(x) OVER o AS before, lag(pos) OVER o AS place FROM {_PLACED} WHERE x IS NOT NULL WINDOW o AS (PARTITION BY id ORDER BY pos)) "
    "GROUP BY id HAVING bool_or(x = 'bolt') OR (bool_or(x = 'small') AND bool_or(x = 'ring'))"
)


@query("fts_rank", _RANK_SQL)
def fts_rank(p, spark, sf_dir):
    node = fulltext.parse("small rings or bolts")
    rows = live(p).select("id", hybrid.lexemes(p, letters=LETTERS).alias("tsv")).where(fulltext.matches(F.col("tsv"), node))
    return rows.select("id", F.round(fulltext.rank(node)(F.col("tsv")), 6).alias("rank"))


# (small <-> ring) & bolt | ring: each ring is an extent, and no other holds none
_RING_SQL = f"0.1::DOUBLE * len(list_filter({_TOKEN_LIST}, lambda x: x IN ({', '.join(map(repr, _FAMILIES['ring']))})))"
query("hybrid_full", _whole(fusion_sql("small ring bolts or rings", ["small ring"], 20, None, _PAGE_SQL.replace("LIMIT 10", "LIMIT 20"), _RING_SQL)))(
    lambda p, spark, sf_dir: _search(p, spark, sf_dir, '"small ring" bolts or rings', limit=20)
)

# the same from tables beside the catalogue: lexemes, trigrams, cells of vectors
_BUILT: dict[tuple[str, str, str], object] = {}


def _built(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[], object]):
    """What an application has built of some tables already."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def search_index(spark: SparkSession, sf_dir: str, letters: int | None = None) -> SearchIndex:
    made = lambda: SearchIndex(shared_folder(spark, "index")).build(ingest.with_lexemes(fixtures.projects(spark, sf_dir), letters=letters))
    return _built(spark, sf_dir, f"index of {letters or 'all'} letters", made)


def vector_cells(spark: SparkSession, sf_dir: str) -> VectorCells:
    return _built(spark, sf_dir, "cells", lambda: VectorCells(shared_folder(spark, "cells")).build(fixtures.embeddings(spark, sf_dir)))


def _current(found: DataFrame, p: DataFrame) -> DataFrame:
    """What an index found, of projects that are live and in the state that it was found in."""
    return found.join(live(p).select("id", F.col("updated_at").alias("version")), ["id", "version"], "left_semi")


@query("fts_rank_indexed", _whole(_RANK_SQL))
def fts_rank_indexed(p, spark, sf_dir):
    node = fulltext.parse("small rings or bolts")
    found = _current(search_index(spark, sf_dir).matches(spark, node), p)
    return found.select("id", F.round(fulltext.rank(node)(F.col("tsv")), 6).alias("rank"))


@query("trigram_match_indexed", f"SELECT id, round({trigram_sql(_RAW)}, 6) AS score FROM live WHERE {trigram_sql(_RAW)} >= 0.3")
def trigram_match_indexed(p, spark, sf_dir):
    return _current(search_index(spark, sf_dir).similar(spark, _RAW), p).select("id", F.round("score", 6).alias("score"))


query("hybrid_indexed", fusion_sql("small ring bolts or rings", ["small ring"], 20, None, _PAGE_SQL.replace("LIMIT 10", "LIMIT 20"), _RING_SQL))(
    lambda p, spark, sf_dir: _search(p, spark, sf_dir, '"small ring" bolts or rings', limit=20, index=search_index(spark, sf_dir, LETTERS))
)


@query("vector_topk_cells", f"SELECT id, round(distance, 6) AS distance FROM {_NEAREST}")
def vector_topk_cells(p, spark, sf_dir):
    found = vector_cells(spark, sf_dir).nearest(spark, _vector(spark, sf_dir), 80)
    return found.select("id", F.round("distance", 6).alias("distance"))


# published pairs of a word and its Porter2 stem: fixed values
STEMS = (
    "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist "
    "consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol "
    "consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson "
    "consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir "
    "conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc "
    "constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee "
    "kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight "
    "knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock "
    "knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot"
).split()


@query(
    "stem_cases",
    f"SELECT p_partkey, w[1] AS word, w[2] AS stem FROM (SELECT p_partkey, [[{'], ['.join(f'{w!r}, {s!r}' for w, s in zip(STEMS[::2], STEMS[1::2]))}]][p_partkey % {len(STEMS) // 2} + 1] AS w FROM part)",
)
def stem_cases(p, spark, sf_dir):
    """Each part is given one of the words by its key."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    word = F.get(F.array(*[F.lit(w) for w in STEMS[::2]]), (F.col("p_partkey") % (len(STEMS) // 2)).cast("int"))
    words = parts.select("p_partkey", word.alias("word"))
    return words.select("p_partkey", "word", F.get(english.english_lexemes(F.col("word")), F.lit(0))["lexeme"].alias("stem"))


_PART_FORMS = ["", "s", "ed", "ing", "ly"]


@query(
    "stem_part_words",
    "SELECT p_partkey, w || f AS word, CASE WHEN f = 'ly' AND NOT regexp_matches(w, '[cdeghkmnrt]$') THEN w || 'li' ELSE w END AS stem FROM "
    f"(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), (SELECT unnest({_PART_FORMS}) AS f) WHERE regexp_matches(w, '^(small|ring|bolt|widget)$')",
)
def stem_part_words(p, spark, sf_dir):
    """Words of the parts' names and forms of them."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    bases = parts.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).where(F.col("w").isin("small", "ring", "bolt", "widget"))
    words = bases.select("p_partkey", F.explode(F.array(*[F.concat("w", F.lit(f)) for f in _PART_FORMS])).alias("word"))
    return words.select("p_partkey", "word", F.get(english.english_lexemes(F.col("word")), F.lit(0))["lexeme"].alias("stem"))

# ingestion: feeds made of the catalogue itself

_FEED_A = """
SELECT airtable_id, CASE WHEN id % 6 = 0 THEN concat(ysws, 'x') ELSE ysws END AS ysws, approved_at,
  CASE WHEN id % 30 = 7 THEN 'https://example.com/moved/here.git' ELSE code_url END AS code_url, country, demo_url, description, github_username,
  CASE WHEN id % 9 = 0 THEN NULL ELSE hours END AS hours, github_stars, display_name, archived_demo, archived_repo, 'ignored' AS media_url
FROM {projects} WHERE id % 5 <> 0
UNION ALL
SELECT concat('new', airtable_id), ysws, approved_at, code_url, country, demo_url, description, github_username, hours, github_stars, display_name,
  archived_demo, archived_repo, media_url FROM {projects} WHERE id % 20 = 0
"""
_FEED_B = """
SELECT airtable_id, ysws, CASE WHEN id % 4 = 0 THEN 1 ELSE approved_at END AS approved_at, code_url, demo_url, github_username,
  true_hours, CASE WHEN id % 6 = 0 THEN NULL ELSE media_url END AS media_url FROM {projects} WHERE id % 3 <> 0
"""


def _merge_sql(feed: str, columns: list[str], fresh: str) -> str:
    differs = " OR ".join(f"p.{c} IS DISTINCT FROM f.{c}" for c in columns)
    cols = ", ".join(f"CASE WHEN c THEN f_{x} ELSE {x} END AS {x}" for x in columns)
    f_cols = ", ".join(f"f.{x} AS f_{x}" for x in columns)
    path = repository_path_sql("coalesce(code_url, '')")
    part = lambda n, most: f"CASE WHEN length(split_part({path}, '/', {n})) BETWEEN 1 AND {most} THEN split_part({path}, '/', {n}) END"
    rest = [c for c in ("true_hours", "media_url") if c not in columns] if "true_hours" not in columns else ["media_url"]
    return (
        f"SELECT airtable_id, {', '.join(columns)}, {', '.join(rest)}, changed, deleted, touched, {part(1, OWNER_MOST)} AS inferred_username, {part(2, REPO_MOST)} AS inferred_repo FROM ("
        f"SELECT airtable_id, {cols}, {', '.join(rest)}, c AS changed, NOT c AND deleted_at IS NOT NULL AS deleted, c AS touched FROM "
        f"(SELECT p.*, {f_cols}, f.airtable_id IS NOT NULL AND ({differs} OR p.deleted_at IS NOT NULL) AS c FROM projects p LEFT JOIN ({feed}) f USING (airtable_id)) "
        f"UNION ALL SELECT airtable_id, {', '.join(columns)}, {fresh}, true, false, true FROM ({feed}) WHERE airtable_id NOT IN (SELECT airtable_id FROM projects))"
    )


def _merged(df: DataFrame, columns: list[str], rest: list[str]) -> DataFrame:
    at = F.lit(NOW).cast("timestamp")
    # a row that stays as it is has the fixture's updated_at, its created_at, which for one project is NOW too
    touched = F.when(F.col("changed"), F.col("updated_at") == at).otherwise(~F.col("updated_at").eqNullSafe(F.col("created_at")))
    return df.select(
        "airtable_id", *columns, *rest, "changed", F.col("deleted_at").isNotNull().alias("deleted"), touched.alias("touched"),
        "inferred_username", "inferred_repo",
    )


@query("upsert_feed_a", _merge_sql(_FEED_A.format(projects="projects"), ingest.COLUMNS_A, "NULL, media_url"))
def upsert_feed_a(p, spark, sf_dir):
    feed = spark.sql(_FEED_A, projects=p)
    return _merged(ingest.upsert_a(p, feed, NOW), ingest.COLUMNS_A, ["true_hours", "media_url"])


@query("upsert_feed_b", _merge_sql(_FEED_B.format(projects="projects"), ingest.COLUMNS_B, "NULL"))
def upsert_feed_b(p, spark, sf_dir):
    return _merged(ingest.upsert_b(p, spark.sql(_FEED_B, projects=p), NOW), ingest.COLUMNS_B, ["media_url"])


def _differs_sql(columns: list[str]) -> str:
    return " OR ".join(f"p.{c} IS DISTINCT FROM f.{c}" for c in columns)


_APPLIED_SQL = (
    f"SELECT p.airtable_id, {', '.join(f'CASE WHEN f.airtable_id IS NULL THEN p.{c} ELSE f.{c} END AS {c}' for c in ingest.COLUMNS_A)}, p.media_url, f.airtable_id IS NULL AS deleted, "
    f"CASE WHEN f.airtable_id IS NULL THEN p.deleted_at IS NULL ELSE {_differs_sql(ingest.COLUMNS_A)} OR p.deleted_at IS NOT NULL END AS touched "
    f"FROM projects p LEFT JOIN ({_FEED_A.format(projects='projects')}) f USING (airtable_id) UNION ALL "
    f"SELECT airtable_id, {', '.join(ingest.COLUMNS_A)}, media_url, false, true FROM ({_FEED_A.format(projects='projects')}) WHERE airtable_id NOT IN (SELECT airtable_id FROM projects)"
)


@query("merge_feed_a", _APPLIED_SQL)
def merge_feed_a(p, spark, sf_dir):
    """The catalogue stored in buckets, and a feed merged into it."""
    catalogue = Catalogue(spark, shared_folder(spark, "catalogue"), 8).create(p)
    catalogue.merge(spark.sql(_FEED_A, projects=catalogue.read()), "a", NOW)
    at = F.lit(NOW).cast("timestamp")
    return catalogue.read().select(
        "airtable_id", *ingest.COLUMNS_A, "media_url", F.col("deleted_at").isNotNull().alias("deleted"), (F.col("updated_at") == at).alias("touched"),
    )


@query(
    "media_update",
    f"SELECT p.id, CASE WHEN f.airtable_id IS NULL THEN p.media_url ELSE f.media_url END AS media_url, "
    f"f.airtable_id IS NOT NULL AND p.media_url IS DISTINCT FROM f.media_url AS changed FROM projects p LEFT JOIN ({_FEED_B.format(projects='projects')}) f USING (airtable_id)",
)
def media_update(p, spark, sf_dir):
    return ingest.update_media(p, spark.sql(_FEED_B, projects=p), NOW).select("id", "media_url", "changed")


@query(
    "soft_delete_missing",
    f"SELECT id, deleted_at IS NOT NULL OR airtable_id NOT IN (SELECT airtable_id FROM ({_FEED_B.format(projects='projects')})) AS deleted, "
    f"deleted_at IS NULL AND airtable_id NOT IN (SELECT airtable_id FROM ({_FEED_B.format(projects='projects')})) AS changed FROM projects",
)
def soft_delete_missing(p, spark, sf_dir):
    return ingest.soft_delete(p, spark.sql(_FEED_B, projects=p), NOW).select("id", F.col("deleted_at").isNotNull().alias("deleted"), "changed")


@query(
    "embed_pending",
    "SELECT id AS project_id, trim(coalesce(display_name, '') || ' ' || coalesce(description, ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM live "
    "WHERE length(description) >= 35 AND id NOT IN (SELECT project_id FROM project_embeddings)",
)
def embed_pending(p, spark, sf_dir):
    return embed.pending(p, fixtures.embeddings(spark, sf_dir))


@query("embed_vectors", "SELECT id AS project_id, 32 AS dimensions, 'hashing-32' AS model FROM live WHERE length(description) >= 35 AND id NOT IN (SELECT project_id FROM project_embeddings)")
def embed_vectors(p, spark, sf_dir):
    made = embed.embed_pending(p, fixtures.embeddings(spark, sf_dir), embed.HashingEmbedder(32), NOW)
    return made.select("project_id", F.size("embedding").alias("dimensions"), "model")


_TEXTS = "(SELECT id, trim(coalesce(display_name, '') || ' ' || coalesce(description, ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM live WHERE length(description) >= 35)"


@query("embed_cached", f"SELECT id, first % 6 = 0 AS hit, CASE WHEN first % 6 = 0 THEN 1 ELSE 16 END AS dimensions FROM (SELECT id, min(id) OVER (PARTITION BY text) AS first FROM {_TEXTS})")
def embed_cached(p, spark, sf_dir):
    """A cache of a third of the texts, half of it expired: what is not held is embedded."""
    texts = live(p).where(F.length("description") >= 35).select("id", embed.embed_text().alias("text"))
    embedder = embed.HashingEmbedder(16)
    first = texts.groupBy("text").agg(F.min("id").alias("first")).where("first % 3 = 0")
    expires = F.lit(NOW).cast("timestamp") + F.when(F.col("first") % 2 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL -1 HOUR"))
    vector = F.array(F.col("first").cast("float"))
    cache = first.select(cached.text_key(embedder.model, F.col("text")).alias("key"), vector.alias("embedding"), F.lit(embedder.model).alias("model"), expires.alias("expires_at"))
    answers, _ = cached.embed_cached(texts, cache, embedder, NOW)
    return answers.select("id", "hit", F.size("embedding").alias("dimensions"))


_ASKED_SQL = "SELECT id, CASE id % 5 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN 'none' || CAST(id AS VARCHAR) ELSE airtable_id END AS key FROM projects"


@query(
    "media_cached",
    f"SELECT a.key, CASE WHEN a.id % 4 = 0 THEN CASE WHEN a.id % 8 = 0 THEN NULL ELSE 'held' END WHEN a.id % 5 = 1 THEN NULL ELSE media_url END AS media_url, a.id % 4 = 0 AS hit "
    f"FROM ({_ASKED_SQL}) a JOIN projects p USING (id)",
)
def media_cached(p, spark, sf_dir):
    """Every project asked for by id, external id or a name that no project has; a quarter is held, some as nothing, and a quarter has expired."""
    asked = p.select("id", F.expr("CASE id % 5 WHEN 0 THEN CAST(id AS STRING) WHEN 1 THEN concat('none', CAST(id AS STRING)) ELSE airtable_id END AS key"))
    url = F.when(F.col("id") % 8 != 0, F.lit("held"))
    expires = F.lit(NOW).cast("timestamp") + F.when(F.col("id") % 4 == 0, F.expr("INTERVAL 1 SECOND")).otherwise(F.expr("INTERVAL 0 SECOND"))
    cache = asked.where("id % 2 = 0").select("key", url.alias("media_url"), expires.alias("expires_at"))
    answers, _ = cached.media_cached(asked, p, cache, NOW)
    return answers.select("key", "media_url", "hit")


query("embeddings_of_projects", "SELECT project_id, model FROM project_embeddings WHERE project_id IN (SELECT id FROM projects)")(
    lambda p, spark, sf_dir: embed.with_parent(fixtures.embeddings(spark, sf_dir), p).select("project_id", "model")
)

# decoding: fixed cases of each decoder and what they give
DECODED = [
    ("timestamp", "1700000000", "1700000000"), ("timestamp", '"2025-01-01"', "1735689600"), ("timestamp", '""', None), ("timestamp", '"null"', None), ("timestamp", "null", None),
    ("int", "3", "3"), ("int", '"7"', None), ("int", "null", None),
    ("string", '"a"', "a"), ("string", '""', ""), ("string", '"null"', None), ("string", '["a","b"]', "a"), ("string", '["null"]', None), ("string", "[]", None),
    ("string", '[null,"q"]', None), ("string", "null", None),
    ("float", "1.5", "1.5"), ("float", "2", "2.0"), ("float", "[1.5]", "1.5"), ("float", '"x"', None), ("float", "null", None),
    ("screenshot", '"u"', "u"), ("screenshot", '""', None), ("screenshot", '"null"', None), ("screenshot", '[{"url":"u"}]', "u"), ("screenshot", '{"url":""}', None),
    ("screenshot", '{"a":{"url":"u"}}', "u"), ("screenshot", '{"url":3,"b":"v"}', "v"), ("screenshot", "5", None),
]
_quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_CASE_SQL = "(SELECT row_number() OVER () - 1 AS n, * FROM (VALUES " + ", ".join(f"({_quote(d)}, {_quote(j)}, CAST({_quote(v)} AS VARCHAR))" for d, j, v in DECODED) + ") AS t(decoder, json, value))"
#: Values of the events in the forms that feeds give them.
_FORMS = {
    "timestamp": ("CAST(user_id AS VARCHAR)", "CAST(user_id AS VARCHAR)"),
    "int": ("CAST(event_id AS VARCHAR)", "CAST(event_id AS VARCHAR)"),
    "string": ("concat('[\"', event_type, '\", 1]')", "event_type"),
    "float": ("concat('[', CAST(event_id AS VARCHAR), '.5]')", "concat(CAST(event_id AS VARCHAR), '.5')"),
    "screenshot": ("concat('[null, {\"z\": {\"url\": \"last\"}, \"a\": [[{\"url\": \"', event_type, '\"}]]}]')", "event_type"),
}


#: Numbers of the events have one digit behind the point; as doubles they would have exponents from ten millions on.
_number = lambda x: F.when(F.abs(x) < 1e7, x.cast("string")).otherwise(x.cast("decimal(38,1)").cast("string"))
_DECODERS = {
    "timestamp": feeds.timestamp, "int": feeds.null_int, "string": feeds.null_string, "float": lambda record, path: _number(feeds.null_float(record, path)),
    "screenshot": feeds.screenshot,
}


def _decoded(record: str) -> dict[str, Column]:
    """What each decoder makes of a record's field of its name. The record must be a column already: decoders refer to it many times."""
    return {d: f(F.col(record), f"$.{d}").cast("string") for d, f in _DECODERS.items()}


@query("decode_variants", f"SELECT event_id, decoder, json, c.value AS value FROM events JOIN {_CASE_SQL} c ON n = event_id % {len(DECODED)}")
def decode_variants(p, spark, sf_dir):
    """Each event is given one of the cases by its id: a record with one field, named after its decoder."""
    cases = F.array(*[F.struct(F.lit(d).alias("decoder"), F.lit(j).alias("json")) for d, j, _ in DECODED])
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get(cases, (F.col("event_id") % len(DECODED)).cast("int")).alias("c"))
    rows = events.select("event_id", "c.*").withColumn("record", F.parse_json(F.concat(F.lit('{"'), "decoder", F.lit('":'), "json", F.lit("}"))))
    value = F.coalesce(*[F.when(F.col("decoder") == d, v) for d, v in _decoded("record").items()])
    return rows.select("event_id", "decoder", "json", value.alias("value"))


@query("decode_events", " UNION ALL ".join(f"SELECT event_id, '{d}' AS decoder, {value} AS value FROM events" for d, (_, value) in _FORMS.items()))
def decode_events(p, spark, sf_dir):
    """Columns of the events as JSON of several forms, fields of one record an event, and what the decoders make of them."""
    fields = [F.concat(F.lit(f'"{d}":'), F.coalesce(F.expr(form.replace("VARCHAR", "STRING")), F.lit("null"))) for d, (form, _) in _FORMS.items()]
    record = F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", record.alias("record"))
    return rows.select("event_id", *[v.alias(d) for d, v in _decoded("record").items()]).unpivot("event_id", list(_FORMS), "decoder", "value")


# presentation

_SCORES = "(SELECT id, (id % 101) / 100.0::DOUBLE AS score FROM live)"
_scores = lambda p: live(p).select("id", (F.col("id") % 101 / F.lit(100.0)).alias("score"))
query("score_brackets", f"SELECT id, CASE WHEN score <= 0.25 THEN 1 WHEN score <= 0.5 THEN 2 WHEN score <= 0.75 THEN 3 ELSE 4 END AS bracket FROM {_SCORES}")(
    lambda p, *_: _scores(p).select("id", present.score_bracket(F.col("score")).alias("bracket"))
)
query("low_score_filter", f"SELECT id FROM {_SCORES} WHERE score >= 0.25")(lambda p, *_: present.hide_low_scores(_scores(p)).select("id"))
query("low_score_filter_none", f"SELECT id FROM {_SCORES}")(
    lambda p, *_: present.hide_low_scores(_scores(p).withColumn("score", F.col("score") / 5)).select("id")
)
_NUM = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {c}) END"
query(
    "hours_label",
    f"SELECT id, CASE WHEN true_hours IS NULL AND hours IS NULL THEN '—' WHEN true_hours IS NULL THEN CAST(hours AS VARCHAR) || ' h' "
    f"WHEN hours IS NULL OR true_hours = hours THEN {_NUM('true_hours')} || ' h' ELSE {_NUM('true_hours')} || ' h (' || CAST(hours AS VARCHAR) || ' h claimed)' END AS label FROM live",
)(lambda p, *_: live(p).select("id", present.hours_label(F.col("true_hours"), F.col("hours")).alias("label")))
query(
    "card_texts",
    "SELECT id, coalesce(inferred_repo, 'Project #' || CAST(id AS VARCHAR)) AS title, CASE WHEN length(description) > 120 THEN left(description, 120) || '…' ELSE description END AS card, "
    "CASE WHEN approved_at IS NULL THEN '—' ELSE strftime(make_timestamp(approved_at * 1000000), '%Y-%m-%d') END AS approved, "
    "CASE WHEN coalesce(inferred_username, github_username) IS NULL THEN coalesce(display_name, '—') WHEN display_name IS NULL THEN coalesce(inferred_username, github_username) "
    "ELSE display_name || ' (' || coalesce(inferred_username, github_username) || ')' END AS who FROM live",
)(
    lambda p, *_: live(p).select(
        "id", present.title(F.col("inferred_repo"), F.col("id")).alias("title"), present.truncate(F.col("description"), 120).alias("card"),
        present.approved_day(F.col("approved_at")).alias("approved"),
        present.user_label(F.col("github_username"), F.col("inferred_username"), F.col("display_name")).alias("who"),
    )
)
query(
    "previews",
    r"SELECT id, CASE WHEN length(t) > 120 THEN rtrim(left(t, 120)) || '...' ELSE t END AS preview FROM (SELECT id, trim(regexp_replace(description, '\s+', ' ', 'g')) AS t FROM live)",
)(lambda p, *_: live(p).select("id", present.preview(F.col("description")).alias("preview")))
query("page_counts", "SELECT per_page, greatest(1, (count(*) + per_page - 1) // per_page) AS pages FROM live, (VALUES (20), (50), (100)) AS v(per_page) GROUP BY per_page")(
    lambda p, spark, _: live(p).agg(F.count("*").alias("n")).select("n", F.explode(F.array(F.lit(20), F.lit(50), F.lit(100))).alias("per_page")).select(
        "per_page", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("per_page"))).cast("long").alias("pages")
    )
)
