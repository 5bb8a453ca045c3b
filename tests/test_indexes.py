"""Tables beside the catalogue: what they find, what they read, and how they follow changes."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from findery.functions import fulltext
from findery.operators import ingest, scoring
from findery.operators.filters import live
from findery.plans import search as hybrid
from findery.sources import fixtures
from findery.sources.catalogue import Catalogue
from findery.sources.inverted import SearchIndex
from findery.sources.vectors import VectorCells

SF = "/root/testdata/sf0.001"
ASKED = ['"small ring" bolts or rings', "small rings", "bolt user:user1", "red -widget", "-widget", '"no such words"', "", "zzzzqq", '"the"', "smal rin"]


@pytest.fixture(scope="module")
def projects(spark):
    return ingest.with_lexemes(fixtures.projects(spark, SF)).persist()


@pytest.fixture(scope="module")
def index(projects, tmp_path_factory):
    return SearchIndex(str(tmp_path_factory.mktemp("index")), buckets=16).build(projects)


def scores(df):
    return {r.id: tuple(None if v is None else round(v, 9) for v in (r.fts, r.phrase, r.literal, r.trigram)) for r in df.groupBy("id").agg(*[F.max(c).alias(c) for c in ("fts", "phrase", "literal", "trigram")]).collect()}


def partitions(df):
    """Buckets or cells that a scan's partition filter names."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [len(set(re.findall(r"\d+", m.split("IN", 1)[1]))) if "IN" in m else 1 for m in re.findall(r"PartitionFilters: \[([^\]]*(?:bucket|cell)[^\]]*)\]", plan)]


@pytest.mark.parametrize("text", ASKED)
def test_same_scores_as_the_scan(projects, index, text):
    parsed = hybrid.parse_filters(text)
    want = {k: v for k, v in scores(hybrid.lexical_scores(projects, parsed)).items() if any(x is not None for x in v)}
    got = {k: v for k, v in scores(hybrid.indexed_scores(projects, parsed, index)).items() if any(x is not None for x in v)}
    assert got == want


def test_reads_partitions_of_its_terms(spark, index):
    node = fulltext.parse("small rings or bolts")
    assert partitions(index.matches(spark, node)) == [3]
    near = index.similar(spark, "bolt")
    assert 0 < partitions(near)[0] <= len(set(fulltext.all_words(fulltext.parse("bolt")))) + 5 < 16
    with pytest.raises(ValueError):
        index.matches(spark, fulltext.parse("-widget"))


def test_candidates_of_trigrams(spark, projects, index):
    """Length and count bounds leave the rows that match, and no others."""
    for query in ("small ring", "user5", "x", "a b c d e f g h", "éé", ""):
        want = {r.id: round(r.s, 9) for r in live(projects).select("id", scoring.trigram_score(query).alias("s")).where("s >= 0.3").collect()}
        assert {r.id: round(r.score, 9) for r in index.similar(spark, query).collect()} == want


def test_refresh_of_changes_only(spark, projects, tmp_path):
    index = SearchIndex(str(tmp_path), buckets=8).build(projects)
    before = index.lexemes.of(spark, ["small"]).count()
    feed = projects.where("deleted_at IS NULL").select("airtable_id", *ingest.COLUMNS_A, "media_url")
    feed = feed.where("id % 10 <> 3").withColumn("description", F.when(F.expr("airtable_id LIKE '%7'"), F.lit("small quokkas here")).otherwise(F.col("description")))
    feed = feed.union(feed.limit(1).withColumn("airtable_id", F.lit("new1")).withColumn("display_name", F.lit("quokka bolt")))
    snapshot = ingest.apply_feed_a(projects, feed, datetime(2025, 1, 1)).persist()
    changed = snapshot.where("changed AND deleted_at IS NULL").count()
    assert 0 < changed < snapshot.count() / 3
    index.refresh(snapshot)
    added = index.lexemes.of(spark, ["small"]).count() - before
    assert 0 < added <= 3 * changed
    fresh = SearchIndex(str(tmp_path / "fresh"), buckets=8).build(snapshot)
    for text in ("small quokkas", "quokka", "small ring"):
        parsed = hybrid.parse_filters(text)
        now = scores(hybrid.indexed_scores(snapshot, parsed, index))
        assert now == scores(hybrid.indexed_scores(snapshot, parsed, fresh)) == scores(hybrid.lexical_scores(snapshot, parsed))
    assert any("quokka" in (r.display_name or "") for r in hybrid.search(snapshot, None, "quokkas bolt", index=index).collect())


def test_vector_cells(spark, tmp_path):
    rows = fixtures.embeddings(spark, "/root/testdata/sf0.01").select("project_id", "embedding")
    odd = spark.createDataFrame([(90_001, [0.0] * 64), (90_002, [1.0]), (90_003, None)], rows.schema)
    cells = VectorCells(str(tmp_path)).build(rows.union(odd), cells=16)
    assert spark.read.parquet(f"{tmp_path}/data").count() == rows.count()
    found, total = 0, 0
    asked = [list(r.embedding) for r in rows.orderBy("project_id").limit(400).where("project_id % 20 = 0").collect()]
    for q in asked:
        want = [(r.id, round(r.distance, 9)) for r in hybrid.nearest(rows, q, 10).collect()]
        assert [(r.id, round(r.distance, 9)) for r in cells.nearest(spark, q, 10).collect()] == want
        near = cells.nearest(spark, q, 10, share=0.98)
        assert partitions(near) == [cells.probes(0.98)]
        found, total = found + len({i for i, _ in want} & {r.id for r in near.collect()}), total + 10
    print(f"{cells.probes(0.98)} of 16 cells read, recall {found / total:.3f} on {len(asked)} queries")
    assert found / total >= 0.95
    assert cells.nearest(spark, [0.0] * 64, 10).count() == 0 and cells.nearest(spark, [1.0], 10).count() == 0


def test_cells_of_groups_are_few(spark, tmp_path):
    """Vectors that lie in groups: an exact search reads the cells of one group."""
    import random

    rng = random.Random(1)
    centers = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centers[i % 12]]) for i in range(600)]
    df = spark.createDataFrame(rows, "project_id int, embedding array<float>")
    cells = VectorCells(str(tmp_path)).build(df, cells=12)
    q = centers[5]
    assert len(cells.reachable(spark, q, 10)) <= 6 and cells.probes(0.95) <= 4
    assert [r.id for r in cells.nearest(spark, q, 10).collect()] == [r.id for r in hybrid.nearest(df, q, 10).collect()]


def test_entries_are_made_once(spark, projects, tmp_path):
    """An append works its entries out in one pass, and small batches of text go to the stemmer."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    entries = projects.select(F.lit("t").alias("term"), "id", F.col("updated_at").alias("version"))
    SearchIndex(str(tmp_path)).lexemes.append(entries.mapInArrow(count, entries.schema))
    assert made.value == projects.count() == spark.read.parquet(f"{tmp_path}/lexemes").count()


def test_batches_of_text_are_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        ingest.with_lexemes(fixtures.projects(spark, SF))
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)


def test_a_bucket_is_written_by_several_tasks(spark, projects, tmp_path):
    catalogue = Catalogue(spark, str(tmp_path), 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalogue.create(projects)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.rglob("*.parquet"))) > 1 and catalogue.read().count() == projects.count()
