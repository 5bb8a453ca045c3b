"""Every catalogue query equals its SQL; those without SQL run."""

import pytest
from compare import TABLES, assert_same
from pyspark.sql import functions as F

from findery.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(found, SF, ORACLES[name])
    else:
        assert found.count() > 0


def test_known_answers(spark):
    rows = QUERIES["filter_sort_page_total"](spark, SF).collect()
    assert rows[0].total == 13 and len(rows) == 5
    near = {r.id: r.distance for r in QUERIES["vector_topk"](spark, "/root/testdata/sf0.01").collect()}
    assert {k: near[k] for k in (0, 365, 334, 387, 423)} == {0: 0.0, 365: 0.630006, 334: 0.637278, 387: 0.668861, 423: 0.703066}


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 20
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["upsert_feed_a", "upsert_feed_b", "merge_feed_a"])
def test_project_created_as_the_feed_comes(spark, tmp_path, name):
    """The minute of NOW is the created_at of project 527040, which the feeds leave alone."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    made = {"documents": read("documents").withColumn("doc_id", F.col("doc_id") + 526_990), "part": read("part").withColumn("p_partkey", F.col("p_partkey") + 526_990)}
    for t in TABLES:
        made.get(t, read(t)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert_same(QUERIES[name](spark, str(tmp_path)), tmp_path, ORACLES[name])


@pytest.mark.parametrize("name", ["decode_events", "decode_variants"])
def test_decoded_events(spark, tmp_path, name):
    """Numbers of eight digits and nulls, and a record that is parsed once a row."""
    for t in TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t == "events":
            null = lambda c, n: F.when(F.col("event_id") % n != 0, F.col(c))
            df = df.withColumns({"user_id": null("user_id", 7), "event_type": null("event_type", 5), "event_id": F.col("event_id") + 9_999_950})
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") == 1
    assert_same(found, tmp_path, ORACLES[name])


@pytest.fixture(scope="module")
def far_words(spark, tmp_path_factory):
    """Tables whose texts have their only bolts and rings beyond the first thousand letters; project 7 has most rings."""
    folder = tmp_path_factory.mktemp("far")
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "documents":
            end = F.when(F.col("doc_id") == 7, F.lit(" bolts" + 60 * " rings")).otherwise(F.lit(" bolts"))
            df = df.withColumn("text", F.concat(F.lit(300 * "word "), end))
        df.write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_indexed_words_far_down_a_text(spark, far_words):
    found = QUERIES["fts_rank_indexed"](spark, far_words)
    described = spark.read.parquet(f"{far_words}/documents.parquet").where("doc_id % 13 <> 0 AND doc_id % 17 <> 0")
    assert {r.doc_id for r in described.select("doc_id").collect()} <= {r.id for r in found.collect()}
    assert_same(found, far_words, ORACLES["fts_rank_indexed"])


def test_search_finds_words_far_down_a_text(spark, far_words):
    found = QUERIES["hybrid_full"](spark, far_words)
    assert max(found.collect(), key=lambda r: r.score).id == 7
    assert_same(found, far_words, ORACLES["hybrid_full"])
