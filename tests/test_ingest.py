"""Feeds: decoding, upserts, tombstones, snapshots, streams, embedding and presentation."""

import json
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from findery.functions import present
from findery.operators import embed, ingest
from findery.schema import PROJECTS
from findery.sources import feeds
from findery.sources.catalogue import Catalogue, exclusive
from findery.sources.inverted import SearchIndex
from findery.streaming.feed_stream import follow

T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1)
A = {
    "id": "k1", "ysws": "prog", "approved_at": 1700000000, "code_url": "https://example.com/u/r.git", "country": None, "demo_url": "", "description": "d",
    "github_username": "u", "screenshot_url": [{"url": "no"}], "display_name": "n", "archived_demo": None, "archived_repo": "null", "hours": 3,
}


def records(spark, rows):
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return df.select(F.parse_json("value").alias("record"))


def feed_a(spark, *changes):
    return feeds.decode_feed_a(records(spark, [A | {"screenshot_url": "m"} | c for c in changes]))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], PROJECTS)


def rows(df):
    return {r.airtable_id: r for r in df.collect()}


def test_decoding(spark):
    (r,) = feeds.decode_feed_a(records(spark, [A | {"screenshot_url": None}, A | {"ysws": "null", "screenshot_url": None}])).collect()
    assert (r.airtable_id, r.demo_url, r.archived_repo, r.github_stars, r.hours, r.approved_at) == ("k1", "", None, 0, 3, 1700000000)
    b = {"id": "k2", "fields": {"YSWS–Name": ["p", "q"], "Hours Spent": [2], "Approved At": "2025-01-01", "Screenshot": [{"x": {"url": "deep"}}]}}
    (r,) = feeds.decode_feed_b(records(spark, [b, {"id": "k3", "fields": {}}])).collect()
    assert (r.ysws, r.true_hours, r.approved_at, r.media_url, r.code_url) == ("p", 2.0, 1735689600, "deep", None)


@pytest.mark.parametrize("change", [
    {"approved_at": 1.5}, {"approved_at": "x"}, {"approved_at": True}, {"hours": 3.5}, {"hours": []}, {"country": 3}, {"country": {}}, {"github_stars": None}, {"id": None}, {"id": 4},
])
def test_what_cannot_be_decoded_fails_the_run(spark, change):
    with pytest.raises(Exception, match="cannot decode"):
        feeds.decode_feed_a(records(spark, [A | {"screenshot_url": None} | change])).collect()


def test_absent_fields_fail(spark):
    with pytest.raises(Exception, match="cannot decode"):
        feeds.decode_feed_a(records(spark, [{k: v for k, v in A.items() if k != "country"}])).collect()
    for bad in ([], ["x"], True):
        with pytest.raises(Exception, match="cannot decode"):
            feeds.decode_feed_b(records(spark, [{"id": "k", "fields": {"YSWS–Name": "p", "Hours Spent": bad}}])).collect()


def slow_url(x):
    if isinstance(x, str):
        return x if x and x != "null" else None
    if isinstance(x, dict) and isinstance(x.get("url"), str):
        return x["url"] or None
    inner = [x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else []
    return next((u for y in inner if (u := slow_url(y)) is not None), None)


def test_urls_in_nested_values(spark):
    import random

    rng = random.Random(5)

    def made(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return [None, 3, rng.choice(["", "null", "u1", "u2"]), True][kind]
        if kind == 4:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return {k: made(depth - 1) for k in rng.sample(["a", "url", "B", "é", "z"], rng.randrange(4))}

    values = [made(5) for _ in range(400)]
    deep = "u"
    for i in range(feeds.LEVELS):
        deep = [deep] if i % 2 else {"k": deep}
    df = records(spark, [{"x": v} for v in [*values, deep]]).withColumn("n", F.monotonically_increasing_id())
    got = df.select("n", F.to_json("record").alias("j"), feeds.screenshot(F.col("record"), "$.x").alias("u"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert r.u == slow_url(json.loads(r.j)["x"]), r.j
    with pytest.raises(Exception, match="cannot decode"):
        records(spark, [{"x": [deep]}]).select(feeds.screenshot(F.col("record"), "$.x")).collect()


def test_nothing_after_the_first_url_is_looked_at(spark):
    deep = "u"
    for _ in range(feeds.LEVELS + 1):
        deep = [deep]
    df = records(spark, [{"x": [None, "null", {"b": [deep], "a": ["first"]}, deep]}, {"x": {"url": "", "a": deep}}, {"x": [{"url": "null"}]}])
    assert [r.u for r in df.select(feeds.screenshot(F.col("record"), "$.x").alias("u")).collect()] == ["first", None, "null"]


def test_scenarios(spark, empty):
    one = ingest.apply_feed_a(empty, feed_a(spark, {}, {"id": "k2"}), T1).persist()
    got = rows(one)
    assert sorted(r.id for r in got.values()) == [1, 2] and ingest.changes(one) == 2
    assert (got["k1"].inferred_username, got["k1"].inferred_repo, got["k1"].has_media, got["k1"].media_url) == ("u", "r", True, "m")
    base = one.drop("changed")
    # nothing changes: media is written on insert only
    same = ingest.apply_feed_a(base, feed_a(spark, {"screenshot_url": "other"}, {"id": "k2"}), T2)
    assert ingest.changes(same) == 0 and rows(same)["k1"].updated_at == T1 and rows(same)["k1"].media_url == "m"
    # a change, a tombstone and an insert
    two = ingest.apply_feed_a(base, feed_a(spark, {"hours": 4}, {"id": "k3"}), T2).persist()
    got = rows(two)
    assert got["k1"].hours == 4 and got["k1"].updated_at == T2 and got["k2"].deleted_at == T2 and got["k3"].id == 3 and ingest.changes(two) == 3
    # the tombstone falls
    three = rows(ingest.apply_feed_a(two.drop("changed"), feed_a(spark, {"hours": 4}, {"id": "k2"}, {"id": "k3"}), T2))
    assert three["k2"].deleted_at is None and three["k2"].changed and not three["k1"].changed
    # two feeds with different keys flip each other's rows, unless the scope is their own
    b = feeds.decode_feed_b(records(spark, [{"id": "b1", "fields": {"YSWS–Name": "p"}}]))
    assert rows(ingest.apply_feed_b(base, b, T2))["k1"].deleted_at == T2
    assert rows(ingest.apply_feed_b(base, b, T2, scope=F.col("airtable_id").startswith("b")))["k1"].deleted_at is None


def test_guards(spark, empty):
    with pytest.raises(ingest.DuplicateKey):
        ingest.upsert_a(empty, feed_a(spark, {}, {}), T1)
    base = ingest.upsert_a(empty, feed_a(spark, {}), T1).drop("changed").persist()
    none = feed_a(spark, {"ysws": None})
    with pytest.raises(ValueError, match="empty feed"):
        ingest.soft_delete(base, none, T2)
    assert ingest.changes(ingest.soft_delete(base, none, T2, allow_empty=True)) == 1
    media = feeds.decode_feed_b(records(spark, [{"id": "k1", "fields": {"YSWS–Name": "p", "Screenshot": None}}]))
    (r,) = ingest.update_media(base, media, T2).collect()
    assert r.media_url is None and not r.has_media and r.changed and r.updated_at == T2


def test_ids_have_no_gaps(spark, empty):
    many = feed_a(spark, *[{"id": f"k{i}"} for i in range(700)])
    assert sorted(r.id for r in ingest.upsert_a(empty, many, T1).collect()) == list(range(1, 701))


def files(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("bucket=*/*.parquet")}


def test_merge_rewrites_what_changes(spark, empty, tmp_path):
    base = ingest.upsert_a(empty, feed_a(spark, *[{"id": f"k{i}", "hours": i} for i in range(300)]), T1).drop("changed")
    catalogue = Catalogue(spark, str(tmp_path), 16).create(base)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catalogue.create(base)
    assert sorted(catalogue.read().columns) == sorted(base.columns) and rows(catalogue.read()) == rows(base)
    # one per cent: two rows change, one goes, one comes
    changes = [{"id": f"k{i}", "hours": i, "description": "new" if i in (7, 8) else "d"} for i in range(300) if i != 50] + [{"id": "fresh"}]
    before, feed = files(tmp_path), feed_a(spark, *changes)
    got = catalogue.merge(feed, "a", T2)
    want = ingest.apply_feed_a(base, feed, T2)
    assert (got.changed, 1 <= len(got.buckets) <= 4) == (4, True) == (want.where("changed").count(), True)
    assert got.written == catalogue.read(got.buckets).count() < 150
    assert rows(catalogue.read()) == rows(want.drop("changed"))
    after = files(tmp_path)
    assert {f for f in before if before[f] == after.get(f)} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in got.buckets}
    assert {r.airtable_id for r in catalogue.changes(got, T2).collect()} == {"k7", "k8", "k50", "fresh"}
    # the same again changes nothing and writes nothing
    again = catalogue.merge(feed, "a", datetime(2025, 3, 1))
    assert (again.changed, again.buckets) == (0, []) and files(tmp_path) == after
    with pytest.raises(ValueError, match="empty"):
        catalogue.merge(feed.limit(0), "a", T2)
    with pytest.raises(ingest.DuplicateKey):
        catalogue.merge(feed.union(feed.limit(1)), "a", T2)
    gone = catalogue.merge(feed.limit(0), "a", T2, allow_empty=True, scope=F.col("airtable_id").isin("k1", "k2"))
    assert gone.changed == 2 and rows(catalogue.read())["k3"].deleted_at is None


def test_merge_of_the_other_feed(spark, empty, tmp_path):
    base = ingest.upsert_a(empty, feed_a(spark, {}, {"id": "k2"}, {"id": "k3"}), T1).drop("changed")
    catalogue = Catalogue(spark, str(tmp_path), 4).create(base)
    feed = base.where("airtable_id <> 'k3'").select("airtable_id", *ingest.COLUMNS_B, F.when(F.col("airtable_id") == "k1", F.col("media_url")).alias("media_url"))
    got = catalogue.merge(feed, "b", T2)  # k2 loses its media, k3 goes
    assert got.changed == 2 and rows(catalogue.read()) == rows(ingest.apply_feed_b(base, feed, T2).drop("changed"))


def test_find_reads_one_bucket(spark, empty, tmp_path):
    base = ingest.upsert_a(empty, feed_a(spark, *[{"id": f"k{i}", "hours": i} for i in range(100)]), T1).drop("changed")
    catalogue = Catalogue(spark, str(tmp_path), 16).create(base)
    found = catalogue.find("k42")
    assert [(r.airtable_id, r.hours) for r in found.collect()] == [("k42", 42)] and catalogue.find("none").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(airtable_id,k42)" in plan
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    leaf.executeColumnar().count()
    assert leaf.metrics().apply("numFiles").value() == 1 < len(files(tmp_path))


def test_one_run_at_a_time(spark, tmp_path):
    with exclusive(spark, str(tmp_path)) as one, exclusive(spark, str(tmp_path)) as two:
        assert one and not two
    with exclusive(spark, str(tmp_path)) as three:
        assert three
        with exclusive(spark, str(tmp_path), stale=-1) as lost:
            assert lost


def test_stream(spark, empty, tmp_path):
    store = Catalogue(spark, str(tmp_path / "projects"), 4).create(empty)
    index = SearchIndex(str(tmp_path / "index"), buckets=4)
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.json").write_text(json.dumps([A | {"screenshot_url": None}, A | {"id": "k2", "screenshot_url": None}], indent=1))
    follow(spark, str(landing), store, "a", str(tmp_path / "cp"), clock=lambda: T1, index=index).awaitTermination(120)
    (landing / "2.json").write_text(json.dumps([A | {"screenshot_url": None}]))
    follow(spark, str(landing), store, "a", str(tmp_path / "cp"), clock=lambda: T2).awaitTermination(120)
    got = rows(store.read())
    assert set(got) == {"k1", "k2"} and got["k1"].deleted_at is None and got["k2"].deleted_at == T2
    assert {(r.id, r.version) for r in index.lexemes.of(spark, ["prog"]).collect()} == {(got["k1"].id, T1), (got["k2"].id, T1)}


@pytest.fixture
def server():
    """A feed on a local port: .payload is served, with .tag as its state; .asked counts requests by method."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.server.asked[self.command] = self.server.asked.get(self.command, 0) + 1
            if self.server.failures:
                self.server.failures -= 1
                self.send_error(503)
                return
            body = json.dumps(self.server.payload).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("ETag", self.server.tag)
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *_):
            pass

    at = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    at.payload, at.tag, at.asked, at.failures = [], "one", {}, 0
    threading.Thread(target=at.serve_forever, daemon=True).start()
    yield at
    at.shutdown()


def test_feed_as_a_data_source(spark, empty, tmp_path, server):
    from findery.sources.feed_source import FeedSource
    from findery.streaming.feed_stream import follow_url

    url = f"http://127.0.0.1:{server.server_port}/"
    server.payload, server.failures = [A | {"screenshot_url": None}, A | {"id": "k2", "screenshot_url": None}], 1
    spark.dataSource.register(FeedSource)
    batch = spark.read.format("json_feed").option("url", url).load()
    assert {r.airtable_id for r in feeds.decode_feed_a(feeds.records(batch)).collect()} == {"k1", "k2"}
    catalogue = Catalogue(spark, str(tmp_path / "projects"), 4).create(empty)
    run = lambda at: follow_url(spark, url, catalogue, "a", str(tmp_path / "cp"), clock=lambda: at).awaitTermination(120)
    run(T1)
    assert set(rows(catalogue.read())) == {"k1", "k2"}
    # a restarted stream passes over what it has applied, and applies what is new
    seen = server.asked["GET"]
    run(T2)
    assert server.asked["GET"] == seen and rows(catalogue.read())["k1"].updated_at == T1
    server.payload, server.tag = server.payload[:1], "two"
    run(T2)
    got = rows(catalogue.read())
    assert server.asked["GET"] > seen and got["k2"].deleted_at == T2 and got["k1"].updated_at == T1


def test_caches_as_tables(spark, empty):
    from datetime import timedelta

    from findery.operators import cached

    none = spark.createDataFrame([], cached.VECTORS)
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "n int, text string")
    one, cache = cached.embed_cached(texts, none, embed.HashingEmbedder(8), T1)
    got = {r.n: r for r in one.collect()}
    want = embed.HashingEmbedder(8)
    assert [round(x, 5) for x in got[1].embedding] == [round(x, 5) for x in want.embed(["a b"])[0]] and got[2].embedding == got[1].embedding
    assert got[3].embedding is None and not got[4].hit and cache.count() == 2
    two, later = cached.embed_cached(texts.union(spark.createDataFrame([(5, "d")], texts.schema)), cache, embed.HashingEmbedder(8), T1 + timedelta(hours=23))
    assert {r.n: r.hit for r in two.collect()} == {1: True, 2: True, 3: None, 4: True, 5: False} and later.count() == 3
    three, last = cached.embed_cached(texts, later, embed.HashingEmbedder(8), T1 + timedelta(hours=24))
    assert {r.hit for r in three.where("text IS NOT NULL").collect()} == {False} and last.count() == 3
    base = ingest.upsert_a(empty, feed_a(spark, {}, {"id": "k2", "screenshot_url": None}), T1).drop("changed").persist()
    ids = {k: r.id for k, r in rows(base).items()}
    asked = spark.createDataFrame([("k1",), ("k2",), (str(ids["k1"]),), ("k9",), ("99999999999",), (None,), ("k1",)], "key string")
    got, held = cached.media_cached(asked, base, spark.createDataFrame([], cached.MEDIA), T1)
    assert sorted(((r.key, r.media_url, r.hit) for r in got.collect()), key=str) == sorted([("k1", "m", False)] * 2 + [("k2", None, False), (str(ids["k1"]), "m", False), ("k9", None, False), ("99999999999", None, False), (None, None, None)], key=str)
    again, _ = cached.media_cached(asked, base.limit(0), held, T1 + timedelta(minutes=59))
    assert all(r.hit for r in again.where("key IS NOT NULL").collect()) and again.where("media_url = 'm'").count() == 3
    assert cached.media_cached(asked, base.limit(0), held, T1 + timedelta(hours=1))[0].where("media_url IS NOT NULL").count() == 0


def test_fetching():
    waits = []

    class Reply:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return b"[]"

    calls = []

    def flaky(url, timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise OSError("down")
        return Reply()

    assert embed.retried(lambda: flaky("u", 1).read(), sleep=waits.append) == b"[]" and waits == [2, 4]
    assert feeds.fetch("u", 120, lambda url, timeout: Reply()) == "[]"
    with pytest.raises(OSError):
        embed.retried(lambda: (_ for _ in ()).throw(OSError()), sleep=waits.append)


def test_embedding(spark, empty):
    local = embed.HashingEmbedder(8)
    assert local.embed(["a b"]) == local.embed(["A  b"]) and abs(sum(x * x for x in local.embed(["a b c"])[0]) - 1) < 1e-9

    class Remote(embed.HashingEmbedder):
        seen = 0

        def __init__(self, dimensions):
            super().__init__(dimensions)
            self.model = "remote"

        def embed(self, texts):
            self.seen += len(texts)
            return super().embed(texts)

    class Broken(Remote):
        def embed(self, texts):
            raise OSError

    assert embed.Fallback(Remote(8), local).embed_named(["x"])[0] == "remote"
    waiting, embed.retried.__defaults__ = embed.retried.__defaults__, (3, lambda s: None)
    assert embed.Fallback(Broken(8), local).embed_named(["x"])[0] == local.model
    broken = embed.EmbeddingCache(embed.Fallback(Broken(8), local), lambda: 0.0)
    assert broken.embed_named(["x", "y"]) == (local.model, local.embed(["x", "y"])) and not broken.held and broken.model == "remote"
    embed.retried.__defaults__ = waiting
    assert embed.Fallback(None, local).embed_named(["x"])[0] == local.model and embed.Fallback(None, local).embed(["x"]) == local.embed(["x"])
    with pytest.raises(ValueError):
        embed.Fallback(Remote(8), local, force_local=True)
    class Reply:
        status = 200

        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return json.dumps(self.body).encode()

    data = [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]
    assert embed.ApiEmbedder("http://x", "k", "m", 1, lambda r, timeout: Reply({"data": data})).embed(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        embed.ApiEmbedder("http://x", "k", "m", 2, lambda r, timeout: Reply({"data": data})).embed(["a", "b"])
    remote, now = Remote(8), [0.0]
    cache = embed.EmbeddingCache(remote, lambda: now[0])
    assert cache.embed(["a", "b", "a"]) == remote.embed(["a", "b", "a"]) and cache.embed(["b"]) and remote.seen == 2 + 3
    now[0] = 86_400.0
    cache.embed(["b"])
    assert remote.seen == 6
    base = ingest.upsert_a(empty, feed_a(spark, {"description": "d" * 40}, {"id": "k2", "description": "short"}), T1).drop("changed")
    none = spark.createDataFrame([], "project_id int, embedding array<float>, model string")
    made = embed.embed_pending(base, none, local, T1).collect()
    assert [(r.project_id, len(r.embedding), r.model) for r in made] == [(rows(base)["k1"].id, 8, "hashing-8")]
    fallback = embed.Fallback(None, local)
    assert [(r.project_id, r.model) for r in embed.embed_pending(base, none, fallback, T1).collect()] == [(rows(base)["k1"].id, "hashing-8")]


def test_presentation(spark):
    df = spark.createDataFrame([(1, None, 0, "a  b " * 40), (2, 2.0, 2, "x"), (3, 1.5, 2, None), (4, 3.0, None, "")], "id int, t double, h int, d string")
    got = df.select(present.hours_label(F.col("t"), F.col("h")).alias("h"), present.preview(F.col("d"), 10).alias("p"), present.approved_day(F.col("h")).alias("day")).collect()
    assert [r.h for r in got] == ["0 h", "2 h", "1.5 h (2 h claimed)", "3 h"] and [r.p for r in got] == ["a b a b a...", "x", None, ""] and got[0].day == "—"
    assert [present.page_count(n, 20) for n in (0, 20, 21)] == [1, 1, 2] and present.clamp_page(9, 21, 20) == 2
    state = {"filters": [{"field": "nope", "op": "gt", "value": 1}], "sort": [{"field": "hours"}, {"field": "ysws"}], "per_page": 900, "page": 0}
    assert present.decode_view(present.encode_view(state)) == {"filters": [{"field": "ysws", "op": "eq", "value": 1}], "sort": [{"field": "hours"}], "per_page": 100, "page": 1}


def test_embeddings_are_replaced(spark):
    schema = "project_id int, embedding array<float>, model string, created_at timestamp, updated_at timestamp"
    have = spark.createDataFrame([(1, [1.0], "a", T1, T1), (2, [2.0], "a", T1, T1)], schema)
    made = spark.createDataFrame([(2, [3.0], "b", T2, T2), (4, [4.0], "b", T2, T2)], schema)
    got = sorted(tuple(r) for r in embed.upsert_embeddings(have, made).collect())
    assert got == [(1, [1.0], "a", T1, T1), (2, [3.0], "b", T1, T2), (4, [4.0], "b", T2, T2)]


def test_lexemes_follow_changes(spark, empty):
    words = lambda r: [x.lexeme for x in r.tsv]
    base = ingest.upsert_a(empty, feed_a(spark, {"description": "running dogs"}, {"id": "k2", "description": "other cats"}), T1).drop("changed")
    got = rows(base)
    assert "run" in words(got["k1"]) and "cat" in words(got["k2"])
    # a mark in place of the lexemes: rows that do not change keep it
    mark = F.array(F.struct(F.lit("mark").alias("lexeme"), F.lit(1).alias("pos")))
    two = rows(ingest.upsert_a(base.withColumn("tsv", mark), feed_a(spark, {"description": "sleeping dogs"}, {"id": "k2", "description": "other cats"}), T2))
    assert "sleep" in words(two["k1"]) and words(two["k2"]) == ["mark"]


class Body:
    """A reply that gives a few bytes at a time."""

    status = 200

    def __init__(self, raw):
        self.raw = raw

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def read(self, size=-1):
        out, self.raw = self.raw[:7], self.raw[7:]
        return out


def test_landing(spark, empty, tmp_path):
    items = [A | {"screenshot_url": None, "description": 'é \\ " ] , \n [', "hours": 12345}, A | {"id": "k2", "screenshot_url": None}, 123456789, [], "x"]
    for text in (json.dumps(items), json.dumps(items, indent=3, ensure_ascii=False), json.dumps(items).replace("[", " [ ", 1)):
        for size in (1, 5, 10_000):
            assert list(feeds.array_items([text[i : i + size] for i in range(0, len(text), size)])) == items
    assert list(feeds.array_items(["[", "]"])) == []
    for bad in (["[1, 2"], ["{}"], [""], ["[1] 2"], ['["a']):
        with pytest.raises(ValueError):
            list(feeds.array_items(bad))
    folder = str(tmp_path / "landed")
    path = feeds.land(spark, "u", folder, 120, lambda url, timeout: Body(json.dumps(items[:2], ensure_ascii=False).encode()))
    assert path.endswith(".jsonl") and feeds.read_feed(spark, folder, whole=False).count() == 2
    store = Catalogue(spark, str(tmp_path / "projects"), 4).create(empty)
    follow(spark, folder, store, "a", str(tmp_path / "cp"), clock=lambda: T1, whole=False).awaitTermination(120)
    assert set(rows(store.read())) == {"k1", "k2"}


def test_merge_in_rounds_leaves_no_shuffles(spark, empty, tmp_path, monkeypatch):
    """Each bucket is a round here. What a round has shuffled is off the disk when the merge ends, and not some time later."""
    base = ingest.upsert_a(empty, feed_a(spark, *[{"id": f"k{i}", "hours": i} for i in range(60)]), T1).drop("changed")
    catalogue = Catalogue(spark, str(tmp_path), 4).create(base)
    feed = feed_a(spark, *[{"id": f"k{i}", "hours": i + i % 2} for i in range(5, 80)])
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(re.findall(r"shuffle_(\d+)_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
    monkeypatch.setattr("findery.sources.catalogue.ROUND_BYTES", 0, raising=False)
    before = shuffled()
    got = catalogue.merge(feed, "a", T2)
    end = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    plain = lambda df: {k: r.asDict() | {"id": 0} for k, r in rows(df).items()}
    want = ingest.apply_feed_a(base, feed, T2)
    assert plain(catalogue.read()) == plain(want.drop("changed")) and got.changed == want.where("changed").count()
    assert sorted(r.id for r in catalogue.read().collect()) == list(range(1, 81))
