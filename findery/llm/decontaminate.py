"""Benchmark decontamination (operator 1).

The benchmark's n-grams form a hash set that is broadcast while it has few enough windows and little enough text, both
measured first; document windows are hashed with numpy over whole Arrow batches, looked up, and each hit is verified
word by word. A larger benchmark is joined by window over a shuffle instead, with the same result, for scanning and for cutting;
windows that a bounded table of the benchmark's hash bits does not know take no part in the shuffle.

Defined results: a null or wordless text has no words and is never contaminated; a null or wordless item
has no windows; an item with a null id marks words and is not counted among the items; ids are compared as Spark's
strings of them; repeated rows are scored one by one; an empty table gives an empty result; other columns,
whatever their names, are ignored by the scan and kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, WORD_BYTES, among, bits_of, releasing, small_batches, stored, table, text_bytes

N = 10
#: Bytes and windows of a benchmark that may be collected and broadcast (about 60 bytes a window); beyond either, windows are joined.
BROADCAST_CHARS, BROADCAST_WINDOWS = 64_000_000, 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WindowSet:
    """All windows of the benchmark, by length: sorted hashes, the words behind them, and their items by number."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int = N) -> None:
        self.vocab: dict[bytes, int] = {}
        numbers: dict[str, int] = {}
        grams: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, body in items:
            words = (body or b"").translate(WORD_BYTES).split()
            if words:
                ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], dtype=np.int32)
                owner = -1 if item is None else numbers.setdefault(item, len(numbers))
                size = min(n, len(ids))
                grams.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), owner))
        self.names = list(numbers)
        self.tables = []
        for size, found in sorted(grams.items()):
            words = np.concatenate([w for w, _ in found])
            owner = np.repeat(np.array([o for _, o in found], dtype=np.int32), [len(w) for w, _ in found])
            hashes = self.hashed(words)
            order = np.lexsort((owner, *words.T[::-1], hashes))
            hashes, words, owner = hashes[order], words[order], owner[order]
            first = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])
            held = (owner >= 0) & (first | np.concatenate([[True], owner[1:] != owner[:-1]]))  # each item once
            ends = np.append(np.cumsum(held)[np.flatnonzero(first)] - held[first], held.sum())
            self.tables.append((size, hashes[first], words[first], owner[held], ends))

    @staticmethod
    def hashed(words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.uint64)
        for j in range(words.shape[1]):
            out = (out ^ (words[:, j].astype(np.uint64) + np.uint64(1))) * MULTIPLIER
            out ^= out >> np.uint64(29)
        return out

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable[[int], list[str]]]]:
        """(window length, places, rows of the table, the items of a row); ids are -1 outside the vocabulary."""
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for size, hashes, words, owners, ends in self.tables:
            if len(ids) < size:
                continue
            items = lambda r, owners=owners, ends=ends: [self.names[o] for o in owners[ends[r] : ends[r + 1]]]
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            seen = ids[at[:, None] + np.arange(size)]
            found = self.hashed(seen)
            row = np.searchsorted(hashes, found)
            # equal hashes of different windows are neighbours: step on while the words differ
            while len(at):
                inside = row < len(hashes)
                at, seen, found, row = at[inside], seen[inside], found[inside], row[inside]
                same = hashes[row] == found
                at, seen, found, row = at[same], seen[same], found[same], row[same]
                equal = (words[row] == seen).all(axis=1)
                if equal.any():
                    yield size, at[equal], row[equal], items
                at, seen, found, row = at[~equal], seen[~equal], found[~equal], row[~equal] + 1


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


RESULT = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<first:bigint,last:bigint>>"
)


def _scan(shared, id_field: pa.Field):
    """Arrow batches of (id, body) to one row a document; shared is a broadcast WindowSet."""
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get = index.vocab.get
        for whole in batches:
            for start in range(0, whole.num_rows, 512):  # bounds the arrays below
                batch = whole.slice(start, 512)
                lists = [(b or b"").translate(WORD_BYTES).split() for b in batch.column(1).to_pylist()]
                sizes = np.array([len(x) for x in lists], dtype=np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one gap after each document
                ids = np.full(starts[-1], -1, dtype=np.int64)
                for s, words in zip(starts, lists):
                    ids[s : s + len(words)] = list(map(get, words, repeat(-1)))
                mark = np.zeros(len(ids) + 1, dtype=np.int64)
                items: list[set[str]] = [set() for _ in lists]
                for size, at, rows, owners in index.hits(ids):
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + size, -1)
                    for d, r in set(zip((np.searchsorted(starts, at, "right") - 1).tolist(), rows.tolist())):
                        items[d].update(owners(r))
                hit = np.cumsum(mark[:-1]) > 0
                edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
                spans: list[list[dict]] = [[] for _ in lists]
                for d, a, b in zip(np.searchsorted(starts, first, "right") - 1, first, last):
                    spans[d].append({"first": int(a - starts[d]), "last": int(b - starts[d])})
                n_hit = [sum(s["last"] - s["first"] + 1 for s in x) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in items], pa.int64()),
                        pa.array([_digest(x) for x in items], pa.string()),
                        pa.array([x > 0 for x in n_hit], pa.bool_()),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array(spans, spans_type),
                    ],
                    names=[id_field.name, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
                )

    return run


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _shared_set(items: DataFrame, n: int, most_chars: int, most_windows: int):
    """The broadcast WindowSet of (item, text) rows; None if it is beyond a bound."""
    n_words = F.size(_words(F.col("text")))
    windows = F.when(n_words > 0, F.greatest(n_words - n + 1, F.lit(1))).otherwise(0)
    chars, count = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(windows), F.lit(0))).first()
    if chars > most_chars or count > most_windows:
        return None
    rows = items.select("item", F.col("text").cast("binary")).collect()
    return items.sparkSession.sparkContext.broadcast(WindowSet([(r[0], None if r[1] is None else bytes(r[1])) for r in rows], n))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = N,
    broadcast_chars: int = BROADCAST_CHARS,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row a document: counts, the items it leaks (as strings) and the hit word spans."""
    items = _items(benchmark, item_col, item_text_col)
    shared = _shared_set(items, n, broadcast_chars, broadcast_windows)
    if shared is None:
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
        rows = stored(rows)  # read more than once, with the same numbers
        found = _hits(rows, _owned(items, n))
        none, empty = F.array().cast("array<string>"), F.array().cast("array<struct<first:bigint,last:bigint>>")
        base = rows.select("_row", F.col("_id").alias(id_col), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
        items_found = F.coalesce("items", none)
        return base.join(found, "_row", "left").select(
            id_col, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"),
            items_found.alias("items"), F.coalesce("spans", empty).alias("spans"),
        )
    rows = text_bytes(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), *T._parse_datatype_string(RESULT).fields])
    return rows.mapInArrow(releasing(_scan(shared, pa.field(id_col, pa.int64()))), schema)


def _grams(words: Column, size: Column) -> Column:
    return F.transform(
        F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((i - 1).cast("long").alias("at"), F.array_join(F.slice(words, i, size), " ").alias("gram")),
    )


def _owned(items: DataFrame, n: int) -> DataFrame:
    """(gram, size, owners): the windows of (item, text) rows, stored."""
    worded = items.select("item", _words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(n)))
    windows = worded.select("item", "size", F.explode(_grams(F.col("w"), F.col("size"))).alias("g"))
    return stored(windows.groupBy(F.col("g.gram").alias("gram"), "size").agg(F.collect_set("item").alias("owners")))


def _hits(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """(_row, items, spans, n_hit) of the rows (_row, text) that hold a window, by a shuffle join."""
    sizes = [r[0] for r in owned.select("size").distinct().collect()]  # at most n values
    worded = rows.select("_row", _words(F.col("text")).alias("w"))
    placed = [worded.select("_row", F.lit(k).alias("size"), F.inline(_grams(F.col("w"), F.lit(k)))) for k in sizes]
    if not placed:
        return rows.sparkSession.createDataFrame([], "_row long, items array<string>, spans array<struct<first:bigint,last:bigint>>, n_hit long")
    # most windows are none of the benchmark's: they end at a table of bits of bounded size, and only the others are shuffled
    bits = bits_of(owned.select(F.xxhash64("gram").alias("h")))
    seen = among(reduce(DataFrame.union, placed).withColumn("h", F.xxhash64("gram")), bits).drop("h")
    hits = seen.join(owned, ["gram", "size"]).groupBy("_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"),
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("size") - 1).alias("last")))).alias("runs"),
    )
    merged = F.aggregate(
        "runs",
        F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"] - 1),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return hits.select("_row", "items", merged.alias("spans")).withColumn("n_hit", n_hit)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = N,
    max_hit_share: float = 0.5,
    broadcast_chars: int = BROADCAST_CHARS,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The documents without benchmark text: hit spans are cut out; a document with more than
    max_hit_share of its words hit, or with all of them, is removed.

    All columns stay. A cut takes the text from the first to the last hit word of a span; what a cut brings together
    may be a window again and is cut as well.
    """
    items = _items(benchmark, "item_id", "text")
    shared = _shared_set(items, n, broadcast_chars, broadcast_windows)
    if shared is None:
        return _cut_joined(docs, _owned(items, n), text_col, max_hit_share)
    small_batches(docs.sparkSession)
    cols = docs.columns
    place = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared, pa.field("row", pa.int64()))
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            raw = [None if x is None else x.encode() for x in batch.column(place).to_pylist()]
            rows = pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int64()), pa.array(raw, pa.binary())], names=["row", "body"])
            keep, texts = [], []
            for out in scan([rows]):
                for i, words, hit, spans in zip(*(out.column(k).to_pylist() for k in (0, 1, 2, 7))):
                    body = raw[i]
                    if not hit:
                        keep.append(True)
                        texts.append(None if body is None else body.decode())
                        continue
                    keep.append(hit <= max_hit_share * words and hit < words)
                    while spans:
                        body = _cut(body, [(s["first"], s["last"]) for s in spans])
                        again = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([body], pa.binary())], names=["row", "body"])
                        spans = next(scan([again])).column(7).to_pylist()[0]
                    texts.append(body.decode())
            cols_now = list(batch.columns)
            cols_now[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(cols_now, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)


def _cut_joined(docs: DataFrame, owned: DataFrame, text_col: str, max_hit_share: float) -> DataFrame:
    """The same by joins: what was cut is searched again until nothing is found; each round has the cut documents only."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        return pd.Series([_cut(t.encode(), list(zip(a, b))).decode() for t, a, b in zip(texts, firsts, lasts)], index=texts.index)

    todo = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text")))
    done, share = [], max_hit_share
    while True:
        found = stored(_hits(todo, owned).select("_row", "spans", "n_hit"))
        done.append(todo.join(found, "_row", "left_anti"))
        if found.isEmpty():
            break
        hit = todo.join(found, "_row")
        if len(done) == 1:  # a document is judged by its whole text
            words = F.size(_words(F.col("text")))
            hit = hit.where((F.col("n_hit") <= share * words) & (F.col("n_hit") < words))
        todo = stored(hit.select("_row", "row", cut("text", "spans.first", "spans.last").alias("text")))
    new = F.col("row").withField(text_col, F.col("text").cast(docs.schema[text_col].dataType))
    return reduce(DataFrame.union, done).select(new.alias("row")).select("row.*")


def _cut(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    flat = body.translate(WORD_BYTES)
    at, places = 0, []
    for word in flat.split():
        at = flat.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for first, last in spans:
        out.append(body[done : places[first][0]])
        done = places[last][1]
    out.append(body[done:])
    return b"".join(out)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
    SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS s FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
