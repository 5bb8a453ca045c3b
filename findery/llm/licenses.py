"""License scans by diagonal voting (operator 10).

Every document's rolling word k-gram hashes are made in Arrow batches, unnested and joined by Spark to the
(template, position) table of the notices. Hits are grouped by document, template and diagonal (place in the
document less place in the template); neighbouring diagonals, which a few added or lost words make, merge
into one run, but not further apart than half the template, so that a short notice said twice gives two. A run that
holds enough of the template densely enough is a candidate; candidates go back to their texts, where their words are
compared with the template's, and a span is reported when enough of them stand in the same order.
The template table is a fixed list of notices (see license_texts.py: a licence whose text holds none of them gets no label
from the method), and only it is broadcast, after its size is checked.

Defined results: a null, empty or wordless text has no words, no labels and score 0; documents shorter than
a k-gram take part in the base only; rows that repeat give one result each; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, releasing, small_batches, stored, table
from .license_texts import NOTICES, PHRASES

K = 4
#: Diagonals at most so far apart belong to one span, and at most half the template's words.
DRIFT = 6
#: A span needs this share of the template's words, or this many of them, whichever is less.
MIN_SHARE, MIN_WORDS = 0.8, 40
#: Of the words between a span's ends, so many must lie in matching k-grams.
MIN_DENSITY = 0.6
#: What a document gets for a phrase of the base without a verified span.
PHRASE_SCORE = 0.5
#: Rows of the template table that may be broadcast.
BROADCAST_ROWS = 200_000
CACHE = 200_000


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(WORD_BYTES).split()


def rolling(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """One 64-bit hash for each window of k word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


class WordHashes(dict):
    """Word to 64-bit hash; the memory of it is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            out = [rolling(np.array(list(map(cache.__getitem__, words_of(b))), dtype=np.uint64)) for b in batch.column(2).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc", "text_hash", "grams"])


def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and places of the base phrases."""
    needles = [(f" {p} ".encode(), label) for p, label in PHRASES]
    for batch in batches:
        rows = []
        for body in batch.column(2):
            words = words_of(body.as_py())
            flat = b" ".join([b"", *words, b""])
            places, labels = [], set()
            for needle, label in needles:
                at = flat.find(needle)
                before, counted = 0, 0
                while at >= 0:
                    counted, before = counted + flat.count(b" ", before, at), at
                    places.append(counted)
                    labels.add(label)
                    at = flat.find(needle, at + 1)
            rows.append((len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.string()))],
            names=["doc", "text_hash", "n_words", "n_base", "first_word", "last_word", "base_labels"],
        )


def template_table(spark, notices=None) -> DataFrame:
    """(template, label, size, at, gram) for every k-gram of the notices."""
    rows = []
    cache = WordHashes()
    for i, (label, text) in enumerate(notices or NOTICES):
        words = words_of(text.encode())
        if len(words) < K:
            raise ValueError(f"a notice needs at least {K} words: {text!r}")
        hashes = rolling(np.array([cache[w] for w in words], dtype=np.uint64))
        rows += [(i, label, len(words), j, int(h)) for j, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "template int, label string, size int, at int, gram long")


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Words of a that stand in the same order in b: the longest common subsequence."""
    if a == b:
        return len(a)
    best = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, best[j] = best[j], diagonal + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def verified(candidates: DataFrame, rows: DataFrame, notices=None) -> DataFrame:
    """(doc, text_hash, spans): candidates whose words are the template's, by the same limits."""
    templates = [(label, words_of(text.encode())) for label, text in notices or NOTICES]
    kind = "array<struct<first:int,last:int,label:string,share:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, spans = words_of(body), []
                for c in found:
                    label, template = templates[c["template"]]
                    same = common_words(template, words[c["first"] : c["last"] + 1])
                    if same >= min(len(template) * MIN_SHARE, MIN_WORDS) and same >= MIN_DENSITY * (c["last"] - c["first"] + 1):
                        spans.append({"first": c["first"], "last": c["last"], "label": label, "share": same / len(template)})
                out.append(spans)
            spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, spans_type)], names=["doc", "text_hash", "spans"])

    # the candidates are stored, so their size is known to the choice of a join
    listed = candidates.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_set(F.struct("first", "last", "template"))).alias("found")
    )
    same = F.col("doc").eqNullSafe(F.col("_doc")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    texts = rows.join(stored(listed), same).select("doc", "text_hash", "body", "found")
    # the texts of equal rows are equal
    spans = texts.mapInArrow(releasing(run), T.StructType([*rows.schema.fields[:2], T.StructField("spans", T._parse_datatype_string(kind))]))
    return spans.groupBy("doc", "text_hash").agg(F.first("spans").alias("spans"))


def find_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices=None) -> DataFrame:
    """One row a document: the base's counts and labels, the verified spans, all labels and a score."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("body"))
    keys = rows.schema.fields[:2]
    templates = template_table(spark, notices)
    if templates.count() <= BROADCAST_ROWS:
        templates = F.broadcast(templates)
    hashed = rows.mapInArrow(releasing(grams), T.StructType([*keys, T.StructField("grams", T.ArrayType(T.LongType()))]))
    hits = hashed.select("doc", "text_hash", F.posexplode("grams").alias("place", "gram")).join(templates, "gram")
    diagonals = hits.groupBy("doc", "text_hash", "template", "size", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats")  # as many as the template has at most
    )
    order = Window.partitionBy("doc", "text_hash", "template").orderBy("diagonal")
    drift = F.least(F.lit(DRIFT), F.floor(F.col("size") / 2))
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int")
    runs = diagonals.withColumn("run", F.sum(F.coalesce(apart, F.lit(0))).over(order))
    covered = lambda ats: F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + K - 1))))
    spans = runs.groupBy("doc", "text_hash", "template", "size", "run").agg(
        F.min(F.col("diagonal") + F.array_min("ats")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("ats") + K - 1).alias("last"),
        F.size(covered(F.array_distinct(F.flatten(F.collect_set("ats"))))).alias("matched"),
    )
    enough = F.least(F.col("size") * MIN_SHARE, F.lit(float(MIN_WORDS)))
    spans = spans.where((F.col("matched") >= enough) & (F.col("matched") >= MIN_DENSITY * (F.col("last") - F.col("first") + 1)))
    spans = verified(spans, rows, notices)
    kinds = T._parse_datatype_string("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>")
    bases = rows.mapInArrow(releasing(base), T.StructType([*keys, *kinds.fields]))
    spans = spans.withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"})
    same = F.col("doc").eqNullSafe(F.col("_doc")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    labels = F.array_sort(F.array_union("base_labels", F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))))
    score = F.greatest(
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)),
        F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0)),
    )
    return bases.join(spans, same, "left").select(
        F.col("doc").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        labels.alias("labels"), score.alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string,share:double>>")).alias("spans"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
