"""Copies of a given resemblance, for the de-duplication of operator 6.

Texts of which 80 % of the five-word shingles agree have 64-bit SimHash fingerprints up to 14 bits apart, which is
beyond what blocks of such a fingerprint can find. So this part takes blocks of another fingerprint: minima of
permuted shingle hashes, of which two texts share each with a probability that is their resemblance. Texts that
share two blocks or more are compared by their whole shingle sets.

A crowded block's pairs are not listed. Its members are cut by a second block into smaller ones, all of whose members
share two blocks, and each is compared with the smallest id of its cut: one pass links the bulk of a large group of
copies, by aggregates that no single key can overload. Every crowded block that then holds more
than one component is searched exactly: a pair of a given resemblance must share a shingle among the rarest few of both
sets, early enough that as many can follow as the pair needs (prefix and positional filter), so texts that
share a long passage and resemble no further are not paired, and all pairs that are and whose components differ are verified.
There are no rounds: candidates, one pass of crowded blocks, one search of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, releasing, small_batches, stored

SHINGLE, SIMILARITY = 5, 0.8
#: Minima in a block, blocks, and blocks that a pair must share: 99.4 % of pairs at 0.8 do, 5 % at 0.5.
ROWS, BANDS, SHARED = 6, 24, 2
#: Members up to which a block's pairs are listed.
PAIRS = 32
#: A crowded block is cut by the block so many places on.
CUTS = (1, 7)
#: Members of a part of a common shingle's list.
PART = 256
#: Ids, and bytes of them, up to which a list of documents may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
_RNG = np.random.default_rng(20)
MULTIPLY = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
ADD = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def shingles(body: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles; a shorter text is one shingle, one without words none."""
    words = (body or b"").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a:b]) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype=np.uint64))


def blocks(grams: np.ndarray) -> np.ndarray:
    """BANDS keys of ROWS minima each."""
    low = np.empty(ROWS * BANDS, dtype=np.uint64)
    for at in range(0, len(low), ROWS):
        part = slice(at, at + ROWS)
        low[part] = (grams[None, :] * MULTIPLY[part, None] + ADD[part, None]).min(axis=1)
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, keys) of rows (doc, text_hash, body); texts without words have none."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [blocks(g) if len(g := shingles(x.as_py())) else None for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.list_(pa.int64()))], names=["doc", "text_hash", "keys"])

    small_batches(rows.sparkSession)
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, text_hash long, keys array<long>").where("keys IS NOT NULL")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(doc, grams) of rows (doc, text_hash, body); grams are the 64-bit hashes of the different shingles."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(x.as_py()).view(np.int64) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "grams"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, grams array<bigint>")


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The table, to be broadcast if it has few rows and they are short: ids may be strings of any length."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns]))), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and size <= most_bytes else df


def candidate_pairs(sketched: DataFrame, keyed: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, b), a < b: pairs that share SHARED uncrowded blocks or more, and members of crowded blocks that share a
    second block with the smallest id of those that do. sketched has (doc, keys), keyed a row (doc, band, key) for each."""
    sizes = stored(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    few = stored(keyed.join(sizes.where(F.col("n") <= pairs), ["band", "key"], "left_semi"))
    left, right = (few.select("band", "key", F.col("doc").alias(x)) for x in "ab")
    listed = left.join(right, ["band", "key"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("m"))
    listed = listed.where(F.col("m") >= SHARED).select("a", "b")
    many = keyed.join(sizes.where(F.col("n") > pairs), ["band", "key"], "left_semi")
    second = [F.xxhash64("band", "key", F.lit(c), F.get("keys", F.pmod(F.col("band") + c, F.lit(BANDS)))) for c in CUTS]
    cut = stored(many.join(sketched, "doc").select("doc", F.explode(F.array(*second)).alias("cut")))
    centres = cut.groupBy("cut").agg(F.min("doc").alias("centre"), F.max("doc").alias("last")).where("centre <> last")
    starred = cut.join(centres, "cut").where("doc <> centre")
    return listed.union(starred.select(F.col("centre").alias("a"), F.col("doc").alias("b"))).distinct()


def verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have the resemblance."""
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = rows.join(small(named), rows["doc"] == F.col("id"), "left_semi")
    sets = stored(shingle_sets(texts))
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    alike = F.try_divide(shared, F.size("x") + F.size("y") - shared)
    return both.withColumn("alike", alike).where(F.col("alike") >= similarity).select("a", "b")


def unsettled(keyed: DataFrame, named: DataFrame, pairs: int) -> DataFrame:
    """(doc, component) of the members of crowded blocks that hold more than one component."""
    of = keyed.join(named.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    crowded = of.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = crowded.where((F.col("n") > pairs) & (F.col("low") != F.col("high")))
    return of.join(mixed, ["band", "key"], "left_semi").select("doc", "component").distinct()


def prefix_pairs(docs: DataFrame, rows: DataFrame, similarity: float, part: int = PART) -> DataFrame:
    """(a, b), a < b: all pairs of docs (doc, component) that can have the resemblance and are of different components.

    A pair needs t / (1 + t) of the sizes of both sets in common. In any order of the shingles, what is common stands
    at or after the first common one in both, which bounds where that one stands; the order is by rarity.
    """
    sets = stored(shingle_sets(rows.join(small(docs), "doc", "left_semi")).withColumn("row", F.monotonically_increasing_id()))
    grams = sets.select("doc", "row", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    held = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    common = grams.join(held, "gram")
    by_row, by_rarity = Window.partitionBy("row"), Window.partitionBy("row").orderBy("df", "gram")
    # shingles that no other text has come first in the order
    at = F.col("size") - F.count("*").over(by_row) + F.row_number().over(by_rarity) - 1
    placed = common.withColumn("at", at).where(F.col("size") - F.col("at") >= F.ceil(similarity * F.col("size") - 1e-6))
    prefix = stored(placed.join(small(docs), "doc").select("gram", "doc", "component", "size", "at"))
    # members of a shingle's largest component need no comparing with each other
    counted = prefix.groupBy("gram", "component").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("gram").agg(
        F.max_by("component", F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("held")
    )
    # a common shingle's list is cut into parts, and every member meets each part in a place of its own
    mixed = stored(mixed.where("parts > 1").select("gram", "top", F.ceil(F.col("held") / part).cast("int").alias("cuts")))
    lists = stored(prefix.join(mixed, "gram").withColumn("cut", F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int")))
    x = lists.where("component <> top").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).alias("x")
    y = lists.alias("y")
    needed = similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    possible = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) >= needed
    once = (F.col("y.component") == F.col("y.top")) | (F.col("x.doc") < F.col("y.doc"))
    both = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.cut") == F.col("y.cut")) & (F.col("x.component") != F.col("y.component")) & once & possible)
    return both.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def near_copies(rows: DataFrame, different: DataFrame | None = None, similarity: float = SIMILARITY, pairs: int = PAIRS) -> DataFrame:
    """(node, component): the documents that resemble another one, and the smallest id of each group.

    rows are (doc, text_hash, body) without null ids; of them those in different (doc, text_hash) take part,
    so that exact copies can be left out.
    """
    from .simhash import components

    sketched = sketches(rows)
    if different is not None:
        sketched = sketched.join(different, ["doc", "text_hash"], "left_semi")
    sketched = stored(sketched.select("doc", "keys"))
    keyed = sketched.select("doc", F.posexplode("keys").alias("band", "key"))
    links = stored(verified(stored(candidate_pairs(sketched, keyed, pairs)), rows, similarity))
    named = stored(components(links))
    open_docs = stored(unsettled(keyed, named, pairs))
    if open_docs.isEmpty():
        return named
    rest = verified(stored(prefix_pairs(open_docs, rows, similarity)), rows, similarity)
    return components(links.union(rest))
