"""SimHash near-duplicate detection (operator 6).

Fingerprints are made in Arrow batches. Distinct fingerprints are cut into six blocks; a pair within two
bits agrees on at least four of them, so each choice of four blocks gives a join key (pigeonhole), and the
Hamming distance of every candidate is verified. A block bucket with many fingerprints is not paired: each
member is keyed by the fingerprint with every choice of two of the remaining bits blanked, and all that
share such a key are within two bits of each other, so linking each to the smallest loses nothing and the
work stays linear. Components are found with alternating large-star and small-star steps.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; repeated rows
(and rows sharing an id) each keep their row, an id that occurs with several texts belongs to the
component of each of its fingerprints; an empty table gives an empty result; rows with null ids keep their
fingerprint and name no component: theirs is null unless a row with an id has or is linked to their fingerprint;
other columns, whatever their names, are ignored by the search and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, releasing, small_batches, stored, table, wrapped
from .near_copies import near_copies, small

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fixed by the pigeonhole argument: DISTANCE + 4 blocks, of which 4 agree.
BLOCKS, AGREE = 6, 4
#: Fingerprints in a bucket up to which pairs are cheaper than blanked keys (231 a fingerprint).
PAIR_LIMIT = 64


def fingerprint(body: bytes | None, size: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = (body or b"").translate(LOWER_BYTES).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = [digest(flat[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        # bits of eight hash bytes, summed down the column
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc, text_hash and fp, a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], names=["doc", "text_hash", "fp"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("body"))
    return rows.mapInArrow(releasing(run), T.StructType([*rows.schema.fields[:2], T.StructField("fp", T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_masks() -> list[int]:
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [sum(1 << b for b in range(a, e)) for a, e in zip(edges, edges[1:])]


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b), a < b, between nodes of (node, fp) that connect everything within DISTANCE bits.

    fps has one row a distinct fingerprint. Every edge is a true link; links implied by others may be left out.
    """
    spark = fps.sparkSession
    masks = _block_masks()
    tables = []
    for chosen in combinations(range(BLOCKS), AGREE):
        mask = sum(masks[i] for i in chosen)
        tables.append((_signed(mask), [b for b in range(64) if not mask >> b & 1]))
    keyed = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, (m, _) in enumerate(tables)])
    rows = fps.select("node", "fp", F.inline(keyed)).select("node", "fp", "t", "key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes)
    near = rows.join(sizes.where(F.col("n") <= pair_limit).select("t", "key"), ["t", "key"], "left_semi")
    left = near.select("t", "key", F.col("node").alias("a"), F.col("fp").alias("fa"))
    right = near.select("t", "key", F.col("node").alias("b"), F.col("fp").alias("fb"))
    close = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= DISTANCE
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    hot = sizes.where(F.col("n") > pair_limit)
    if hot.isEmpty():
        return pairs
    crowd = rows.join(hot.select("t", "key"), ["t", "key"], "left_semi")
    # the bits left free by each table, two of them blanked at a time
    blanks = spark.createDataFrame(
        [(i, [_signed(~(1 << x | 1 << y) & (1 << 64) - 1) for x, y in combinations(free, DISTANCE)]) for i, (_, free) in enumerate(tables)],
        "t int, masks array<long>",
    )  # BLOCKS choose AGREE rows
    starred = crowd.join(F.broadcast(blanks), "t").select("node", "fp", F.explode("masks").alias("m"))
    starred = starred.select("node", "m", F.col("fp").bitwiseAND(F.col("m")).alias("star"))
    centre = starred.groupBy("m", "star").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    stars = starred.join(centre, ["m", "star"]).where(F.col("a") < F.col("node")).select("a", F.col("node").alias("b")).distinct()
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Steps go on until nothing moves; each shortens the longest path to the smallest node, so they end.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest neighbour
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        # small star: smaller neighbours and the node itself move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(out.select(F.col("component").alias("node"), "component")).distinct()


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One row a document: doc, text_hash, fp and component, the smallest id linked to it (null if none has an id)."""
    fps = stored(fingerprints(docs, id_col=id_col, text_col=text_col))
    ids = stored(fps.groupBy("fp").agg(F.min("doc").alias("node")))
    by_fp = components(links(ids.where("node IS NOT NULL"), pair_limit))
    # rows that share an id tie their fingerprints together
    shared = fps.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    if not shared.isEmpty():
        tied = fps.join(shared.select("doc"), "doc").select("doc", "fp").distinct().join(ids, "fp")
        tied = tied.select(F.col("doc").alias("a"), F.col("node").alias("b"))
        named = by_fp.select(F.col("component").alias("a"), F.col("node").alias("b"))
        by_fp = components(named.union(tied))
    of_fp = ids.join(by_fp, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(of_fp, "fp").select("doc", "text_hash", "fp", "component")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One row a document: id, fp and component_id."""
    found = grouped(docs, id_col=id_col, text_col=text_col, pair_limit=pair_limit)
    return found.select(F.col("doc").alias(id_col), "fp", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One document of each component: the one with the smallest id; all columns stay.

    Where that id has several texts one of them stays, and of rows that repeat it the one with the
    smallest hash of its columns. Rows with null ids stay
    only where no row with an id is in their component, one for each fingerprint. With a similarity, different
    texts are also compared by five-word shingles (see near_copies), and what has it is linked as well.
    """
    found = stored(grouped(docs, id_col=id_col, text_col=text_col))
    rows = wrapped(docs, id_col, text_col)
    if similarity is not None:
        body = F.col("row")[text_col].cast("string").cast("binary").alias("body")
        named = found.where(F.col("doc").isNotNull())
        different = named.groupBy("text_hash").agg(F.min("doc").alias("doc"))
        near = near_copies(rows.where(F.col("doc").isNotNull()).select("doc", "text_hash", body), different, similarity)
        edges = near.select(F.col("node").alias("a"), F.col("component").alias("b"))
        both = components(edges.union(named.select(F.col("doc").alias("a"), F.col("component").alias("b"))))
        moved = both.select(F.col("node").alias("component"), F.col("component").alias("joined"))
        found = stored(found.join(moved, "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined"))
    first = found.where(F.col("doc").eqNullSafe(F.col("component")))
    alone = F.when(F.col("doc").isNull(), F.col("fp"))
    heads = first.groupBy("doc", alone.alias("lone")).agg(F.min("text_hash").alias("text_hash")).select("doc", "text_hash").distinct()
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    key = [F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")]
    gone = stored(found.select("doc", "text_hash").distinct().join(heads.select(*key), same, "left_anti").select(*key))
    kept = rows.join(small(gone), same, "left_anti")
    if kept.groupBy("doc", "text_hash").count().where("count > 1").isEmpty():
        return kept.select("row.*")
    # chosen by its values, so that a task that runs again keeps the same one
    return kept.groupBy("doc", "text_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
