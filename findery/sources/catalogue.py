"""The catalogue as plain Parquet in buckets of its key; a feed rewrites the buckets in which it changes something.

A bucket is a partition of the table, by a hash of the external id. To apply a feed, hashes of the compared columns are
joined by key on both sides, narrow rows that tell which buckets hold a change; only these are read whole, merged and
overwritten (Spark's dynamic partition overwrite), the others' files stay as they are. They are taken in rounds of some
buckets, or of one large one, and a round's shuffles are gone before the next begins: what a merge needs of disk, besides
the catalogue and the feed, is a round's share. How much changed is observed while the rows are written. Feeds are whole
payloads, so a run that was lost half-way is made good by the next one, and a feed applied twice rewrites nothing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest
from ..schema import PROJECTS, VERSION
from .shared import discard, shared_folder, swept

KINDS = {"a": (ingest.COLUMNS_A, ingest.apply_feed_a), "b": ([*ingest.COLUMNS_B, "media_url"], ingest.apply_feed_b)}
SHARES = 16  # of a bucket, by another hash than the bucket's
ROUND_BYTES = 64 << 20  # of files that are taken at a time, where all are not many times that
TASK_BYTES = 4 << 20  # of staged text, whose lexemes are seconds of work
SCHEMA = T.StructType([*PROJECTS.fields, T.StructField("bucket", T.IntegerType())])


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    """The file system of a path."""
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _size(spark: SparkSession, name: str) -> int:
    """Bytes below a folder, 0 if it is not there."""
    fs, path = _files(spark, name), _path(spark, name)
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


@dataclass(frozen=True)
class Merged:
    """What a feed did: rows changed of the rows written, and the buckets rewritten."""

    changed: int
    written: int
    buckets: list[int]


class Catalogue:
    """A folder of any file system that Spark reads; the schema's version is part of the path."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, f"{folder.rstrip('/')}/v{VERSION}", buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("airtable_id"), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> Catalogue:
        """The first rows; fails if there are some already. Rows that come without lexemes get them here, behind all shuffles."""
        fs, path, made = _files(self.spark, self.path), _path(self.spark, self.path), f"{self.path}.new"
        if fs.exists(path):
            raise AnalysisException(f"[PATH_ALREADY_EXISTS] {self.path}")
        folder = shared_folder(self.spark, "rows")
        with swept(self.spark, folder):
            staged = self._staged(rows, folder)
            discard(self.spark, made)  # a lost run's
            for part, size in self._rounds(list(range(self.buckets)), 4, folder):
                tasks = [size // TASK_BYTES] if size >= 2 * TASK_BYTES else []
                # look-ups by id skip files and row groups
                dealt = staged.where(F.col("bucket").isin(part)).repartitionByRange(*tasks, "bucket", "id").sortWithinPartitions("bucket", "id")
                self._write(dealt if "tsv" in dealt.columns else ingest.with_lexemes(dealt), "append", made)
                self._drop(folder, part)
            if not fs.rename(_path(self.spark, made), path):
                raise OSError(f"{made} could not become {self.path}")
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def find(self, key: str) -> DataFrame:
        """The rows of an external id: its bucket is the only partition read, and Bloom filters pass over row groups."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        bucket = F.pmod(F.xxhash64(F.lit(key)), F.lit(self.buckets)).cast("int")
        return rows.where((F.col("bucket") == bucket) & (F.col("airtable_id") == key)).drop("bucket")

    def _staged(self, rows: DataFrame, folder: str) -> DataFrame:
        """Rows made once, as files by bucket that each task writes of what it has: nothing is shuffled."""
        rows = self._bucketed(rows)
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _rounds(self, buckets: list[int], most: int, *folders: str) -> list[tuple[list[int], int]]:
        """The buckets in some `most` groups, or fewer of ROUND_BYTES, each with the bytes of its files. A large bucket is a group."""
        sizes = {b: sum(_size(self.spark, f"{folder}/bucket={b}") for folder in folders) for b in buckets}
        room, rounds = max(ROUND_BYTES, sum(sizes.values()) // most), []
        for b in buckets:
            if not rounds or rounds[-1][1] + sizes[b] > room:
                rounds.append(([], 0))
            rounds[-1] = ([*rounds[-1][0], b], rounds[-1][1] + sizes[b])
        return rounds

    def _drop(self, folder: str, buckets: list[int]) -> None:
        for b in buckets:
            discard(self.spark, f"{folder}/bucket={b}")

    def _write(self, rows: DataFrame, mode: str, path: str) -> None:
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("parquet.bloom.filter.enabled#airtable_id", "true")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as a file's keys need, not a megabyte each
        writer.partitionBy("bucket").parquet(path)

    def touched(self, feed: DataFrame, columns: list[str], scope: Column | None = None) -> list[int]:
        """The buckets in which a feed changes, adds or deletes a row."""
        # xxhash64 passes over nulls, so these are hashed as flags
        sign = F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])
        own = self.spark.read.schema(SCHEMA).parquet(self.path)
        held = own.select("airtable_id", "bucket", sign.alias("sign"), F.col("deleted_at").isNotNull().alias("dead"), (F.lit(True) if scope is None else scope).alias("scope"))
        given = self._bucketed(feed).select("airtable_id", F.col("bucket").alias("new_bucket"), sign.alias("new_sign"))
        both = held.join(given, "airtable_id", "full")
        absent = F.col("new_bucket").isNull()
        changed = F.when(absent, ~F.col("dead") & F.coalesce("scope", F.lit(False))).otherwise(F.col("bucket").isNull() | F.col("dead") | (F.col("sign") != F.col("new_sign")))
        return sorted(r[0] for r in both.where(changed).select(F.coalesce("bucket", "new_bucket")).distinct().collect())  # no more than buckets

    def merge(self, feed: DataFrame, kind: str, now, *, allow_empty: bool = False, scope: Column | None = None) -> Merged:
        """Apply a decoded feed: upsert, for kind b media too, then tombstones of the scope."""
        columns, apply = KINDS[kind]
        folder = shared_folder(self.spark, "feed")
        with swept(self.spark, folder):
            feed = self._staged(feed, folder)  # decoded once, read for its keys, its hashes and its rows
            if not allow_empty and feed.isEmpty():
                raise ValueError("an empty feed would delete every project")
            ingest.check_keys(feed)
            buckets = self.touched(feed.drop("bucket"), columns, scope)
            changed = written = 0
            for part, _ in self._rounds(buckets, 16, self.path, folder):
                given = feed.where(F.col("bucket").isin(part)).drop("bucket")
                last = self.spark.read.schema(SCHEMA).parquet(self.path).agg(F.max("id")).scalar()
                seen = Observation()
                rows = self._bucketed(apply(self.read(part), given, now, last_id=last, checked=True, allow_empty=True, scope=scope))
                if len(part) > 1:  # one bucket's rows are dealt by the joins; of several each is some tasks' work, and AQE puts small shares together
                    rows = rows.repartition("bucket", F.pmod(F.hash("airtable_id"), F.lit(SHARES)))
                rows = rows.sortWithinPartitions("bucket", "id")
                rows = rows.observe(seen, F.count("*").alias("written"), F.coalesce(F.sum(F.col("changed").cast("long")), F.lit(0)).alias("changed")).drop("changed")
                self._write(rows, "overwrite", self.path)
                changed, written = changed + seen.get["changed"], written + seen.get["written"]
                self._drop(folder, part)
            return Merged(changed, written, buckets)

    def changes(self, merged: Merged, now) -> DataFrame:
        """The rows that a merge changed, for tables that follow the catalogue."""
        return self.read(merged.buckets).where(F.col("updated_at") == F.lit(now).cast("timestamp")).withColumn("changed", F.lit(True))


@contextmanager
def exclusive(spark: SparkSession, folder: str, stale: float = 6 * 3600) -> Iterator[bool]:
    """Whether this run is the only one on a folder; another one is to do nothing. A mark older than `stale` seconds is a lost run's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_running")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale:
        fs.delete(path, False)
    mine = fs.createNewFile(path)
    try:
        yield mine
    finally:
        if mine:
            fs.delete(path, False)
