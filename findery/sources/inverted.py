"""Inverted tables beside the catalogue: lexemes with places, and trigrams, each by its term.

A table is Parquet, partitioned by a check sum of the term and sorted by term and project within files, so that a search
reads the partitions of its own terms alone, and of them the row groups that can hold these. A row carries the
`updated_at` of the project that it was made of. When projects change, rows of the changed ones are appended and nothing
is rewritten: a search joins what it finds to the live projects by id and `updated_at`, which leaves out rows of former
states and of deleted projects. `build` into a new folder is the way to get rid of them.

A partition is dealt among SHARES files by a hash of the project, so busy terms are split too.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext
from ..functions.text import trigram_set, trigrams
from ..operators.scoring import TRIGRAM_COLUMNS
from ..schema import TRIGRAM_THRESHOLD

BUCKETS = 64
SHARES = 8


@dataclass(frozen=True)
class Inverted:
    """Rows (term, id, version, ...) in a folder."""

    folder: str
    buckets: int = BUCKETS

    def append(self, entries: DataFrame) -> None:
        bucket = (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int")
        # by hashes: cutting by ranges would make all entries once more, to sample them
        dealt = entries.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SHARES)))
        dealt.sortWithinPartitions("bucket", "term", "id").write.mode("append").partitionBy("bucket").parquet(self.folder)

    def of(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """The rows of some terms; the filter on bucket chooses the partitions that are read."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        rows = spark.read.parquet(self.folder)
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms)))).drop("bucket")


@dataclass(frozen=True)
class SearchIndex:
    """Lexemes and trigrams of a catalogue; projects need their lexemes in tsv."""

    folder: str
    buckets: int = BUCKETS

    @property
    def lexemes(self) -> Inverted:
        return Inverted(f"{self.folder}/lexemes", self.buckets)

    @property
    def grams(self) -> Inverted:
        return Inverted(f"{self.folder}/grams", self.buckets)

    def build(self, projects: DataFrame) -> SearchIndex:
        """All projects that are not deleted."""
        return self.add(projects.where("deleted_at IS NULL"))

    def refresh(self, snapshot: DataFrame) -> SearchIndex:
        """Only the rows that a feed has changed (see ingest): a new state of a project has a new updated_at."""
        return self.add(snapshot.where("changed AND deleted_at IS NULL"))

    def add(self, projects: DataFrame) -> SearchIndex:
        key = ["id", F.col("updated_at").alias("version")]
        placed = projects.select(*key, F.inline("tsv").alias("term", "pos"))
        self.lexemes.append(placed.select("term", "id", "version", "pos"))
        fields = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("field"), trigram_set(F.col(c)).alias("grams")) for i, c in enumerate(TRIGRAM_COLUMNS)])
        sets = projects.select(*key, F.inline(fields)).where(F.size("grams") > 0)
        self.grams.append(sets.select(F.explode("grams").alias("term"), "id", "version", "field", F.size("grams").alias("size")))
        return self

    def matches(self, spark: SparkSession, node: fulltext.Node) -> DataFrame:
        """(id, version, tsv) of what matches a query, tsv with the query's words alone. The query must ask for a word."""
        if fulltext.matches_nothing(node):
            raise ValueError("a query that texts without any of its words match has no use for an index")
        rows = self.lexemes.of(spark, sorted(fulltext.all_words(node)))
        found = rows.groupBy("id", "version").agg(F.collect_set(F.struct(F.col("term").alias("lexeme"), "pos")).alias("tsv"))
        return found.where(fulltext.matches(F.col("tsv"), node))

    def similar(self, spark: SparkSession, query: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
        """(id, version, score) of what resembles a query by a threshold in some column: exact, from counts alone.

        With m grams in the query, a value of n grams reaches similarity t only if t m <= n <= m / t, and then only
        if t (n + m) / (1 + t) grams are shared. A query without grams resembles nothing.
        """
        wanted = trigrams(query)
        m, slack = len(wanted), 1e-9
        rows = self.grams.of(spark, wanted).where(F.col("size").between(math.ceil(threshold * m - slack), math.floor(m / threshold + slack)))
        shared = rows.groupBy("id", "version", "field", "size").agg(F.size(F.collect_set("term")).alias("shared"))  # m at most
        score = F.col("shared") / (F.col("size") + m - F.col("shared"))
        near = shared.where(F.col("shared") >= threshold * (F.col("size") + m) / (1 + threshold) - slack).withColumn("score", score)
        return near.where(F.col("score") >= threshold).groupBy("id", "version").agg(F.max("score").alias("score"))
