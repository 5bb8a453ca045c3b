"""Vectors in cells around centroids, of which a search reads the nearest.

Centroids come from k-means on a sample of bounded size, by cosine; every vector is then stored in the cell of its
nearest centroid, and the table is partitioned by cell. Each cell also tells its radius, the greatest angle between its
centroid and a vector of it.

A search for a share of the neighbours is approximate: it reads the cells whose centroids are nearest, as many as had
that share of the neighbours of other vectors when the table was built, and ranks their vectors exactly. How many that is
depends on the vectors: few if they lie in groups, most if they are spread evenly. Without a share it is exact: angles obey the triangle inequality, so once the k-th neighbour of the nearest cells is
known, any cell whose centroid is further away than that neighbour and the cell's radius together holds none.
Vectors of zeros or of another dimension have no cell; no search finds them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import cosine_distance

#: Vectors that centroids are fitted on at most, cells, and rounds of fitting.
SAMPLE, CELLS, ROUNDS = 50_000, 64, 10
#: Cells that an exact search reads first.
FIRST = 4
#: Of the sample, vectors among which neighbours are looked for to tell shares, vectors whose neighbours are, and neighbours of each.
MEASURED, ASKED, NEIGHBOURS = 5_000, 100, 10


def _usable(embeddings: DataFrame, size: int) -> DataFrame:
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return embeddings.where((F.size("embedding") == size) & F.coalesce(length > 0, F.lit(False)))


def _shares(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The mean share of a vector's nearest neighbours in the 1, 2, ... cells nearest to it."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    vectors, centers = unit(vectors), unit(centers)
    asked = vectors[:: max(1, len(vectors) // ASKED)]
    close = np.argsort(-(asked @ vectors.T), axis=1)[:, : NEIGHBOURS + 1]
    cell = np.argmax(vectors @ centers.T, axis=1)
    order = np.argsort(-(asked @ centers.T), axis=1)
    rank = np.argsort(order, axis=1)  # of each cell for each vector that asks
    needed = np.take_along_axis(rank, cell[close], axis=1)
    return np.array([(needed <= p).mean() for p in range(len(centers))])


@dataclass(frozen=True)
class VectorCells:
    """Cells in a folder: data (project_id, embedding, cell), cells (cell, centroid, radius, vectors) and shares (probes, share)."""

    folder: str

    def build(self, embeddings: DataFrame, cells: int = CELLS, sample: int = SAMPLE, seed: int = 1) -> VectorCells:
        first = embeddings.where(F.size("embedding") > 0).select(F.size("embedding")).first()
        if first is None:
            raise ValueError("there are no vectors")
        rows = _usable(embeddings.select("project_id", "embedding"), first[0])
        # the sample: the smallest hashes of ids, so that a second build takes the same
        chosen = rows.orderBy(F.xxhash64("project_id"), "project_id").limit(sample)
        vectors = array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")
        means = KMeans(k=cells, maxIter=ROUNDS, seed=seed, distanceMeasure="cosine", predictionCol="cell").fit(chosen.select(vectors))
        placed = means.transform(rows.select("project_id", "embedding", vectors)).drop("features")
        placed.repartition("cell").sortWithinPartitions("cell", "project_id").write.partitionBy("cell").parquet(f"{self.folder}/data")
        spark = embeddings.sparkSession
        centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(means.clusterCenters())], "cell int, centroid array<double>")
        stored = spark.read.parquet(f"{self.folder}/data").join(F.broadcast(centers), "cell")  # as many centroids as cells
        dot = F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm("embedding") * norm("centroid"))))
        told = stored.groupBy("cell").agg(F.first("centroid").alias("centroid"), F.max(F.acos(cosine)).alias("radius"), F.count("*").alias("vectors"))
        told.coalesce(1).write.parquet(f"{self.folder}/cells")
        measured = np.array([r[0] for r in chosen.limit(MEASURED).select("embedding").collect()], dtype=float)
        found = _shares(measured, np.array(means.clusterCenters()))
        spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(found)], "probes int, share double").coalesce(1).write.parquet(f"{self.folder}/shares")
        return self

    @cached_property
    def _shares(self) -> list[float]:
        return [r["share"] for r in SparkSession.active().read.parquet(f"{self.folder}/shares").orderBy("probes").collect()]

    def probes(self, share: float) -> int:
        """Cells to read for a share of the neighbours."""
        return next((i for i, x in enumerate(self._shares, 1) if x >= share), len(self._shares))

    @cached_property
    def _cells(self) -> list:
        return SparkSession.active().read.parquet(f"{self.folder}/cells").orderBy("cell").collect()

    def angles(self, vector: list[float]) -> list[tuple[float, float, int]]:
        """(angle to the centroid, radius, cell), nearest first."""
        q = np.asarray(vector, dtype=float)
        if not np.linalg.norm(q):
            return []
        centers = np.array([r["centroid"] for r in self._cells])
        if centers.shape[1] != len(q):
            return []
        cosines = np.clip(centers @ q / (np.linalg.norm(centers, axis=1) * np.linalg.norm(q)), -1, 1)
        return sorted((float(a), r["radius"], r["cell"]) for a, r in zip(np.arccos(cosines), self._cells))

    def _of(self, spark: SparkSession, cells: list[int], vector: list[float]) -> DataFrame:
        rows = spark.read.parquet(f"{self.folder}/data").where(F.col("cell").isin(cells))
        return rows.select(F.col("project_id").alias("id"), cosine_distance(F.col("embedding"), vector).alias("distance"))

    def reachable(self, spark: SparkSession, vector: list[float], k: int) -> list[int]:
        """The cells that can hold one of the k nearest vectors."""
        near = self.angles(vector)
        first = [c for _, _, c in near[:FIRST]]
        known = self._of(spark, first, vector).orderBy("distance", "id").limit(k).agg(F.count("*"), F.max("distance")).first()
        if known[0] < k:
            return [c for _, _, c in near]
        reach = math.acos(max(-1.0, min(1.0, 1 - known[1]))) + 1e-7  # what rounding may hide
        return sorted({*first, *(c for angle, radius, c in near if angle - radius <= reach)})

    def nearest(self, spark: SparkSession, vector: list[float], k: int, share: float | None = None) -> DataFrame:
        """(id, distance) of the k nearest: exactly, or a share of them on the average."""
        near = self.angles(vector)
        cells = self.reachable(spark, vector, k) if near and share is None else [c for _, _, c in near[: self.probes(share or 1)]]
        return self._of(spark, cells, vector).orderBy("distance", "id").limit(k)
