"""Look-aside caches as tables: vectors of texts for a day, media urls for an hour.

A cache is rows of a key with an expiry. Asking joins what is wanted to the rows that have not expired, makes the
misses alone, once each, and gives the answers with the next cache: what has expired goes, what was made comes. The made
rows are written to the shared folder, since answers and cache both read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EMBED_BATCH, EMBED_TTL, MEDIA_TTL
from ..sources.shared import shared_folder, small_batches
from .embed import Embedder

VECTORS = "key string, embedding array<float>, model string, expires_at timestamp"
MEDIA = "key string, media_url string, expires_at timestamp"


def text_key(model: str, text):
    """The key of a text's vector; vectors of several models do not mix."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text), 256)


def _written(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession, "cache")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _alive(cache: DataFrame, now: datetime) -> DataFrame:
    return cache.where(F.col("expires_at") > F.lit(now).cast("timestamp"))


def embed_cached(texts: DataFrame, cache: DataFrame, embedder: Embedder, now: datetime, ttl: int = EMBED_TTL) -> tuple[DataFrame, DataFrame]:
    """The rows of texts (a column text) with embedding, model and hit, and the next cache (VECTORS).

    A null text has no vector. What a fallback makes by another model answers, but is not held.
    """
    small_batches(texts.sparkSession)
    held = _alive(cache, now)
    wanted = texts.withColumn("_key", text_key(embedder.model, F.col("text")))
    missing = wanted.where("_key IS NOT NULL").join(held.select(F.col("key").alias("_key")), "_key", "left_anti").groupBy("_key").agg(F.first("text").alias("text"))

    @F.pandas_udf("model string, embedding array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = []
            for i in range(0, len(some), EMBED_BATCH):
                model, found = embedder.embed_named(some.iloc[i : i + EMBED_BATCH].tolist())
                rows += [(model, v) for v in found]
            yield pd.DataFrame(rows, columns=["model", "embedding"], index=some.index)

    expires = F.lit(now + timedelta(seconds=ttl)).cast("timestamp")
    made = _written(missing.select(F.col("_key").alias("key"), vectors("text").alias("made")).select("key", "made.embedding", "made.model", expires.alias("expires_at")))
    known = held.withColumn("hit", F.lit(True)).union(made.withColumn("hit", F.lit(False)))
    answers = wanted.join(known.select(F.col("key").alias("_key"), "embedding", "model", "hit"), "_key", "left").drop("_key")
    return answers, held.union(made.where(F.col("model") == embedder.model))


def media_cached(asked: DataFrame, projects: DataFrame, cache: DataFrame, now: datetime, ttl: int = MEDIA_TTL) -> tuple[DataFrame, DataFrame]:
    """The rows of asked (a column key) with media_url and hit, and the next cache (MEDIA).

    A key that is an integer of 32 bits is an id, any other an external id. That a project has no url or does not exist is
    held too, as a null. Deleted projects answer.
    """
    held = _alive(cache, now)
    missing = asked.select("key").where("key IS NOT NULL").distinct().join(held.select("key"), "key", "left_anti")
    number = F.when(F.col("key").rlike("^[+-]?[0-9]{1,10}$"), F.expr("try_cast(key AS INT)"))
    by_id = missing.withColumn("id", number).where("id IS NOT NULL").join(projects.select("id", "media_url"), "id", "left").select("key", "media_url")
    by_key = missing.where(number.isNull()).join(projects.select(F.col("airtable_id").alias("key"), "media_url"), "key", "left")
    expires = F.lit(now + timedelta(seconds=ttl)).cast("timestamp")
    made = _written(by_id.union(by_key).withColumn("expires_at", expires))
    known = held.withColumn("hit", F.lit(True)).union(made.withColumn("hit", F.lit(False)))
    return asked.join(known.drop("expires_at"), "key", "left"), held.union(made)
