"""Feeds as a stream of landed files or of fetches: each batch is a whole payload, merged into the catalogue."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalogue import Catalogue, exclusive
from ..sources.feed_source import FeedSource
from ..sources.feeds import TIMEOUTS, decode_feed_a, decode_feed_b, records
from ..sources.inverted import SearchIndex

DECODERS = {"a": decode_feed_a, "b": decode_feed_b}


def follow(
    spark: SparkSession, landing: str, catalogue: Catalogue, kind: str, checkpoint: str, *, trigger: dict | None = None, clock=None, whole: bool = True,
    index: SearchIndex | None = None,
) -> StreamingQuery:
    """Apply every file that lands, one a batch and in order; a batch that is replayed changes nothing.

    A file is one JSON array, which one task reads, or with whole=False JSON lines as feeds.land makes them. While
    another run is at work on the catalogue a batch is passed over: the next one is a whole payload too. An index
    gets the rows that a batch changes.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(landing, wholetext=whole)
    return applied(lines, catalogue, kind, checkpoint, trigger, clock, index)


def follow_url(
    spark: SparkSession, url: str, catalogue: Catalogue, kind: str, checkpoint: str, *, trigger: dict | None = None, clock=None, index: SearchIndex | None = None
) -> StreamingQuery:
    """Apply a feed whenever the server says that it is another one; tasks fetch it, nothing lands."""
    spark.dataSource.register(FeedSource)
    lines = spark.readStream.format("json_feed").option("url", url).option("timeout", TIMEOUTS[kind]).load()
    return applied(lines, catalogue, kind, checkpoint, trigger, clock, index)


def applied(lines: DataFrame, catalogue: Catalogue, kind: str, checkpoint: str, trigger: dict | None, clock, index: SearchIndex | None) -> StreamingQuery:
    """A stream of payloads (value), each batch merged into the catalogue."""
    spark, now = lines.sparkSession, clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def batch(files, number: int) -> None:
        with exclusive(spark, catalogue.path) as mine:
            if mine:
                at = now()
                merged = catalogue.merge(DECODERS[kind](records(files)), kind, at)
                if index is not None and merged.changed:
                    index.refresh(catalogue.changes(merged, at))

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
