"""A JSON feed behind a URL as a data source of Spark, for batches and streams.

    spark.dataSource.register(FeedSource)
    spark.read.format("json_feed").option("url", ...).load()         # (value): the items of the array, one a row
    spark.readStream.format("json_feed").option("url", ...).load()   # a batch whenever the feed is another one

The feed is fetched by a task and read item by item; neither the driver nor a task holds it whole. A fetch that breaks off
fails its task, which Spark runs again. A stream's offset is what the server says of the feed's state (its ETag or
time of change, else the time of asking), so that a restarted stream passes over a payload it has applied.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.embed import retried
from .feeds import TIMEOUTS, array_items, pieces


def _opened(url: str, timeout: int, method: str = "GET"):
    reply = urllib.request.urlopen(urllib.request.Request(url, method=method), timeout=timeout)
    if not 200 <= reply.status < 300:
        raise OSError(f"status {reply.status}")
    return reply


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.timeout = options["url"], int(options.get("timeout", max(TIMEOUTS.values())))

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        with retried(lambda: _opened(self.url, self.timeout)) as reply:
            for item in array_items(pieces(reply)):
                yield (json.dumps(item, ensure_ascii=False),)


class FeedStreamReader(FeedReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"state": ""}

    def latestOffset(self) -> dict:
        with retried(lambda: _opened(self.url, self.timeout, "HEAD")) as reply:
            return {"state": reply.headers.get("ETag") or reply.headers.get("Last-Modified") or str(time.time_ns())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(end["state"])]

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Options: url, timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "json_feed"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)
