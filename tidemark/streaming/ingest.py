"""Streams of mutations: exactly-once ingest into a store, and the latest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Each micro-batch of ``stream`` (user_key, is_tombstone, value, position) is one commit,
    named by the stream and the batch's number: a batch that is replayed changes nothing. The store
    keeps the last number of each stream only."""

    def commit(batch: DataFrame, number: int) -> None:
        store.write_batch(batch, (name, number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stream: DataFrame) -> DataFrame:
    """The newest version of each key of a stream of log rows, as it changes: a streaming aggregate
    whose state per key is one version. Order of arrival does not matter, as the greatest sequence
    number wins; rows that come late are older versions, so no watermark is needed."""
    newest = F.max_by(F.struct("seq", "is_tombstone", "value"), "seq")
    return stream.groupBy("user_key").agg(newest.alias("v")).select("user_key", "v.*")
