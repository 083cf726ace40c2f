"""Garbage collection of versions under a snapshot floor.

Of a key, versions above the floor stay, and of the others the newest. If tombstones may go,
one that stayed survives only while an older value of its key stayed: it still hides that value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.visibility import visible


def collect_versions(log: DataFrame, floor: int, drop_tombstones: bool) -> DataFrame:
    """What compaction keeps of a duplicate-free ``log``. Versions above the floor are not shuffled
    at all, and of the others each task sends at most one for each key. Tombstones carry no value,
    so whether they go is decided on narrow rows: a semi-join, which splits a hot key."""
    kept = log.where(F.col("seq") > F.lit(floor)).unionByName(visible(log, floor))
    if not drop_tombstones:
        return kept
    narrow = log.select("user_key", "seq", "is_tombstone")
    narrow = narrow.where(F.col("seq") > F.lit(floor)).unionByName(visible(narrow, floor))
    oldest = narrow.where(~F.col("is_tombstone")).groupBy("user_key").agg(F.min("seq").alias("_oldest"))
    hiding = kept.where("is_tombstone").join(oldest, "user_key").where(F.col("_oldest") < F.col("seq"))
    return kept.where(~F.col("is_tombstone")).unionByName(hiding.select(*log.columns))
