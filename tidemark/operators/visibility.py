"""Reads of a mutation log as of a sequence number.

One rule holds throughout: a key shows the version with the greatest sequence number not above
the snapshot; a tombstone shows nothing. ``snapshot=None`` means the latest. Filters are on plain
columns, so they reach the Parquet scan, and the top-1 is pruned before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import COLUMNS, by_key, version_order


def until(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= F.lit(snapshot))


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The visible version of each key, tombstones included."""
    newest = F.row_number().over(by_key().orderBy(F.desc("seq")))
    return until(log, snapshot).withColumn("_rn", newest).where("_rn = 1").drop("_rn")


def scan(log: DataFrame, snapshot: int | None = None, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """The live view, optionally of a half-open key range. Order is for the caller to ask for."""
    return visible(key_range(log, start, end), snapshot).where(~F.col("is_tombstone")).select("user_key", "seq", "value")


def key_range(log: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """All versions and tombstones with ``start <= key < end``; None leaves a side open."""
    if start is not None:
        log = log.where(F.col("user_key") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("user_key") < F.lit(end))
    return log


def get(log: DataFrame, key: bytes, snapshot: int | None = None) -> DataFrame:
    """No row or one with the value of ``key``. A limit over a descending sort, not a window: one
    key's versions would all meet in one task."""
    newest = until(log, snapshot).where(F.col("user_key") == F.lit(key)).orderBy(F.desc("seq")).limit(1)
    return newest.where(~F.col("is_tombstone")).select("user_key", "seq", "value")


#: ranges of time that a key's versions are dealt to in an as-of join
SEQ_RANGES = 16


def asof(log: DataFrame, probes: DataFrame, seq_ranges: int = SEQ_RANGES) -> DataFrame:
    """``probe_id, user_key, snapshot`` with ``seq`` and ``is_tombstone`` of the last version not
    after the snapshot (nulls where there is none). No product of versions and probes: both are put
    in one sequence by key and time, and the last version before a probe is carried to it. Values
    are not read. A key's versions are dealt to ranges of time, cut at quantiles of all versions'
    numbers, so a hot key is several tasks; a probe whose range has nothing before it takes the last
    version of an earlier range."""
    kind = "struct<seq:bigint,is_tombstone:boolean>"
    versions = log.select("user_key", F.col("seq").alias("at"), F.lit(0).alias("is_probe"), F.lit(None).cast("bigint").alias("probe_id"), F.struct("seq", "is_tombstone").cast(kind).alias("version"))
    asks = probes.select("user_key", F.col("snapshot").alias("at"), F.lit(1).alias("is_probe"), "probe_id", F.lit(None).cast(kind).alias("version"))
    share = [i / seq_ranges for i in range(1, seq_ranges)]
    cuts = (log.agg(F.percentile_approx("seq", share, 1000)).first()[0] or []) if share else []
    span = sum(((F.col("at") > F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    line = versions.unionByName(asks).withColumn("range", span)
    before = Window.partitionBy("user_key", "range").orderBy("at", "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("seen", F.last("version", ignorenulls=True).over(before)).where("is_probe = 1")
    # of each key as many rows as ranges at most: the last version of any earlier range
    version = F.col("is_probe") == 0
    last = line.groupBy("user_key", "range").agg(F.max_by(F.when(version, F.col("version")), F.when(version, F.col("at"))).alias("last"))
    carried = Window.partitionBy("user_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("user_key", "range", F.last("last", ignorenulls=True).over(carried).alias("earlier")).where("earlier is not null")
    seen = seen.join(last, ["user_key", "range"], "left").withColumn("seen", F.coalesce("seen", "earlier"))
    return seen.select("probe_id", "user_key", F.col("at").alias("snapshot"), "seen.seq", "seen.is_tombstone")


def multi_get(log: DataFrame, probes: DataFrame, seq_ranges: int = SEQ_RANGES) -> DataFrame:
    """``probe_id, user_key, snapshot`` with ``seq, value`` of what each probe sees (nulls where
    it sees nothing): an as-of join on keys and numbers alone, then the winners' values."""
    seen = asof(log, probes, seq_ranges)
    seen = seen.select("probe_id", "user_key", "snapshot", F.when(~F.col("is_tombstone"), F.col("seq")).alias("seq"))
    return seen.join(log.select("user_key", "seq", "value"), ["user_key", "seq"], "left").select("probe_id", "user_key", "snapshot", "seq", "value")


def contains(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Those of ``keys`` (column ``user_key``) that are live. Values are not read."""
    live = visible(log.select("user_key", "seq", "is_tombstone"), snapshot).where(~F.col("is_tombstone"))
    return keys.join(live, "user_key", "left_semi")


def count_live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``n_live``. Only key, seq and flag are read, and the winner is a plain hash aggregate."""
    dead = until(log, snapshot).groupBy("user_key").agg(F.max_by("is_tombstone", "seq").alias("dead"))
    return dead.agg(F.count_if(~F.col("dead")).alias("n_live"))


def is_empty(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Whether no key is live; one live key is enough to answer."""
    dead = until(log, snapshot).groupBy("user_key").agg(F.max_by("is_tombstone", "seq").alias("dead"))
    return dead.where(~F.col("dead")).limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def deletes(log: DataFrame, seq_ranges: int = SEQ_RANGES) -> DataFrame:
    """Each delete with whether a live value was visible just before it: a read as of then."""
    probes = log.where("is_tombstone").select("user_key", F.col("seq").alias("probe_id"), (F.col("seq") - 1).alias("snapshot"))
    seen = asof(log, probes, seq_ranges)
    return seen.select("user_key", F.col("probe_id").alias("seq"), F.coalesce(~F.col("is_tombstone"), F.lit(False)).alias("existed"))


def ordered(log: DataFrame) -> DataFrame:
    """All versions in the internal order: a range-partitioned sort."""
    return log.orderBy(*version_order())


def changes_between(log: DataFrame, after: int, upto: int) -> DataFrame:
    """Mutations with ``after < seq <= upto``."""
    return log.where((F.col("seq") > F.lit(after)) & (F.col("seq") <= F.lit(upto)))


def level_first(segments: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The live view found level by level: of the levels (columns ``table_seq, generation``) that
    hold a visible version of a key the newest one answers. Equal to ``scan`` for levels in order
    of recency; this checks that they are."""
    slot = F.struct("table_seq", "generation")
    pick = F.row_number().over(by_key().orderBy(slot.desc(), F.desc("seq")))
    return until(segments, snapshot).withColumn("_rn", pick).where("_rn = 1").where(~F.col("is_tombstone")).select("user_key", "seq", "value")


def merge(segments: DataFrame) -> DataFrame:
    """Overlapping segments as one run: of equal (key, seq) the newest segment's copy stays."""
    pick = F.row_number().over(Window.partitionBy("user_key", "seq").orderBy(F.desc("table_seq"), F.desc("generation")))
    return segments.withColumn("_rn", pick).where("_rn = 1").select(*COLUMNS)
