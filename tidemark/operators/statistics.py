"""Counts and extrema of logs and segments. None of them reads values unless their size is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.numbering import before_part, dealt
from tidemark.schema import entry_bytes, version_order

SLOT = ("table_seq", "generation")


def segment_meta(segments: DataFrame) -> DataFrame:
    """One row per segment: entries, tombstones, values, key range, greatest seq, bytes."""
    return segments.groupBy(*SLOT).agg(
        F.count(F.lit(1)).alias("num_entries"),
        F.count_if("is_tombstone").alias("num_tombstones"),
        F.count_if(~F.col("is_tombstone")).alias("num_values"),
        F.min("user_key").alias("min_key"),
        F.max("user_key").alias("max_key"),
        F.max("seq").alias("max_seq"),
        F.sum(entry_bytes()).alias("size_bytes"),
    )


def buffer_bytes(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("size_bytes"))


def max_seq(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))


def zone_prune(meta: DataFrame, key: bytes) -> DataFrame:
    """Segments whose closed key range holds ``key``; an empty segment holds nothing."""
    return meta.where((F.col("num_entries") > 0) & (F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def version_histogram(log: DataFrame) -> DataFrame:
    """How many keys have how many versions."""
    return log.groupBy("user_key").agg(F.count(F.lit(1)).alias("n_versions")).groupBy("n_versions").agg(F.count(F.lit(1)).alias("n_keys"))


def blocks(run: DataFrame, block_bytes: int = 4096, header: int = 17) -> DataFrame:
    """Blocks of each segment in the internal order, about ``block_bytes`` each by running size:
    first key and seq, offset and length. Offsets follow whole entries. Sizes are summed within
    ranges of the order and the sums of earlier ranges added, so no task sees a whole segment."""
    size = F.lit(header) + F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = dealt(run.select(*SLOT, "user_key", "seq", size.cast("bigint").alias("size")), [F.col("table_seq"), F.col("generation"), *version_order()])
    parts = before_part(rows.groupBy(*SLOT, "_part").agg(F.sum("size").alias("n")), "n", list(SLOT)).drop("n")
    here = Window.partitionBy(*SLOT, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    # as many rows as ranges, and one more for each segment
    placed = rows.withColumn("end", F.sum("size").over(here)).join(F.broadcast(parts), [*SLOT, "_part"])
    placed = placed.withColumn("offset", F.col("before") + F.col("end") - F.col("size"))
    placed = placed.withColumn("block", F.floor(F.col("offset") / F.lit(block_bytes)))
    first = F.min(F.struct("offset", "user_key", "seq")).alias("f")
    return placed.groupBy(*SLOT, "block").agg(first, F.sum("size").alias("len")).select(*SLOT, "block", F.col("f.user_key").alias("first_key"), F.col("f.seq").alias("first_seq"), F.col("f.offset").alias("offset"), "len")


def write_amplification(written: DataFrame, logical_bytes: DataFrame) -> DataFrame:
    """Bytes written by all generations of segments over bytes that the log holds."""
    physical = written.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("written_bytes"))
    return physical.crossJoin(logical_bytes.select(F.col("size_bytes").alias("logical_bytes"))).withColumn("amplification", F.col("written_bytes") / F.col("logical_bytes"))
