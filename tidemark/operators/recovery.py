"""Recovery of a framed log: the longest prefix of intact frames, each whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intact_prefix(records: DataFrame, frame: str = "frame_no", bad: str = "is_bad") -> DataFrame:
    """Rows of the frames before the first that has a bad row. What follows a bad frame goes even
    if it is intact. The first bad frame is one number, found by an aggregate - no global sort."""
    first = records.where(F.col(bad)).agg(F.min(frame).alias("_first"))
    return records.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(frame) < F.col("_first"))).drop("_first")


def frame_states(records: DataFrame, frame: str = "frame_no", bad: str = "is_bad") -> DataFrame:
    """One row per frame: records, greatest seq, whether it is recovered."""
    frames = records.groupBy(frame).agg(F.count(F.lit(1)).alias("n_records"), F.max("seq").alias("max_seq"), F.max(F.col(bad).cast("int")).alias("_bad"))
    first = records.where(F.col(bad)).agg(F.min(frame).alias("_first"))
    return frames.crossJoin(F.broadcast(first)).select(frame, "n_records", "max_seq", (F.col("_first").isNull() | (F.col(frame) < F.col("_first"))).alias("recovered"))
