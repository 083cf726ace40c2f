"""Positions in the internal order, without one task that numbers everything or a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import version_order
from tidemark.sources.shared import fresh_folder


def dealt(df: DataFrame, order: list[Column], files: int | None = None) -> DataFrame:
    """A written copy of ``df`` in ranges of an order, with ``_part``, the range, and ``_place``
    within it. Ranges come from a sample of the whole order, so rows of one key can be in several.
    The copy fixes both numbers, whatever is planned or run again later."""
    spark = df.sparkSession
    rows = df.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    path = fresh_folder(spark, "ranges")
    made = rows.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def before_part(parts: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``parts`` has one row for each range (of each ``by``); with ``before``, the sum of ``value``
    over earlier ranges. As many rows as ranges, so one task a group can add them."""
    line = Window.partitionBy(*(by or [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum(value).over(line), F.lit(0)))


def numbered(log: DataFrame) -> DataFrame:
    """``log`` with ``position`` from 1 in the order of key, then seq descending."""
    rows = dealt(log, version_order())
    parts = before_part(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "n")
    out = rows.join(F.broadcast(parts), "_part")
    return out.select(*log.columns, (F.col("before") + F.col("_place") + 1).alias("position"))
