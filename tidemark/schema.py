"""The one schema of a mutation log, and small expressions over its entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: order of versions: user_key as unsigned bytes ascending, then seq descending
LOG = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("is_tombstone", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
COLUMNS = LOG.names
#: bytes that an entry takes besides its key and value in a write buffer
SEQ_BYTES = 8


def mutation_log(df: DataFrame, key: Column, seq: Column, tombstone: Column, value: Column) -> DataFrame:
    """Any table as a log. Keys and values that are not binary are cast; a tombstone has no value."""
    dead = F.coalesce(tombstone, F.lit(False))
    return df.select(
        key.cast("string").cast("binary").alias("user_key"),
        seq.cast("bigint").alias("seq"),
        dead.alias("is_tombstone"),
        F.when(~dead, F.coalesce(value.cast("string"), F.lit("")).cast("binary")).alias("value"),
    )


def entry_bytes() -> Column:
    """What a version adds to a write buffer: key, sequence number and value."""
    return F.octet_length("user_key") + F.lit(SEQ_BYTES) + F.coalesce(F.octet_length("value"), F.lit(0))


def version_order() -> list[Column]:
    return [F.col("user_key").asc(), F.col("seq").desc()]


def by_key() -> Window:
    return Window.partitionBy("user_key")
