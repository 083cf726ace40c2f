"""Lineage cuts that every executor can read, and schemas of what Python stages return.

Intermediate tables go to the folder the session names in ``spark.checkpoint.dir``. Each carries a
random name, so concurrent runs do not meet, and is removed when the driver process ends.
"""

from __future__ import annotations

import ctypes
import gc
import threading
import time
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NullType, ShortType, StructField, StructType

from tidemark.sources.shared import delete, fresh_folder

_path_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_scopes = threading.local()
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: rows of an Arrow batch while a table is staged; executors and workers hold a batch at each end
BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: files for each core that a table of narrow rows is written to, at most
FILES = 4


def staged(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its lineage ends there. Tables of narrow
    rows, such as pairs, are written to a few files a core, not to as many as there are partitions:
    each file costs the file system and the processes that write it."""
    spark = df.sparkSession
    df = df.coalesce(FILES * spark.sparkContext.defaultParallelism) if narrow else df
    path = fresh_folder(spark, name)
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(BATCH_ROWS, int(rows)) if int(rows) > 0 else BATCH_ROWS)
    try:
        # nobody but this call's reader looks for a marker of success
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    if path := _path_of.pop(df, None):
        delete(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged within are deleted at the end, but for those handed to the function that this
    gives. Plans that read the others must have run by then."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    tables: list[DataFrame] = []
    _scopes.open.append(tables)

    def keep(df: DataFrame) -> DataFrame:
        tables[:] = [t for t in tables if t is not df]
        if len(_scopes.open) > 1:
            _scopes.open[-2].append(df)
        return df

    try:
        yield keep
    finally:
        _scopes.open.pop()
        for t in tables:
            discard(t)


def trim() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go. They stay on the executors until the driver's JVM has
    collected their handles, which takes a collection each for the plan and for what it held. In a
    local session, where nothing has to travel, one collection will do."""
    local = spark.sparkContext.master.split("[")[0] == "local"
    for _ in range(1 if local else 3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0 if local else 0.25)
    trim()


def extend(schema: StructType, made: dict[str, str]) -> StructType:
    """A copy of ``schema`` followed by nullable columns given as name and SQL type."""
    more = [StructField(name, StructType.fromDDL(f"c {kind}")[0].dataType) for name, kind in made.items()]
    return StructType([*schema.fields, *more])


#: rows, and bytes of Arrow buffers, that a Python step takes from a batch at a time
PIECE_ROWS, PIECE_BYTES = 512, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some rows, so that what is made of them as Python values stays small. At
    the end of a task its worker, which lives on, gives back what it has freed."""
    for batch in batches:
        rows = max(1, min(PIECE_ROWS, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


#: slots of filters: so many bits are broadcast at any size
SLOTS = 1 << 25


def _bitmaps(ids: DataFrame, slot: Column) -> DataFrame:
    """At most SLOTS / 32768 rows: a bucket of slots, and the bits of those that are held."""
    rows = ids.select((slot + 1).alias("_s")).groupBy(F.expr("bitmap_bucket_number(_s)").alias("_bucket"))
    return rows.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_s))").alias("_held"))


def bits_of(rows: DataFrame, name: str) -> np.ndarray:
    """A filter of ``SLOTS`` bits that holds the low bits of all hashes in a bigint column."""
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in _bitmaps(rows, F.col(name).bitwiseAND(F.lit(SLOTS - 1))).collect():
        out[(r[0] - 1) * 4096 : r[0] * 4096] = np.frombuffer(r[1], np.uint8)
    return out


def split(rows: DataFrame, ids: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose bigint column ``name`` can be in ``ids`` by a filter of ``SLOTS`` bits, and
    those for which it surely is not; neither is shuffled. JVM-side."""
    slot = F.pmod(F.xxhash64(name), F.lit(SLOTS))
    s, bucket, held = unused(rows, "_s", "_bucket", "_held")
    bits = F.broadcast(_bitmaps(ids.select(name), slot).withColumnsRenamed({"_bucket": bucket, "_held": held}))
    marked = rows.withColumn(s, slot + 1).withColumn(bucket, F.expr(f"bitmap_bucket_number({s})")).join(bits, bucket, "left")
    byte = F.expr(f"cast(conv(hex(substring({held}, cast(bitmap_bit_position({s}) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.call_function("shiftright", byte, F.expr(f"cast(bitmap_bit_position({s}) % 8 as int)")).bitwiseAND(F.lit(1)) == 1
    hit = F.col(held).isNotNull() & hit
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)


def only(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Those of ``rows`` that ``split`` cannot rule out, for rows too wide to be shuffled for a join."""
    return split(rows, ids, name)[0]


def keyed(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """``df`` with one more column, and its name: the doc_id where it names each row, else a number
    in the same order."""
    (key,) = unused(df, "_doc")
    df = df.withColumn(key, integer(df, doc_id))
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        return df, key
    ordered = df.orderBy(F.col(key).asc_nulls_last(), text, *[c for c in df.columns if c not in (key, text)])
    return staged(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def integer(df: DataFrame, name: str) -> Column:
    """A column as bigint; TypeError if it holds no integers, rather than nulls for what it holds."""
    if not isinstance(df.schema[name].dataType, (ByteType, ShortType, IntegerType, LongType, NullType)):
        raise TypeError(f"{name} must be of an integer type")
    return F.col(name).cast("bigint")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has a column of that name."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out
