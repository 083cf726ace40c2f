"""Registered queries over the supplied tables, each with its SQL where SQL can say it.

Two mutation logs are derived from the tables: E from ``events`` (key user_id, an error event is
a delete) and O from ``orders`` (key o_custkey, a low-priority order is a delete). Sequence
numbers are the tables' unique ids plus one. Snapshots are fractions of the greatest one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.bloom import FNV_BASES, FNV_PRIME, MIX, segment_blooms
from tidemark.operators import numbering, recovery, retention, statistics, visibility
from tidemark.plans.compaction import plan
from tidemark.schema import mutation_log
from tidemark.sources.shared import fresh_folder
from tidemark.store import Store, StoreOptions
from tidemark.streaming.ingest import ingest

KEY = 11
LOW, HIGH = "10", "20"
AT, FLOOR, LATER = 0.7, 0.5, 0.8
SEGMENTS = 10
FRAME = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events")
    return mutation_log(t, F.col("user_id"), F.col("event_id") + 1, F.col("event_type") == "error", F.col("props"))


def log_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "orders")
    return mutation_log(t, F.col("o_custkey"), F.col("o_orderkey") + 1, F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus"))


def _seq(log: DataFrame, part: float) -> Column:
    """A snapshot: one number from one narrow column, asked for by the query itself."""
    return F.floor(log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).scalar() * F.lit(part)).cast("bigint")


def _seq_now(log: DataFrame, part: float) -> int:
    """The same for what a store has to know before it starts."""
    return math.floor((log.agg(F.max("seq")).first()[0] or 0) * part)


def _kv(df: DataFrame) -> DataFrame:
    """Binary columns as text, under short names."""
    names = {"user_key": "k", "value": "v"}
    return df.select([F.col(c).cast("string").alias(names[c]) if c in names else F.col(c) for c in df.columns])


def _segments(log: DataFrame) -> DataFrame:
    """E cut into segments of equal ranges of seq."""
    width = -(-_seq_now(log, 1) // SEGMENTS) or 1
    return log.withColumns({"table_seq": F.floor((F.col("seq") - 1) / F.lit(width)).cast("bigint"), "generation": F.lit(0)})


def _key_segments(log: DataFrame) -> DataFrame:
    """E cut into segments by the first byte of the key."""
    return log.withColumns({"table_seq": F.ascii(F.col("user_key").cast("string")).cast("bigint"), "generation": F.lit(0)})


def _bytes(text) -> bytes:
    return str(text).encode()


def q01_get_latest(spark, d):
    return _kv(visibility.get(log_e(spark, d), _bytes(KEY)))


def q02_get_at(spark, d):
    log = log_e(spark, d)
    return _kv(visibility.get(log, _bytes(KEY), _seq(log, AT)))


def q03_multi_get_asof(spark, d):
    # all orders ask for a user of the events as of their own number; some users are absent
    probes = _table(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), (F.col("o_custkey") % 200).cast("string").cast("binary").alias("user_key"), F.col("o_orderkey").alias("snapshot"))
    return _kv(visibility.multi_get(log_e(spark, d), probes))


def q04_contains(spark, d):
    keys = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").cast("binary").alias("user_key"))
    return _kv(visibility.contains(log_o(spark, d), keys))


def q05_scan_latest(spark, d):
    return _kv(visibility.scan(log_e(spark, d)))


def q05b_scan_latest_orders(spark, d):
    return _kv(visibility.scan(log_o(spark, d)))


def q06_scan_at(spark, d):
    log = log_e(spark, d)
    return _kv(visibility.scan(log, _seq(log, AT)))


def q07_len_live(spark, d):
    return visibility.count_live(log_o(spark, d))


def q08_is_empty(spark, d):
    return visibility.is_empty(log_e(spark, d))


def q09_delete_existed(spark, d):
    return _kv(visibility.deletes(log_e(spark, d)))


def q10_internal_order(spark, d):
    return _kv(numbering.numbered(log_e(spark, d)).select("position", "user_key", "seq", "is_tombstone"))


def q11_range_versions(spark, d):
    return _kv(visibility.key_range(log_e(spark, d), _bytes(LOW), _bytes(HIGH)))


def q12_range_live_at(spark, d):
    log = log_o(spark, d)
    return _kv(visibility.scan(log, _seq(log, AT), _bytes(LOW), _bytes(HIGH)))


def q13_merge_dedupe(spark, d):
    log = log_e(spark, d)
    mark = lambda s: F.when(~F.col("is_tombstone"), F.concat(F.col("value"), F.lit(s).cast("binary"))).alias("value")
    cut, again = _seq(log, AT), _seq(log, FLOOR)
    old = log.where(F.col("seq") <= cut).select("user_key", "seq", "is_tombstone", mark("#old"), F.lit(0).alias("table_seq"), F.lit(3).alias("generation"))
    new = log.where(F.col("seq") > again).select("user_key", "seq", "is_tombstone", mark("#new"), F.lit(1).alias("table_seq"), F.lit(0).alias("generation"))
    return _kv(visibility.merge(old.unionByName(new)))


def q14_gc_keep_tombs(spark, d):
    log = log_e(spark, d)
    return _kv(retention.collect_versions(log, _seq(log, FLOOR), False))


def q15_gc_drop_tombs(spark, d):
    log = log_e(spark, d)
    return _kv(retention.collect_versions(log, _seq(log, FLOOR), True))


def q16_gc_then_scan(spark, d):
    log = log_o(spark, d)
    return _kv(visibility.scan(retention.collect_versions(log, _seq(log, FLOOR), True), _seq(log, LATER)))


def q17_level_first_get(spark, d):
    log = log_e(spark, d)
    return _kv(visibility.level_first(_segments(log), _seq(log, AT)))


def q18_table_meta(spark, d):
    meta = statistics.segment_meta(_segments(log_e(spark, d)))
    return meta.select("table_seq", "num_entries", "num_tombstones", "num_values", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"), "max_seq", "size_bytes")


def q19_buffer_bytes(spark, d):
    return statistics.buffer_bytes(log_e(spark, d))


def q20_max_seq(spark, d):
    return statistics.max_seq(log_o(spark, d))


def q21_zone_prune(spark, d):
    return statistics.zone_prune(statistics.segment_meta(_key_segments(log_e(spark, d))), _bytes(KEY)).select("table_seq")


def _framed(spark, d):
    log = log_e(spark, d)
    bad = F.floor((F.col("seq") - 1) / FRAME) == F.floor(_seq(log, LATER) / FRAME)
    return log.withColumns({"frame_no": F.floor((F.col("seq") - 1) / FRAME).cast("bigint"), "is_bad": bad})


def q22_recover_prefix(spark, d):
    return _kv(recovery.intact_prefix(_framed(spark, d)).select("user_key", "seq", "is_tombstone"))


def q23_frame_atomicity(spark, d):
    return recovery.frame_states(_framed(spark, d))


def q24_changes_between(spark, d):
    log = log_e(spark, d)
    return _kv(visibility.changes_between(log, _seq(log, FLOOR), _seq(log, AT)))


def q25_write_amp(spark, d):
    """Every version written to its segment, and once more by a merge of all."""
    log = log_e(spark, d)
    first = statistics.segment_meta(_segments(log)).select("size_bytes")
    merged = statistics.buffer_bytes(retention.collect_versions(log, _seq(log, FLOOR), False))
    return statistics.write_amplification(first.unionAll(merged), statistics.buffer_bytes(log)).select("written_bytes", "logical_bytes")


def q26_version_histogram(spark, d):
    return statistics.version_histogram(log_o(spark, d))


def q27_compaction_plan(spark, d):
    meta = statistics.segment_meta(_segments(log_e(spark, d))).orderBy("table_seq", "generation").collect()
    task = plan([r.asDict() for r in meta])
    rows = [(task.start, task.width, task.drop_tombstones, task.table_seq, task.generation, task.input_bytes)] if task else []
    return spark.createDataFrame(rows, "start bigint, width bigint, drop_tombstones boolean, table_seq bigint, generation bigint, input_bytes bigint")


def q28_bloom_stats(spark, d):
    return segment_blooms(_segments(log_o(spark, d))).withColumn("fp_rate", F.round("fp_rate", 9))


def q29_stream_latest(spark, d):
    """Events as a stream into a store, one commit per micro-batch; then its live view. The path
    is a pattern, as a stream's plain path would have to be a folder."""
    source = spark.readStream.schema(_table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    log = mutation_log(source, F.col("user_id"), F.col("event_id") + 1, F.col("event_type") == "error", F.col("props"))
    store = Store(spark, fresh_folder(spark, "store"), StoreOptions(auto_compact=False, flush_bytes=1 << 40))
    ingest(log.withColumnRenamed("seq", "position"), store, fresh_folder(spark, "offsets")).awaitTermination()
    return _kv(store.scan())


def q30_store_scan(spark, d):
    """Orders written to a store in batches, flushed, compacted, and read at a snapshot that was
    taken before the last batch."""
    log = log_o(spark, d)
    store = Store(spark, fresh_folder(spark, "store"), StoreOptions(auto_compact=False, flush_bytes=1 << 40))
    edges = [0, _seq_now(log, 0.25), _seq_now(log, FLOOR), _seq_now(log, AT), _seq_now(log, LATER), _seq_now(log, 1)]
    snapshot = None
    for low, high in zip(edges[:-1], edges[1:]):
        if high == edges[-1]:
            snapshot = store.snapshot()
        store.write_batch(visibility.changes_between(log, low, high).withColumnRenamed("seq", "position"))
        store.flush()
    store.compact_all()
    # the view of the manifest after compaction at the pinned number: collection kept it whole
    return _kv(visibility.scan(store.log(), snapshot.seq))


def q31_block_index(spark, d):
    blocks = statistics.blocks(_segments(log_e(spark, d)))
    return blocks.select("table_seq", "block", F.col("first_key").cast("string").alias("first_key"), "first_seq", "offset", "len")


def q32_entry_projection(spark, d):
    log = log_e(spark, d)
    return log.select("seq", F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint").alias("n_bytes"), (F.coalesce(F.octet_length("value"), F.lit(0)) == 0).alias("is_empty"), "is_tombstone")


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}

_E = "SELECT CAST(user_id AS VARCHAR) AS k, event_id + 1 AS seq, coalesce(event_type = 'error', false) AS is_tombstone, CASE WHEN coalesce(event_type = 'error', false) THEN NULL ELSE coalesce(props, '') END AS v FROM events"
_O = "SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderkey + 1 AS seq, coalesce(o_orderpriority = '5-LOW', false) AS is_tombstone, CASE WHEN coalesce(o_orderpriority = '5-LOW', false) THEN NULL ELSE coalesce(o_orderstatus, '') END AS v FROM orders"


def _at(part: float) -> str:
    return f"(SELECT CAST(floor(max(seq) * {part}) AS BIGINT) FROM log)"


def _with(log: str, more: str = "") -> str:
    return f"WITH log AS ({log}){more} "


def _live(where: str = "true") -> str:
    return f"SELECT k, seq, v FROM (SELECT * FROM log WHERE {where} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE NOT is_tombstone"


def _kept(drop: bool) -> str:
    """Collection as windows over a key's versions, from the newest to the oldest."""
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY k, seq <= {_at(FLOOR)} ORDER BY seq DESC) AS rn FROM log),
kept AS (SELECT k, seq, is_tombstone, v, max(CASE WHEN is_tombstone THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY seq DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below
  FROM ranked WHERE seq > {_at(FLOOR)} OR rn = 1),
gc AS (SELECT k, seq, is_tombstone, v FROM kept WHERE {"NOT is_tombstone OR coalesce(below, 0) = 1" if drop else "true"})"""


_SEGMENTS = f", segs AS (SELECT *, CAST(floor((seq - 1) / CAST(ceil((SELECT max(seq) FROM log) / {SEGMENTS}.0) AS BIGINT)) AS BIGINT) AS table_seq FROM log)"
_SIZE = "strlen(k) + 8 + coalesce(strlen(v), 0)"
_FRAMES = f", framed AS (SELECT *, CAST(floor((seq - 1) / {FRAME}) AS BIGINT) AS frame_no FROM log), states AS (SELECT frame_no, count(*) AS n_records, max(seq) AS max_seq, frame_no = {_at(LATER)} // {FRAME} AS bad FROM framed GROUP BY frame_no), prefix AS (SELECT frame_no, n_records, max_seq, NOT bool_or(bad) OVER (ORDER BY frame_no) AS recovered FROM states)"



def _bloom_hash(basis: int) -> str:
    """FNV-1a of the key's characters with murmur3's finaliser, in 128-bit arithmetic."""
    wrap = "% 18446744073709551616::UHUGEINT"
    z = f"list_reduce(list_prepend({basis}::UHUGEINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UHUGEINT)), lambda h, x: (xor(h, x) * {FNV_PRIME}::UHUGEINT) {wrap})"
    for m in MIX:
        z = f"(SELECT (xor(z, z >> 33) * {m}::UHUGEINT) {wrap} FROM (SELECT {z} AS z))"
    return f"(SELECT xor(z, z >> 33) FROM (SELECT {z} AS z))"


_PLAN = f""", segs2 AS (SELECT table_seq, CAST(sum({_SIZE}) AS BIGINT) AS size, row_number() OVER (ORDER BY table_seq) - 1 AS i FROM segs GROUP BY table_seq),
reach(start, width, total) AS (
  SELECT i, 1, greatest(size, 1)::DOUBLE FROM segs2
  UNION ALL SELECT r.start, r.width + 1, r.total + greatest(s.size, 1) FROM reach r JOIN segs2 s ON s.i = r.start + r.width
  WHERE r.width < 10 AND greatest(greatest(s.size, 1), r.total / r.width) / least(greatest(s.size, 1), r.total / r.width) <= 1.5),
best AS (SELECT start, max(width) AS width FROM reach GROUP BY start HAVING max(width) >= 4 ORDER BY width DESC, start LIMIT 1)"""
_BLOOM = f""", keys AS (SELECT DISTINCT table_seq, k FROM segs),
hashed AS (SELECT table_seq, {_bloom_hash(FNV_BASES[0])} AS a, {_bloom_hash(FNV_BASES[1])} AS b FROM keys),
sized AS (SELECT table_seq, count(*) AS num_keys, greatest(64, CAST(ceil(count(*) * (-ln(0.01) / (ln(2) * ln(2)))) AS BIGINT)) AS num_bits FROM keys GROUP BY table_seq),
shaped AS (SELECT *, CAST(least(30, greatest(1, floor(num_bits / num_keys * ln(2) + 0.5))) AS INTEGER) AS num_hashes FROM sized),
probes AS (SELECT table_seq, a, b, num_bits, unnest(range(num_hashes)) AS i FROM hashed JOIN shaped USING (table_seq)),
bits AS (SELECT table_seq, count(DISTINCT ((a + i::UHUGEINT * (b | 1::UHUGEINT)) % 18446744073709551616::UHUGEINT) % num_bits::UHUGEINT) AS bits_set FROM probes GROUP BY table_seq)"""

ORACLE_SQL = {
    "q01_get_latest": _with(_E) + f"SELECT * FROM ({_live()}) WHERE k = '{KEY}'",
    "q02_get_at": _with(_E) + f"SELECT * FROM ({_live(f'seq <= {_at(AT)}')}) WHERE k = '{KEY}'",
    "q03_multi_get_asof": _with(_E, ", probes AS (SELECT o_orderkey AS probe_id, CAST(o_custkey % 200 AS VARCHAR) AS k, o_orderkey AS snapshot FROM orders)")
    + "SELECT p.probe_id, p.k, p.snapshot, CASE WHEN NOT l.is_tombstone THEN l.seq END AS seq, CASE WHEN NOT l.is_tombstone THEN l.v END AS v FROM probes p ASOF LEFT JOIN log l ON p.k = l.k AND p.snapshot >= l.seq",
    "q04_contains": _with(_O) + f"SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE EXISTS (SELECT 1 FROM ({_live()}) l WHERE l.k = CAST(c_custkey AS VARCHAR))",
    "q05_scan_latest": _with(_E) + _live(),
    "q05b_scan_latest_orders": _with(_O) + "SELECT k, max(seq) AS seq, arg_max(coalesce(v, ''), seq) AS v FROM log GROUP BY k HAVING NOT arg_max(is_tombstone, seq)",
    "q06_scan_at": _with(_E) + _live(f"seq <= {_at(AT)}"),
    "q07_len_live": _with(_O) + f"SELECT count(*) AS n_live FROM ({_live()})",
    "q08_is_empty": _with(_E) + f"SELECT count(*) = 0 AS is_empty FROM ({_live()})",
    "q09_delete_existed": _with(_E) + "SELECT k, seq, existed FROM (SELECT *, coalesce(NOT lag(is_tombstone) OVER (PARTITION BY k ORDER BY seq), false) AS existed FROM log) WHERE is_tombstone",
    "q10_internal_order": _with(_E) + "SELECT row_number() OVER (ORDER BY k, seq DESC) AS position, k, seq, is_tombstone FROM log",
    "q11_range_versions": _with(_E) + f"SELECT k, seq, is_tombstone, v FROM log WHERE k >= '{LOW}' AND k < '{HIGH}'",
    "q12_range_live_at": _with(_O) + f"SELECT * FROM ({_live(f'seq <= {_at(AT)}')}) WHERE k >= '{LOW}' AND k < '{HIGH}'",
    "q13_merge_dedupe": _with(_E) + f"SELECT k, seq, is_tombstone, v || CASE WHEN seq > {_at(FLOOR)} THEN '#new' ELSE '#old' END AS v FROM log",
    "q14_gc_keep_tombs": _with(_E, _kept(False)) + "SELECT * FROM gc",
    "q15_gc_drop_tombs": _with(_E, _kept(True)) + "SELECT * FROM gc",
    "q16_gc_then_scan": _with(_O) + _live(f"seq <= {_at(LATER)}"),
    "q17_level_first_get": _with(_E) + _live(f"seq <= {_at(AT)}"),
    "q18_table_meta": _with(_E, _SEGMENTS) + f"SELECT table_seq, count(*) AS num_entries, CAST(count_if(is_tombstone) AS BIGINT) AS num_tombstones, CAST(count_if(NOT is_tombstone) AS BIGINT) AS num_values, min(k) AS min_key, max(k) AS max_key, max(seq) AS max_seq, CAST(sum({_SIZE}) AS BIGINT) AS size_bytes FROM segs GROUP BY table_seq",
    "q19_buffer_bytes": _with(_E) + f"SELECT CAST(sum({_SIZE}) AS BIGINT) AS size_bytes FROM log",
    "q20_max_seq": _with(_O) + "SELECT coalesce(max(seq), 0) AS max_seq FROM log",
    "q21_zone_prune": _with(_E) + f"SELECT CAST(ascii(k) AS BIGINT) AS table_seq FROM log GROUP BY ascii(k) HAVING min(k) <= '{KEY}' AND max(k) >= '{KEY}'",
    "q22_recover_prefix": _with(_E, _FRAMES) + "SELECT k, seq, is_tombstone FROM framed JOIN prefix USING (frame_no) WHERE recovered",
    "q23_frame_atomicity": _with(_E, _FRAMES) + "SELECT * FROM prefix",
    "q24_changes_between": _with(_E) + f"SELECT k, seq, is_tombstone, v FROM log WHERE seq > {_at(FLOOR)} AND seq <= {_at(AT)}",
    "q25_write_amp": _with(_E, _kept(False)) + f"SELECT CAST((SELECT sum({_SIZE}) FROM log) + (SELECT sum({_SIZE}) FROM gc) AS BIGINT) AS written_bytes, CAST((SELECT sum({_SIZE}) FROM log) AS BIGINT) AS logical_bytes",
    "q26_version_histogram": _with(_O) + "SELECT n_versions, count(*) AS n_keys FROM (SELECT count(*) AS n_versions FROM log GROUP BY k) GROUP BY n_versions",
    "q27_compaction_plan": _with(_E, _SEGMENTS + _PLAN).replace("WITH log", "WITH RECURSIVE log", 1)
    + "SELECT start, CAST(width AS BIGINT) AS width, start = 0 AS drop_tombstones, (SELECT table_seq FROM segs2 WHERE i = start + width - 1) AS table_seq, CAST(1 AS BIGINT) AS generation, CAST((SELECT sum(size) FROM segs2 WHERE i BETWEEN start AND start + width - 1) AS BIGINT) AS input_bytes FROM best",
    "q28_bloom_stats": _with(_O, _SEGMENTS + _BLOOM) + "SELECT table_seq, 0 AS generation, num_keys, bits_set, num_bits, num_hashes, round(pow(bits_set / num_bits, num_hashes), 9) AS fp_rate FROM shaped JOIN bits USING (table_seq)",
    "q29_stream_latest": _with(_E) + _live(),
    "q30_store_scan": _with(_O) + _live(f"seq <= {_at(LATER)}"),
    "q31_block_index": _with(_E, _SEGMENTS + f", sized AS (SELECT *, 9 + {_SIZE} AS sz FROM segs), placed AS (SELECT *, sum(sz) OVER (PARTITION BY table_seq ORDER BY k, seq DESC ROWS UNBOUNDED PRECEDING) - sz AS off FROM sized)")
    + "SELECT table_seq, CAST(floor(off / 4096) AS BIGINT) AS block, arg_min(k, off) AS first_key, arg_min(seq, off) AS first_seq, CAST(min(off) AS BIGINT) AS offset, CAST(sum(sz) AS BIGINT) AS len FROM placed GROUP BY 1, 2",
    "q32_entry_projection": _with(_E) + "SELECT seq, CAST(coalesce(strlen(v), 0) AS BIGINT) AS n_bytes, coalesce(strlen(v), 0) = 0 AS is_empty, is_tombstone FROM log",
}
