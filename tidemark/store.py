"""A multi-version key/value store: immutable Parquet segments under atomically committed manifests.

Writes are batches. A batch is evaluated once, becomes a logged segment with consecutive sequence
numbers and is visible from one manifest commit on, whole or not at all. ``flush`` merges logged
segments into a table sorted by key, ``compact`` merges neighbouring tables and drops versions that
no snapshot can reach, ``vacuum`` deletes folders that no live or pinned manifest names. Readers
pin a manifest and a sequence number together, so nothing that they can see goes away under them:
handles of one process share a registry of snapshots, and other processes see leases, small files
beside the manifests.

Durability is that of the file system against crashes of processes. ``sync`` forces what the latest
manifest names to a local disk, and so does every commit with the option ``sync="always"``; on other
file systems a closed file is as durable as that system makes it.
"""

from __future__ import annotations

import os
import threading
import uuid
import weakref
from collections import Counter
from collections.abc import Iterable
from concurrent.futures import Future
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import retention, visibility
from tidemark.operators.numbering import before_part
from tidemark.plans.compaction import CompactionConfig, plan
from tidemark.schema import LOG, entry_bytes
from tidemark.sources.manifest import CommitConflict, Manifest, ManifestLog, Segment, sync_folder
from tidemark.sources.shared import fresh_folder


@dataclass(frozen=True)
class StoreOptions:
    flush_bytes: int = 4 << 20
    auto_compact: bool = True
    compaction: CompactionConfig = field(default_factory=CompactionConfig)
    #: bytes of entries aimed at in one file of a table
    file_bytes: int = 256 << 20
    max_rounds: int = 1000
    #: "manifest" syncs manifests of a local store, "always" its segments too, "never" nothing
    sync: str = "manifest"
    #: so many names of batches are kept to know a batch that comes again (streams: the last number)
    batch_names: int = 10_000
    #: seconds for which vacuum spares what no manifest names, as a writer may still be at it
    vacuum_age: float = 3600.0
    #: seconds after which a snapshot of another process counts as abandoned
    lease_age: float = 86_400.0

    def __post_init__(self):
        if self.sync not in ("manifest", "always", "never"):
            raise ValueError("sync is manifest, always or never")


def _checksum() -> Column:
    return F.coalesce(F.bit_xor(F.xxhash64(*LOG.names)), F.lit(0))


class SimulatedCrash(OSError):
    """Raised by a test hook between writing data and committing it."""


class Registry:
    """Live snapshots: how many there are at each sequence number, and of each manifest."""

    def __init__(self):
        self._lock, self._seqs, self._versions = threading.Lock(), Counter(), Counter()

    def acquire(self, version: int, seq: int) -> None:
        with self._lock:
            self._seqs[seq] += 1
            self._versions[version] += 1

    def release(self, version: int, seq: int) -> None:
        with self._lock:
            for held, k in ((self._seqs, seq), (self._versions, version)):
                held[k] -= 1
                if not held[k]:
                    del held[k]

    def oldest(self) -> int | None:
        with self._lock:
            return min(self._seqs, default=None)

    def versions(self) -> set[int]:
        with self._lock:
            return set(self._versions)

    def live_count(self) -> int:
        with self._lock:
            return sum(self._seqs.values())


class _Shared:
    """What the handles of one process on one path have in common."""

    def __init__(self):
        self.snapshots, self.writer, self.compactor = Registry(), threading.RLock(), threading.RLock()
        #: held to pin a manifest, and to remove those that nobody pins
        self.gate = threading.RLock()
        self.syncs = 0


_shared: weakref.WeakValueDictionary[str, _Shared] = weakref.WeakValueDictionary()
_shared_lock = threading.Lock()


def _shared_of(path: str) -> _Shared:
    with _shared_lock:
        found = _shared.get(path)
        if found is None:
            found = _shared[path] = _Shared()
        return found


class Snapshot:
    """A pinned view. Use it in a ``with`` statement, or call ``release``."""

    def __init__(self, store: Store):
        self._store = store
        with store._shared.gate:
            while True:
                self.manifest = store.manifest()
                self.seq = self.manifest.max_seq
                try:
                    self._lease = store.manifests.lease(self.manifest.version, self.seq)
                    break
                except CommitConflict:
                    continue  # another process removed that version meanwhile
            store.snapshots.acquire(self.manifest.version, self.seq)

    def release(self) -> None:
        if self._lease is not None:
            lease, self._lease = self._lease, None
            self._store.snapshots.release(self.manifest.version, self.seq)
            self._store.manifests.drop(lease)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Store:
    """A handle; handles on one path may be many, in one process or several, and threads may share
    one. Opening removes what commits that never ended left beside the manifests."""

    def __init__(self, spark: SparkSession, path: str | None = None, options: StoreOptions | None = None):
        #: without a path a store is for this process only: never flushed or compacted, gone at its end
        self.is_durable = path is not None
        self.spark, self.path, self.options = spark, (path or fresh_folder(spark, "store")).rstrip("/"), options or StoreOptions()
        self.manifests = ManifestLog(spark, self.path)
        self._shared = _shared_of(self.path)
        self.snapshots, self._writer = self._shared.snapshots, self._shared.writer
        self.recovered = self.manifests.clean(self.options.vacuum_age)
        #: called with a step's name before its commit; a test makes it raise
        self.fault = lambda step: None

    # -- reading ---------------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        return self.manifests.read()

    def snapshot(self) -> Snapshot:
        return Snapshot(self)

    def _view(self, snapshot: Snapshot | None) -> tuple[Manifest, int]:
        manifest = snapshot.manifest if snapshot else self.manifest()
        return manifest, manifest.max_seq

    def segments(self, manifest: Manifest | None = None, pick=lambda s: True) -> DataFrame:
        """Versions with the slot of the segment that holds them."""
        manifest = manifest or self.manifest()
        chosen = [s for s in (*manifest.tables, *manifest.logged) if s.num_entries and pick(s)]
        out = None
        by_slot: dict[tuple[int, int], list[str]] = {}
        for s in chosen:
            by_slot.setdefault(s.slot, []).append(f"{self.path}/{s.path}")
        for slot, paths in by_slot.items():
            part = self.spark.read.schema(LOG).parquet(*paths).withColumns({"table_seq": F.lit(slot[0]).cast("bigint"), "generation": F.lit(slot[1])})
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], LOG).withColumns({"table_seq": F.lit(0).cast("bigint"), "generation": F.lit(0)})

    def log(self, manifest: Manifest | None = None, pick=lambda s: True) -> DataFrame:
        """All versions that segments hold. A commit moves a version from one segment to another
        at once, so none is held twice and there is nothing to make distinct."""
        manifest = manifest or self.manifest()
        paths = [f"{self.path}/{s.path}" for s in (*manifest.tables, *manifest.logged) if s.num_entries and pick(s)]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def scan(self, snapshot: Snapshot | None = None, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """The live view, in key order."""
        manifest, seq = self._view(snapshot)
        return visibility.scan(self.log(manifest, lambda s: s.may_overlap(start, end)), seq, start, end).orderBy("user_key")

    def get(self, key: bytes, snapshot: Snapshot | None = None) -> bytes | None:
        """One value. It costs a Spark job; ``multi_get`` is for many."""
        manifest, seq = self._view(snapshot)
        row = visibility.get(self.log(manifest, lambda s: s.may_contain(key)), key, seq).first()
        return None if row is None else bytes(row["value"])

    def multi_get(self, probes: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """``probes`` has probe_id and user_key, and may have a column snapshot of its own."""
        manifest, seq = self._view(snapshot)
        at = F.least(F.col("snapshot"), F.lit(seq)) if "snapshot" in probes.columns else F.lit(seq)
        return visibility.multi_get(self.log(manifest), probes.withColumn("snapshot", at.cast("bigint")))

    def contains(self, key: bytes, snapshot: Snapshot | None = None) -> bool:
        return self.get(key, snapshot) is not None

    def count(self, snapshot: Snapshot | None = None) -> int:
        manifest, seq = self._view(snapshot)
        return visibility.count_live(self.log(manifest), seq).first()["n_live"]

    def is_empty(self, snapshot: Snapshot | None = None) -> bool:
        manifest, seq = self._view(snapshot)
        return visibility.is_empty(self.log(manifest), seq).first()["is_empty"]

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Mutations after one sequence number up to another, as far as they were not collected."""
        manifest = self.manifest()
        upto = manifest.max_seq if upto is None else upto
        return visibility.changes_between(self.log(manifest, lambda s: s.max_seq > after), after, upto)

    def current_seq(self) -> int:
        return self.manifest().max_seq

    def size_bytes(self) -> int:
        """Of what was logged since the last flush."""
        return sum(s.size_bytes for s in self.manifest().logged)

    def stats(self) -> dict:
        """What the latest manifest says of the store; no data is read."""
        manifest = self.manifest()
        held = (*manifest.tables, *manifest.logged)
        return {
            "version": manifest.version,
            "current_seq": manifest.max_seq,
            "tables": [s.slot for s in manifest.tables],
            "table_rows": [asdict(s) for s in manifest.tables],
            "table_bytes": sum(s.size_bytes for s in manifest.tables),
            "logged_batches": len(manifest.logged),
            "logged_bytes": sum(s.size_bytes for s in manifest.logged),
            "num_entries": sum(s.num_entries for s in held),
            "num_tombstones": sum(s.num_tombstones for s in held),
            "bytes_written": manifest.bytes_written,
            "snapshots": self.snapshots.live_count(),
            "leases": len(self.manifests.leases(self.options.lease_age)),
            "syncs": self._shared.syncs,
            "is_durable": self.is_durable,
            "options": asdict(self.options),
        }

    def verify(self) -> list[str]:
        """Segments whose rows are not those that were committed, by count and checksum: one job."""
        segments = (*self.manifest().tables, *self.manifest().logged)
        parts = [self.spark.read.schema(LOG).parquet(f"{self.path}/{s.path}").withColumn("_n", F.lit(i)) for i, s in enumerate(segments)]
        if not parts:
            return []
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionAll(part)
        found = {r[0]: (r[1], r[2]) for r in rows.groupBy("_n").agg(F.count(F.lit(1)), _checksum()).collect()}
        return [s.path for i, s in enumerate(segments) if found.get(i, (0, 0)) != (s.num_entries, s.checksum)]

    def write_amplification(self) -> float:
        manifest = self.manifest()
        held = sum(s.size_bytes for s in (*manifest.tables, *manifest.logged))
        return manifest.bytes_written / held if held else 0.0

    # -- writing ---------------------------------------------------------------------------------

    def _write(self, df: DataFrame, step: str, table_seq: int, generation: int, files: int | None = None) -> Segment:
        """A segment's files, and its row of the manifest as observed while they are written."""
        name = f"segments/{table_seq:010}-{generation:04}-{uuid.uuid4().hex}"
        out = df.select(*LOG.names)
        if files:
            # ranges of key and number, so that a hot key can be in several files
            order = [F.col("user_key"), F.desc("seq")]
            out = out.repartitionByRange(files, *order).sortWithinPartitions(*order)
        seen = Observation()
        out = out.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count_if("is_tombstone").alias("dead"),
            F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("bytes"),
            F.hex(F.min("user_key")).alias("low"),
            F.hex(F.max("user_key")).alias("high"),
            F.coalesce(F.max("seq"), F.lit(0)).alias("seq"),
            _checksum().alias("checksum"),
        )
        out.write.option("parquet.bloom.filter.enabled#user_key", "true").parquet(f"{self.path}/{name}")
        if self.options.sync == "always":
            self._sync_folder(name)
        self.fault(step)
        got = seen.get
        return Segment(name, table_seq, generation, *(got[k] for k in ("rows", "dead", "bytes", "low", "high", "seq", "checksum")))

    def _commit(self, manifest: Manifest) -> None:
        self.manifests.commit(manifest, sync=self.options.sync != "never")

    def _sync_folder(self, name: str) -> None:
        if not self.manifests.local:
            return
        folder = self.manifests._plain(f"{self.path}/{name}")
        for entry in os.listdir(folder):
            with open(os.path.join(folder, entry), "rb") as f:
                os.fsync(f.fileno())
        sync_folder(folder)
        self._shared.syncs += 1

    def sync(self) -> None:
        """Force all that the latest manifest names to a local disk."""
        manifest = self.manifest()
        for s in (*manifest.tables, *manifest.logged):
            self._sync_folder(s.path)
        if self.manifests.local:
            sync_folder(self.manifests._plain(self.manifests.dir))

    def write_batch(self, batch: DataFrame, batch_id: str | tuple[str, int] | None = None) -> int:
        """``batch`` has user_key, is_tombstone, value and a column ``position`` that orders it; a
        null key, flag or position raises ValueError and nothing is written. Gives the last sequence
        number. A ``batch_id`` that was committed before changes nothing; a pair is a stream's name
        and a number that grows from batch to batch."""
        with self._writer:
            if (known := self._known(self.manifest(), batch_id)) is not None:
                return known
            rows = self._staged(batch)
            try:
                while True:
                    base = self.manifest()
                    if (known := self._known(base, batch_id)) is not None:
                        return known
                    segment = self._write(self._numbered(rows, base.max_seq), "batch", base.next_table_seq, 0)
                    if not segment.num_entries:
                        return base.max_seq
                    named = self._named(base, batch_id, segment.max_seq)
                    changed = base.next(max_seq=segment.max_seq, logged=(*base.logged, segment), bytes_written=base.bytes_written + segment.size_bytes, **named)
                    try:
                        self._commit(changed)
                        break
                    except CommitConflict:
                        continue  # numbers were taken from a state that is no longer the latest
            finally:
                self.manifests.delete(self._staging)
            if sum(s.size_bytes for s in changed.logged) >= self.options.flush_bytes:
                self.flush()
            return segment.max_seq

    def write_run(self, run: DataFrame) -> Segment | None:
        """Versions that have their numbers already (the log's columns), as one table sorted by key:
        a bulk load from another log. ValueError for nulls, for two versions of one key and number,
        and for numbers that are not above all of this store, as those would change its past."""
        if not self.is_durable:
            raise ValueError("a store without a path has no tables")
        with self._writer:
            base = self.manifest()
            table = self._write(run, "run", base.next_table_seq, 0, self.spark.sparkContext.defaultParallelism)
            rows = self.spark.read.schema(LOG).parquet(f"{self.path}/{table.path}")
            null = F.col("user_key").isNull() | F.col("seq").isNull() | F.col("is_tombstone").isNull()
            lost = rows.agg(F.count_if(null), F.min("seq")).first()
            again = rows.groupBy("user_key", "seq").count().where("count > 1").limit(1).count()
            if lost[0] or again or table.num_entries and lost[1] <= base.max_seq:
                self.manifests.delete(f"{self.path}/{table.path}")
                raise ValueError("a run needs keys, numbers and flags, each version once, and numbers above the store's")
            if not table.num_entries:
                self.manifests.delete(f"{self.path}/{table.path}")
                return None
            self.flush()
            while True:
                now = self.manifest()
                if now.max_seq >= lost[1]:
                    self.manifests.delete(f"{self.path}/{table.path}")
                    raise ValueError("another writer took these numbers")
                placed = replace(table, table_seq=now.next_table_seq)
                changed = now.next(tables=(*now.tables, placed), max_seq=table.max_seq, next_table_seq=now.next_table_seq + 1, bytes_written=now.bytes_written + table.size_bytes)
                try:
                    self._commit(changed)
                    return placed
                except CommitConflict:
                    continue

    def _known(self, manifest: Manifest, batch_id: str | tuple[str, int] | None) -> int | None:
        if isinstance(batch_id, tuple):
            number, seq = manifest.streams.get(batch_id[0], (-1, 0))
            return seq if batch_id[1] <= number else None
        return manifest.batches.get(batch_id)

    def _named(self, base: Manifest, batch_id: str | tuple[str, int] | None, seq: int) -> dict:
        if isinstance(batch_id, tuple):
            return {"streams": {**base.streams, batch_id[0]: [batch_id[1], seq]}}
        if batch_id is None:
            return {}
        return {"batches": dict([*base.batches.items(), (batch_id, seq)][-self.options.batch_names :])}

    def _staged(self, batch: DataFrame) -> DataFrame:
        """The batch as it was evaluated, once, in ranges of position; nulls are refused."""
        self._staging = f"{self.path}/segments/staging-{uuid.uuid4().hex}"
        rows = batch.select("user_key", "is_tombstone", F.when(~F.col("is_tombstone"), F.coalesce("value", F.lit(b""))).alias("value"), "position")
        rows = rows.repartitionByRange("position").sortWithinPartitions("position")
        bad = F.count_if(F.col("user_key").isNull() | F.col("is_tombstone").isNull() | F.col("position").isNull())
        seen = Observation()
        made = rows.observe(seen, bad.alias("bad")).withColumn("_part", F.spark_partition_id())
        made.write.parquet(self._staging)
        if seen.get["bad"]:
            self.manifests.delete(self._staging)
            raise ValueError(f"{seen.get['bad']} rows of the batch have no key, flag or position")
        return self.spark.read.schema(made.schema).parquet(self._staging)

    def _numbered(self, rows: DataFrame, base: int) -> DataFrame:
        """Consecutive numbers in the order of position: rows are counted by range first, so that
        no task has to number all of them. Rows of one position, which nothing orders, are numbered
        by their keys and values."""
        parts = before_part(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "n")
        row = F.row_number().over(Window.partitionBy("_part").orderBy("position", "user_key", "value"))
        # as many rows as ranges
        return rows.withColumn("_row", row).join(F.broadcast(parts), "_part").withColumn("seq", F.lit(base) + F.col("before") + F.col("_row"))

    def _rows(self, rows: Iterable[tuple[bytes, bytes | None]]) -> DataFrame:
        data = [(i, bytes(k), v is None, v) for i, (k, v) in enumerate(rows)]
        return self.spark.createDataFrame(data, "position bigint, user_key binary, is_tombstone boolean, value binary")

    def put(self, key: bytes, value: bytes) -> int:
        return self.write_batch(self._rows([(key, value)]))

    def apply(self, rows: Iterable[tuple[bytes, bytes | None]], batch_id: str | None = None) -> int:
        """Puts, and deletes where the value is None, as one atomic batch."""
        return self.write_batch(self._rows(rows), batch_id)

    def delete(self, key: bytes) -> bool:
        """Whether a live value was there. The tombstone is written either way."""
        with self._writer:
            existed = self.contains(key)
            self.write_batch(self._rows([(key, None)]))
            return existed

    # -- maintenance -----------------------------------------------------------------------------

    def floor(self) -> int:
        """The oldest sequence number that a reader of any handle or process can hold."""
        held = [seq for _, seq in self.manifests.leases(self.options.lease_age)]
        oldest = self.snapshots.oldest()
        return min([self.manifest().max_seq, *held, *([] if oldest is None else [oldest])])

    def _files(self, size: int) -> int:
        return max(1, -(-size // self.options.file_bytes))

    def flush(self) -> Segment | None:
        """Logged batches as one table, sorted by key. None if nothing was logged."""
        with self._writer:
            base = self.manifest()
            if not base.logged or not self.is_durable:
                return None
            size = sum(s.size_bytes for s in base.logged)
            merged = self.spark.read.schema(LOG).parquet(*(f"{self.path}/{s.path}" for s in base.logged))
            table = self._write(merged, "flush", base.next_table_seq, 0, self._files(size))
            while True:
                now = self.manifest()
                gone = {s.path for s in base.logged}
                if not gone <= {s.path for s in now.logged}:
                    return None  # someone else flushed them
                changed = now.next(
                    tables=(*now.tables, table),
                    logged=tuple(s for s in now.logged if s.path not in gone),
                    next_table_seq=max(now.next_table_seq, table.table_seq + 1),
                    bytes_written=now.bytes_written + table.size_bytes,
                )
                try:
                    self._commit(changed)
                    break
                except CommitConflict:
                    continue
            if self.options.auto_compact:
                self.compact_all()
            return table

    def compact(self) -> bool:
        """One planned merge. False if there is none to do. Writers and readers go on meanwhile: the
        floor only rises, and the commit is refused if the inputs changed."""
        with self._shared.compactor:
            base = self.manifest()
            if not self.is_durable:
                return False
            task = plan([{"table_seq": s.table_seq, "generation": s.generation, "size_bytes": s.size_bytes} for s in base.tables], self.options.compaction)
            if task is None:
                return False
            inputs = base.tables[task.start : task.start + task.width]
            rows = visibility.merge(self.segments(base.next(tables=inputs, logged=())))
            kept = retention.collect_versions(rows, self.floor(), task.drop_tombstones)
            table = self._write(kept, "compact", *task.output_slot, self._files(task.input_bytes))
            while True:
                now = self.manifest()
                paths = [s.path for s in now.tables]
                if [s.path for s in inputs] != paths[task.start : task.start + task.width]:
                    return False
                changed = now.next(tables=(*now.tables[: task.start], table, *now.tables[task.start + task.width :]), bytes_written=now.bytes_written + table.size_bytes)
                try:
                    self._commit(changed)
                    return True
                except CommitConflict:
                    continue

    def compact_all(self) -> int:
        rounds = 0
        while rounds < self.options.max_rounds and self.compact():
            rounds += 1
        return rounds

    def compact_in_background(self) -> Future:
        """``compact_all`` in a thread of its own; the future has the number of merges."""
        out: Future = Future()

        def work() -> None:
            try:
                out.set_result(self.compact_all())
            except BaseException as e:  # noqa: BLE001 - whoever asks for the result gets it
                out.set_exception(e)

        threading.Thread(target=work, name="tidemark-compaction", daemon=True).start()
        return out

    def vacuum(self, min_age: float | None = None) -> list[str]:
        """Delete manifests and folders that neither the latest version nor a snapshot of any handle
        or process needs, and leftovers of commits. What is younger than ``min_age`` seconds (the
        option ``vacuum_age``) stays, as its writer may be about to commit it."""
        min_age = self.options.vacuum_age if min_age is None else min_age
        with self._writer, self._shared.compactor, self._shared.gate:
            leased = {v for v, _ in self.manifests.leases(self.options.lease_age)}
            live = self.snapshots.versions() | leased | {self.manifest().version}
            named: set[str] = set()
            for v in self.manifests.versions():
                if v in live or self.manifests.age(f"{self.manifests.dir}/{v:012}.json") < min_age:
                    m = self.manifests.read(v)
                    named |= {s.path.split("/")[-1] for s in (*m.tables, *m.logged)}
                else:
                    self.manifests.remove(v)
            self.manifests.clean(min_age)
            found = self.manifests.folders(f"{self.path}/segments")
            gone = [f for f in found if f not in named and self.manifests.age(f"{self.path}/segments/{f}") >= min_age]
            for f in gone:
                self.manifests.delete(f"{self.path}/segments/{f}")
            return gone
