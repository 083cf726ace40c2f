"""The store end to end: snapshots over flushes and compaction, crashes, conflicts, streams."""

import random

import pytest

from tidemark.plans.compaction import CompactionConfig
from tidemark.schema import LOG
from tidemark.sources.manifest import CommitConflict
from tidemark.store import SimulatedCrash, Store, StoreOptions
from tidemark.streaming.ingest import ingest, latest

QUIET = StoreOptions(auto_compact=False)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", QUIET)


def view(store, snapshot=None):
    return {bytes(r.user_key): bytes(r.value) for r in store.scan(snapshot).collect()}


def test_put_delete_and_reopen(spark, store):
    assert store.is_empty() and store.current_seq() == 0 and store.flush() is None and not store.compact()
    store.put(b"a", b"1")
    store.apply([(b"b", b""), (b"c", b"3"), (b"a", b"2")])
    assert store.delete(b"c") and not store.delete(b"absent")
    assert view(store) == {b"a": b"2", b"b": b""} and store.count() == 2 and store.current_seq() == 6
    assert store.get(b"b") == b"" and store.get(b"c") is None and store.contains(b"a") and not store.contains(b"x")
    again = Store(spark, store.path, QUIET)
    assert view(again) == view(store)
    again.put(b"d", b"4")
    assert store.get(b"d") == b"4" and store.current_seq() == 7


def test_snapshots_outlive_flush_compaction_and_vacuum(store):
    store.options = StoreOptions(auto_compact=False, compaction=CompactionConfig(min_merge_width=2))
    store.put(b"k", b"old")
    store.put(b"gone", b"x")
    with store.snapshot() as held, store.snapshot() as twin:
        assert store.snapshots.live_count() == 2 and held.seq == twin.seq
        for i in range(4):
            store.apply([(b"k", b"new-%d" % i), (b"gone", None)])
            store.flush()
        assert store.compact_all() > 0
        store.vacuum(0)
        assert view(store, held) == {b"k": b"old", b"gone": b"x"} and store.get(b"k", held) == b"old"
        assert view(store) == {b"k": b"new-3"}
    assert store.floor() == store.current_seq()
    for i in range(2):
        store.put(b"other", b"%d" % i)
        store.flush()
    store.compact_all()
    gone = store.vacuum(0)
    assert gone and view(store) == {b"k": b"new-3", b"other": b"1"} and store.manifests.versions() == [store.manifest().version]


def test_versions_collapse_without_snapshots(store):
    for i in range(10):
        store.put(b"k", b"v%d" % i)
        store.flush()
    store.compact_all()
    tables = store.manifest().tables
    assert len(tables) == 1 and tables[0].num_entries == 1 and tables[0].slot == (9, 1)
    assert store.get(b"k") == b"v9" and store.write_amplification() > 1


def test_range_scan_and_multi_get(spark, store):
    store.apply([(b"%03d" % i, b"first") for i in range(60)])
    snap = store.snapshot()
    store.apply([(b"%03d" % i, b"second") for i in range(0, 60, 3)] + [(b"%03d" % i, None) for i in range(0, 60, 5)])
    store.flush()
    now = {b"%03d" % i: b"second" if i % 3 == 0 else b"first" for i in range(60) if i % 5}
    assert view(store) == now and set(view(store, snap).values()) == {b"first"} and len(view(store, snap)) == 60
    got = {bytes(r.user_key) for r in store.scan(start=b"010", end=b"020").collect()}
    assert got == {k for k in now if b"010" <= k < b"020"}
    probes = spark.createDataFrame([(i, b"%03d" % i) for i in range(0, 80, 4)], "probe_id long, user_key binary")
    for r in store.multi_get(probes).collect():
        assert (None if r.value is None else bytes(r.value)) == now.get(bytes(r.user_key))
    assert store.changes(snap.seq).count() == 20 + 12
    snap.release()


def test_batch_ids_are_idempotent(store):
    a = store.apply([(b"k", b"1"), (b"l", b"1")], batch_id="s-0")
    assert store.apply([(b"k", b"1"), (b"l", b"1")], batch_id="s-0") == a == 2 and store.current_seq() == 2


def test_second_writer_of_a_version_loses(spark, store):
    store.put(b"k", b"1")
    base = store.manifest()
    store.manifests.commit(base.next(max_seq=99))
    with pytest.raises(CommitConflict):
        store.manifests.commit(base.next(max_seq=50))
    assert store.put(b"k", b"2") == 100


def test_crash_between_data_and_commit(spark, tmp_path):
    rng = random.Random(11)
    for run in range(4):
        store, model, crashed = Store(spark, f"file://{tmp_path}/s{run}", QUIET), {}, False
        for step in range(8):
            if step == 5:
                fail = rng.choice(["batch", "flush", "compact"])

                def fault(name, fail=fail):
                    if name == fail:
                        raise SimulatedCrash(name)

                store.fault = fault
                store.options = StoreOptions(auto_compact=False, compaction=CompactionConfig(min_merge_width=2))
            rows = [(b"k%d" % rng.randrange(6), rng.choice([None, b"%d" % step])) for _ in range(3)]
            try:
                store.apply(rows)
                model.update(rows)
                store.flush()
                store.compact()
            except SimulatedCrash:
                crashed = True
                break
        assert crashed
        again = Store(spark, store.path, QUIET)
        live = {k: v for k, v in model.items() if v is not None}
        assert view(again) == live
        again.vacuum(0)
        assert view(again) == live and again.put(b"new", b"1") > 0


def test_auto_flush_and_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/auto", StoreOptions(flush_bytes=1, compaction=CompactionConfig(min_merge_width=2)))
    for i in range(5):
        store.put(b"k", b"v%d" % i)
    assert not store.manifest().logged and len(store.manifest().tables) < 5 and store.get(b"k") == b"v4"


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    src, store = str(tmp_path / "src"), Store(spark, f"file://{tmp_path}/stream", QUIET)
    for part in range(3):
        rows = [(b"k%d" % (i % 4), i % 7 == 0, None if i % 7 == 0 else b"%d-%d" % (part, i), part * 100 + i) for i in range(20)]
        spark.createDataFrame(rows, "user_key binary, is_tombstone boolean, value binary, position long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("user_key binary, is_tombstone boolean, value binary, position long").option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):  # the second run finds nothing new
        ingest(stream, store, str(tmp_path / "ck")).awaitTermination()
        assert store.current_seq() == 60 and store.manifest().streams == {"ingest": [2, 60]}


def test_streaming_latest(spark, tmp_path):
    src = str(tmp_path / "log")
    rows = [(b"k%d" % (i % 5), i + 1, i % 6 == 0, None if i % 6 == 0 else b"%d" % i) for i in range(40)]
    for part in (rows[20:], rows[:20]):  # newest first: order of arrival does not matter
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    query = latest(stream).writeStream.outputMode("update").format("memory").queryName("newest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("newest").collect():
        if r.seq >= got.get(bytes(r.user_key), (0,))[0]:
            got[bytes(r.user_key)] = (r.seq, r.is_tombstone)
    want = {}
    for k, s, t, _ in rows:
        want[k] = (s, t)
    assert got == want


def test_store_without_a_path(spark):
    store = Store(spark)
    store.apply([(b"a", b"1"), (b"b", b"2")])
    store.delete(b"a")
    assert view(store) == {b"b": b"2"} and not store.is_durable
    assert store.flush() is None and not store.compact() and store.stats()["tables"] == []


def test_stats_and_verify(spark, store, tmp_path):
    import pathlib

    store.apply([(b"a", b"1"), (b"b", None)])
    store.flush()
    store.put(b"c", b"3")
    stats = store.stats()
    assert (stats["num_entries"], stats["num_tombstones"], stats["tables"], stats["logged_batches"], stats["current_seq"]) == (3, 1, [(0, 0)], 1, 3)
    assert store.verify() == []
    table = store.manifest().tables[0]
    folder = pathlib.Path(store.path.removeprefix("file://")) / table.path
    for f in folder.glob("*.parquet"):
        f.unlink()
    for f in folder.glob(".*.crc"):
        f.unlink()
    spark.createDataFrame([(b"a", 1, False, b"X"), (b"b", 2, True, None)], LOG).write.mode("append").parquet(str(folder))
    assert store.verify() == [table.path]


def test_snapshots_protect_all_handles_and_processes(spark, store):
    """What one handle pins, another one's compaction and vacuum leave alone; and what a lease pins
    that no registry of this process knows."""
    merging = StoreOptions(auto_compact=False, compaction=CompactionConfig(min_merge_width=2))
    store.put(b"k", b"old")
    held = store.snapshot()
    other = Store(spark, store.path, merging)
    elsewhere = other.manifests.lease(other.manifest().version, other.current_seq())
    for i in range(3):
        other.put(b"k", b"new-%d" % i)
        other.flush()
    assert other.compact_all() > 0
    other.vacuum(0)
    assert store.get(b"k", held) == b"old" and other.floor() == held.seq == 1
    held.release()
    other.vacuum(0)
    assert other.floor() == 1 and held.manifest.version in other.manifests.versions()
    other.manifests.drop(elsewhere)
    assert other.floor() == other.current_seq() and other.stats()["leases"] == 0
    assert other.vacuum(0) and view(store) == {b"k": b"new-2"}
    old = other.manifests.lease(other.manifest().version, 1)
    assert other.manifests.leases(-1) == [] and not other.manifests._fs.exists(other.manifests._path(old))


def test_threads_share_a_handle(spark, tmp_path):
    """Writers, readers and a background merge at once: no write is lost, every read is of a moment."""
    import threading

    store = Store(spark, f"file://{tmp_path}/threads", StoreOptions(auto_compact=False, compaction=CompactionConfig(min_merge_width=2)))
    store.apply([(b"a", b"0"), (b"b", b"0")])
    errors, reads = [], []

    def write(name):
        try:
            for i in range(3):
                store.apply([(b"a", b"%s%d" % (name, i)), (b"b", b"%s%d" % (name, i)), (name, b"%d" % i)])
                store.flush()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def read():
        try:
            for _ in range(4):
                with store.snapshot() as s:
                    got = view(store, s)
                    reads.append(got[b"a"] == got[b"b"])
                    assert got == view(store, s)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in (b"x", b"y")] + [threading.Thread(target=read)]
    for t in threads:
        t.start()
    merged = store.compact_in_background()
    for t in threads:
        t.join()
    merged.result()
    store.compact_all()
    got = view(store)
    assert not errors and all(reads) and store.current_seq() == 2 + 18
    assert got[b"x"] == got[b"y"] == b"2" and got[b"a"] == got[b"b"]


def test_bad_batches_are_refused_whole(spark, store):
    kind = "user_key binary, is_tombstone boolean, value binary, position long"
    for row in ((b"k", False, b"v", None), (None, False, b"v", 1), (b"k", None, b"v", 1)):
        for rows in ([row], [(b"a", False, b"v", 0), row]):
            with pytest.raises(ValueError):
                store.write_batch(spark.createDataFrame(rows, kind))
    assert store.current_seq() == 0 and not store.manifest().logged
    assert store.manifests.folders(f"{store.path}/segments") == []
    assert store.write_batch(spark.createDataFrame([], kind)) == 0


def test_a_batch_is_evaluated_once(spark, store):
    """Positions and values that are dealt anew at each evaluation still give one sequence."""
    from pyspark.sql import functions as F

    batch = spark.range(500).select(F.col("id").cast("string").cast("binary").alias("user_key"), F.lit(False).alias("is_tombstone"), F.uuid().cast("binary").alias("value"), F.floor(F.rand() * 1e18).alias("position"))
    assert store.write_batch(batch.repartition(5)) == 500
    log = store.log()
    assert sorted(r.seq for r in log.collect()) == list(range(1, 501)) and log.select("user_key").distinct().count() == 500
    assert store.verify() == []


def test_batch_names_have_a_bound(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/names", StoreOptions(auto_compact=False, batch_names=2))
    for i in range(3):
        store.apply([(b"k", b"%d" % i)], batch_id=f"b{i}")
    assert list(store.manifest().batches) == ["b1", "b2"]
    rows = store._rows([(b"s", b"1")])
    assert store.write_batch(rows, ("s", 4)) == store.write_batch(rows, ("s", 4)) == store.write_batch(rows, ("s", 3)) == 4
    assert store.write_batch(rows, ("s", 5)) == 5


def test_leftovers_go_on_open_and_sync(spark, tmp_path):
    path = tmp_path / "left"
    store = Store(spark, f"file://{path}", StoreOptions(auto_compact=False, sync="always"))
    store.put(b"k", b"v")
    store.sync()
    assert store.stats()["syncs"] == 2 and store.stats()["options"]["sync"] == "always"
    left = path / "_manifest" / ".0123.tmp"
    left.write_text("{")
    assert Store(spark, store.path).recovered == [] and left.exists()  # it is young
    assert Store(spark, store.path, StoreOptions(vacuum_age=0)).recovered == [".0123.tmp"] and not left.exists()
    assert store.get(b"k") == b"v"
    with pytest.raises(ValueError):
        StoreOptions(sync="sometimes")


def test_shared_folder_must_be_named_on_a_cluster():
    from tidemark.sources.shared import shared_dir

    class Far:
        class sparkContext:  # noqa: N801
            master = "yarn"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("c", (), {"getCheckpointDir": staticmethod(lambda: type("o", (), {"isDefined": staticmethod(lambda: False)}))})

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        shared_dir(Far)


def test_demo(spark, tmp_path):
    from tidemark.demo import main

    lines = main(spark, f"file://{tmp_path}/demo")
    assert lines[0] == "live 2 of 4 versions" and lines[1] == "apple is b'new-2', and was b'1'" and lines[-2].startswith("opened again: ['apple'], damaged segments []")


def test_bulk_run_is_checked(spark, store):
    store.apply([(b"a", b"1"), (b"b", b"2")])
    run = spark.createDataFrame([(b"b", 9, False, b"9"), (b"a", 5, True, None), (b"b", 4, False, b"4")], LOG)
    for bad in ([(b"a", 2, False, b"x")], [(b"a", 7, False, b"x"), (b"a", 7, False, b"y")], [(b"a", 2, False, b"x"), (b"c", 9, False, b"x")]):
        with pytest.raises(ValueError):
            store.write_run(spark.createDataFrame(bad, LOG))
    with pytest.raises(ValueError):
        store.write_run(spark.createDataFrame([(None, 7, False, b"x")], "user_key binary, seq long, is_tombstone boolean, value binary"))
    assert store.current_seq() == 2
    table = store.write_run(run)
    assert (table.num_entries, table.num_tombstones, table.max_seq) == (3, 1, 9) and store.write_run(run.limit(0)) is None
    assert view(store) == {b"b": b"9"} and store.put(b"c", b"3") == 10 and store.verify() == []
    assert [s.num_entries for s in store.manifest().tables] == [2, 3]
