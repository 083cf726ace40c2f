"""Small fixtures for reads, retention, planning, frames and filters."""

import random

import numpy as np
import pytest

from tidemark.functions.bloom import Bloom, hash_pairs, segment_blooms
from tidemark.operators import numbering, retention, statistics, visibility
from tidemark.plans.compaction import CompactionConfig, plan
from tidemark.schema import LOG
from tidemark.sources import frames


def make(spark, rows):
    return spark.createDataFrame([(k, s, v is None, v) for k, s, v in rows], LOG)


def view(df):
    return {bytes(r.user_key): bytes(r.value) for r in df.collect()}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(b"k", 1, b"v1"), (b"k", 5, b"v5"), (b"k", 9, b"v9")], {0: None, 1: b"v1", 4: b"v1", 5: b"v5", 8: b"v5", 9: b"v9", None: b"v9"}),
        ([(b"k", 1, b"v"), (b"k", 2, None)], {2: None, 1: b"v"}),
        ([(b"k", 1, b"v1"), (b"k", 2, None), (b"k", 3, b"v2")], {3: b"v2", 2: None, 1: b"v1"}),
        ([(b"k", 10, b"a"), (b"l", 1, b"b")], {5: None}),
        ([(b"k", 1, b"")], {1: b"", 0: None}),
    ],
)
def test_visibility_rule(spark, rows, want):
    log = make(spark, rows)
    for at, value in want.items():
        row = visibility.get(log, b"k", at).first()
        assert (None if row is None else bytes(row.value)) == value
        assert view(visibility.scan(log, at)).get(b"k") == value
    probes = spark.createDataFrame([(i, b"k", at) for i, at in enumerate(want) if at is not None], "probe_id long, user_key binary, snapshot long")
    for r in visibility.multi_get(log, probes).collect():
        assert (None if r.value is None else bytes(r.value)) == want[r.snapshot]


def test_half_open_range_and_byte_order(spark):
    log = make(spark, [(b"a", 1, b""), (b"b", 2, b""), (b"b", 8, None), (b"c", 3, b""), (b"d", 4, b"")])
    got = [(bytes(r.user_key), r.seq) for r in visibility.ordered(visibility.key_range(log, b"b", b"d")).collect()]
    assert got == [(b"b", 8), (b"b", 2), (b"c", 3)]
    keys = [b"", b"a", b"a\0", b"\x7f", b"\x80", b"\xff\xfe", b"\x00\x01", b"\x00\xff"]
    odd = make(spark, [(k, i + 1, b"x") for i, k in enumerate(keys)])
    assert [bytes(r.user_key) for r in visibility.ordered(odd).collect()] == sorted(keys)
    assert [bytes(r.user_key) for r in numbering.numbered(odd).orderBy("position").collect()] == sorted(keys)


def test_buffer_bytes(spark):
    rows = [(b"key", 1, b"value"), (b"key", 2, b"v"), (b"key", 3, None)]
    for n, want in ((1, 16), (2, 28), (3, 39), (0, 0)):
        assert statistics.buffer_bytes(make(spark, rows[:n])).first().size_bytes == want


def test_empty_log(spark):
    log = make(spark, [])
    assert visibility.is_empty(log).first().is_empty and visibility.count_live(log).first().n_live == 0
    assert statistics.max_seq(log).first().max_seq == 0 and visibility.scan(log).count() == 0
    assert retention.collect_versions(log, 5, True).count() == 0


def keep(rows, floor, drop):
    """The retention rule for one key at a time, newest first."""
    out = []
    for key in {k for k, _, _ in rows}:
        versions, kept = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]), []
        for r in versions:
            kept.append(r)
            if r[1] <= floor:
                break
        while drop and kept and kept[-1][2] is None:
            kept.pop()
        out += kept
    return sorted(out, key=lambda r: (r[0], -r[1]))


def test_retention_equals_model(spark):
    rng = random.Random(4)
    rows = [(b"%03d-%d" % (case, rng.randrange(3)), s + 1, None if rng.random() < 0.4 else b"%d" % s) for case in range(150) for s in range(rng.randrange(1, 14))]
    log = make(spark, rows).cache()
    for floor in (0, 3, 7, 20):
        for drop in (False, True):
            got = [(bytes(r.user_key), r.seq, None if r.value is None else bytes(r.value)) for r in visibility.ordered(retention.collect_versions(log, floor, drop)).collect()]
            assert got == keep(rows, floor, drop)


@pytest.mark.parametrize(
    ("sizes", "config", "want"),
    [
        ([100] * 3, {}, None),
        ([100] * 4, {}, (0, 4, True, (3, 1))),
        ([100, 1000, 10_000, 100_000], {}, None),
        ([100_000, 100, 100, 100, 100], {}, (1, 4, False, (4, 1))),
        ([100, 100, 5_000_000, 100, 100], {}, None),
        ([100] * 20, {"max_merge_width": 5}, (0, 5, True, (4, 1))),
        ([100] * 6, {}, (0, 6, True, (5, 1))),
        ([100, 100, 9_000_000, 100, 100, 100, 100], {}, (3, 4, False, (6, 1))),
        ([], {}, None),
        ([0] * 4, {}, (0, 4, True, (3, 1))),
    ],
)
def test_plan(sizes, config, want):
    task = plan([{"table_seq": i, "generation": 0, "size_bytes": s} for i, s in enumerate(sizes)], CompactionConfig(**config))
    assert (task and (task.start, task.width, task.drop_tombstones, task.output_slot)) == want
    with pytest.raises(ValueError):
        CompactionConfig(min_merge_width=1)


def test_frames_round_trip_and_tear(tmp_path):
    one, batch = [(1, b"a", b"1")], [(2, b"a", None), (3, b"", b""), (4, b"k" * 300, b"v")]
    data, first = frames.encode_frame(one) + frames.encode_frame(batch), len(frames.encode_frame(one))
    whole = frames.decode_prefix(data)
    assert whole.records == one + batch and whole.defect is None and (whole.frames, whole.max_seq) == (2, 4)
    for cut in range(first, len(data)):
        got = frames.decode_prefix(data[:cut])
        assert got.records == one and got.valid_bytes == first
        assert got.defect == (None if cut == first else "PartialHeader" if cut < first + 12 else "PartialPayload")
    for at in range(first, len(data)):
        bad = bytearray(data)
        bad[at] ^= 0x40
        assert frames.decode_prefix(bytes(bad)).records == one
    import struct
    import zlib

    body = struct.pack("<II", 1, 17) + struct.pack("<BQII", 7, 1, 0, 0)
    assert frames.decode_prefix(struct.pack("<I", zlib.crc32(body)) + body).defect == "MalformedPayload"


def test_frame_log(spark, tmp_path):
    path = str(tmp_path / "wal.log")
    log = frames.FrameLog(path)
    log.append_batch([(1, b"a", b"1"), (2, b"b", b"2")])
    log.append_batch([])
    log.append(3, b"a", None)
    log.close()
    got = frames.read_frames(spark, path).orderBy("seq").collect()
    assert [(r.frame_no, bytes(r.user_key), r.seq, r.is_tombstone) for r in got] == [(0, b"a", 1, False), (0, b"b", 2, False), (1, b"a", 3, True)]
    for limit in range(1, 140, 3):
        at = str(tmp_path / f"crash-{limit}.log")
        log, acknowledged = frames.FrameLog(at, sync=False, crash_after_bytes=limit), []
        for s in range(1, 9):
            try:
                log.append(s, b"k%d" % s, b"v")
                acknowledged.append(s)
            except OSError:
                break
        log.close()
        out = frames.FrameLog.replay(at)
        assert [r[0] for r in out.records] == acknowledged
        assert frames.FrameLog.replay(at).defect is None
    assert frames.FrameLog.replay(str(tmp_path / "none")).records == []


def _fnv_by_hand(key, basis):
    m = (1 << 64) - 1
    for b in key:
        basis = (basis ^ b) * 0x100000001B3 & m
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        basis = (basis ^ basis >> 33) * k & m
    return basis ^ basis >> 33


def test_bloom():
    keys = [b"", b"a", b"key-%d" % 7, b"\xff" * 40]
    a, b = hash_pairs(keys)
    assert a.tolist() == [_fnv_by_hand(k, 0xCBF29CE484222325) for k in keys]
    assert b.tolist() == [_fnv_by_hand(k, 0x9E3779B97F4A7C15) | 1 for k in keys]
    bloom = Bloom.for_keys(5000)
    bloom.insert([b"key%d" % i for i in range(5000)])
    assert bloom.num_hashes == 7 and bloom.size_bytes() == 5992 and bloom.contains([b"key%d" % i for i in range(5000)]).all()
    assert bloom.contains([b"no%d" % i for i in range(20_000)]).mean() < 0.03 and 0.005 < bloom.estimated_fp_rate() < 0.02
    again = Bloom.decode(bloom.encode())
    assert np.array_equal(again.bits, bloom.bits) and again.num_inserted == 5000
    for at in range(0, len(bloom.encode()), 97):
        bad = bytearray(bloom.encode())
        bad[at] ^= 1
        assert Bloom.decode(bytes(bad)) is None
    assert Bloom.decode(b"") is None and Bloom.for_keys(0).num_bits == 64


def test_segment_blooms_equal_driver_built(spark):
    rows = [(b"k%d" % (i % 90), i + 1, None if i % 5 == 0 else b"v") for i in range(300)]
    segments = make(spark, rows).selectExpr("*", "seq % 2 AS table_seq", "0 AS generation")
    got = {r.table_seq: r for r in segment_blooms(segments).collect()}
    for t in (0, 1):
        keys = sorted({k for k, s, _ in rows if s % 2 == t})
        bloom = Bloom.for_keys(len(keys))
        bloom.insert(keys)
        assert (got[t].num_keys, got[t].num_bits, got[t].num_hashes, got[t].bits_set) == (len(keys), bloom.num_bits, bloom.num_hashes, int(bloom.bits.sum()))


def test_rotated_and_crashed_logs(tmp_path):
    path = tmp_path / "wal.log"
    log = frames.FrameLog(str(path), sync=False, crash_after_bytes=100)
    log.append(1, b"a", b"1")
    assert log.size_bytes() == len(frames.encode_frame([(1, b"a", b"1")]))
    log.rotate()
    assert log.size_bytes() == path.stat().st_size == 0
    log.append(2, b"b", b"2")
    with pytest.raises(OSError):
        log.append(3, b"c" * 99, b"3")
    held = path.stat().st_size
    with pytest.raises(OSError):
        log.rotate()
    assert log.size_bytes() == path.stat().st_size == held > 0
    assert [r[0] for r in frames.FrameLog.replay(str(path)).records] == [2]
    again = frames.FrameLog(str(path))
    assert again.size_bytes() == path.stat().st_size


@pytest.mark.parametrize("chunk", range(5))
def test_seeded_crashes(tmp_path, chunk):
    """150 logs of random batches, each cut after a random number of bytes, with rotations: what was
    acknowledged since the last rotation is all there, in order, and batches are whole."""
    for seed in range(30 * chunk, 30 * chunk + 30):
        rng = random.Random(seed)
        path = str(tmp_path / f"{seed}.log")
        log = frames.FrameLog(path, sync=False, crash_after_bytes=rng.randrange(1, 6000))
        model, table, seq, pending = [], {}, 0, []
        for _ in range(200):
            batch = []
            for _ in range(rng.choice((1, 1, 1, 4))):
                seq += 1
                hot = rng.random() < 0.85
                key = b"hot-%d" % rng.randrange(40) if hot else b"cold-%d" % rng.randrange(500)
                batch.append((seq, key, None if hot and rng.random() < 0.3 else b"v%d" % seq))
            try:
                log.append_batch(batch)
            except OSError:
                pending = batch
                break
            model += batch
            if rng.random() < 0.05:  # what was logged becomes a table
                table.update((k, v) for _, k, v in model)
                log.rotate()
                model = []
        log.close()
        out = frames.FrameLog.replay(path)
        assert out.records == model or out.records == model + pending
        state = dict(table)
        state.update((k, v) for _, k, v in out.records)
        want = dict(table)
        want.update((k, v) for _, k, v in out.records[: len(model)])
        assert {k: v for k, v in want.items() if k not in {k for _, k, _ in pending}} == {k: v for k, v in state.items() if k not in {k for _, k, _ in pending}}
        assert frames.FrameLog.replay(path).defect is None


@pytest.mark.parametrize("ranges", [1, 4, 16])
def test_hot_keys_and_long_prefixes(spark, ranges):
    """One key and one prefix hold half of all rows; sequence numbers have an outlier."""
    rng = random.Random(ranges)
    rows = [(b"hot" if i % 2 else b"user:%03d" % rng.randrange(60), i + 1 if i < 799 else 1 << 61, None if rng.random() < 0.3 else b"%d" % i) for i in range(800)]
    log = make(spark, rows).repartition(4)
    by = {}
    for k, s, v in rows:
        by.setdefault(k, []).append((s, v))
    asks = [(i, rng.choice([b"hot", b"user:007", b"none"]), rng.choice([0, rng.randrange(900), 1 << 62])) for i in range(300)]
    probes = spark.createDataFrame(asks, "probe_id long, user_key binary, snapshot long")
    got = {r.probe_id: (r.seq, None if r.value is None else bytes(r.value)) for r in visibility.multi_get(log, probes, ranges).collect()}
    for i, k, at in asks:
        seen = max(((s, v) for s, v in by.get(k, []) if s <= at), default=(None, None))
        assert got[i] == (seen if seen[1] is not None else (None, None))
    want = {(k, s): bool([1 for t, v in by[k] if t < s]) and max((t, v) for t, v in by[k] if t < s)[1] is not None for k, s, v in rows if v is None}
    assert {(bytes(r.user_key), r.seq): r.existed for r in visibility.deletes(log, ranges).collect()} == want
    order = sorted(rows, key=lambda r: (r[0], -r[1]))
    assert [(bytes(r.user_key), r.seq) for r in numbering.numbered(log).orderBy("position").collect()] == [r[:2] for r in order]
    assert sorted(r.position for r in numbering.numbered(log).collect()) == list(range(1, 801))
    live = sum(max(v)[1] is not None for v in by.values())
    assert visibility.count_live(log).first().n_live == live and not visibility.is_empty(log).first().is_empty
    at, want = 0, {}
    for k, s, v in order:
        size = 17 + len(k) + len(v or b"")
        block = want.setdefault(at // 256, [k, s, at, 0])
        block[3] += size
        at += size
    run = log.selectExpr("*", "5L AS table_seq", "0 AS generation")
    assert {r.block: [bytes(r.first_key), r.first_seq, r.offset, r.len] for r in statistics.blocks(run, 256).collect()} == want
