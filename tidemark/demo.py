"""A short tour of the store: ``python -m tidemark.demo [path]``."""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import SparkSession

from tidemark.functions.bloom import Bloom
from tidemark.plans.compaction import CompactionConfig
from tidemark.store import Store, StoreOptions


def main(spark: SparkSession, path: str) -> list[str]:
    """What the tour prints, line by line."""
    out = []
    store = Store(spark, path, StoreOptions(auto_compact=False, compaction=CompactionConfig(min_merge_width=2)))
    store.apply([(b"apple", b"1"), (b"mango", b"2"), (b"zebra", b"3")])
    store.delete(b"zebra")
    out.append(f"live {store.count()} of {store.manifest().max_seq} versions")
    with store.snapshot() as then:
        for i in range(3):
            store.apply([(b"apple", b"new-%d" % i), (b"mango", None)])
            store.flush()
        out.append(f"apple is {store.get(b'apple')!r}, and was {store.get(b'apple', then)!r}")
        before = store.stats()
        merges = store.compact_all()
        after = store.stats()
        out.append(f"{merges} merges: {before['num_entries']} entries in {len(before['tables'])} tables, then {after['num_entries']} in {len(after['tables'])}")
        out.append(f"at the snapshot still {store.count(then)} live")
    again = Store(spark, path)
    out.append(f"opened again: {[bytes(r.user_key).decode() for r in again.scan().collect()]}, damaged segments {again.verify()}")
    bloom = Bloom.for_keys(5000)
    bloom.insert([b"key%d" % i for i in range(5000)])
    out.append(f"filter of 5000 keys: {bloom.size_bytes()} bytes, {bloom.num_hashes} probes a key, {bloom.estimated_fp_rate():.4f} false positives")
    return out


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    print("\n".join(main(session, sys.argv[1] if len(sys.argv) > 1 else "file://" + tempfile.mkdtemp())))
    session.stop()
