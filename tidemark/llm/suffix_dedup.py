"""Suffix-array dedup: removal of bytes covered by a string of ``LENGTH`` bytes that also starts
earlier, in a smaller doc_id or before in the same document.

Sorting all suffixes of a corpus by 100 bytes would ship 100 times the corpus. So sorting is kept
for the positions that can matter, and buckets that are settled are never shipped:

1. *q-gram buckets.* In every window of ``LENGTH`` bytes the q-gram with the least hash is its
   anchor (the last one of equals), which depends on the window's bytes alone; equal windows have
   equal anchors at equal offsets. Consecutive windows with one anchor form a run, about 30
   windows long. Runs are put in buckets by their anchor's identifier, over the whole corpus.
2. *Refinement over the corpus.* Buckets are sorted by the identifiers of buckets at later offsets:
   identifiers come by doubling, those of 32 bytes used again for those of 64, and three of these
   cover the whole context of a run (all bytes of all its windows). Runs that stay in one bucket have
   equal windows throughout: all but the first are covered. If a bucket was not divided, its first
   run has no earlier windows: it is settled as well.
3. *Refinement of what is left.* First runs of buckets that were divided are cut into parts, which go
   through the same once more, and then to single windows, refined to full depth: in chunks of
   documents, initial buckets of 8 bytes are refined by sorting on the pair of bucket identifiers at
   an offset and a later one, and the updated identifiers are used again at twice the depth: 8, 16,
   32, 64, and 100 from two overlapping 64s. Windows that a chunk holds earlier are covered; the
   first ones of each class meet those of other chunks by a 128-bit digest.
4. Covered spans are joined with the documents and cut out.

Every shuffle is of runs or windows with fixed-width rows, sorted externally and read as a stream
with constant state, so a bucket of any size passes through a task without being held. Runs that
one task sees repeatedly are settled before the shuffle, so copies do not pile up on a bucket.
Contexts are told apart by identifiers or digests of 128 bits within the bucket, windows by 128 bits.

Defined cases: null and empty texts, and texts shorter than ``LENGTH``, lose nothing; rows
without doc_id, or sharing one, are put in an order of their own (nulls last, then by text) and
count as different documents, so of two equal rows the second is emptied; an empty table gives no
rows; input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import extend, keyed, pieces, release, scratch, staged, unused

LENGTH, GRAM = 100, 32
#: bytes worked on at a time; positions within fit the low bits of an order value
CHUNK = 1 << 19
_LOW = np.uint64(CHUNK - 1)
#: contexts that a task remembers, about 200 bytes each
SEEN = 1 << 16
RESULT = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: two families of identifiers, told apart by their numbers for single bytes
_BYTE = [_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)]


#: odd multipliers, one for each depth
_PAIR = {1 << k: _mixed(np.array([k + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0] | np.uint64(1) for k in range(8)}


def identifiers(data: np.ndarray, length: int, family: int, held: np.ndarray | None = None, depth: int = 1) -> np.ndarray:
    """Identifiers of the buckets of ``length`` bytes from each position, by doubling: a bucket of
    twice the depth has the pair of identifiers at an offset and at a later one. ``held`` are those
    of a smaller depth, which are used again."""
    h = _BYTE[family][data] if held is None else held
    while depth < length:
        h = h[:-depth] * _PAIR[depth] + h[depth:]
        depth *= 2
    return h


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if width > n else v


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated documents that end at ``ends``: bucket, identifiers of the context, anchor,
    first and last window of each run. ``data`` has no more than ``CHUNK`` bytes."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64).reshape(-1, 2), none, none, none
    grams = identifiers(data, GRAM, 0)
    hashes = _mixed(grams)
    order = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    least = sliding_least(order, LENGTH - GRAM + 1)
    inside = np.ones(len(least), bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    starts = np.flatnonzero(inside)
    anchor = (_LOW - (least[starts] & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(starts) else none
    last = np.append(first[1:], len(starts)) - 1 if len(starts) else none
    at, first, last = anchor[first], starts[first], starts[last]
    # buckets of twice the depth at the context's start, 64 bytes on and at its end cover all of it
    double = [identifiers(data, 2 * GRAM, 0, grams, GRAM), identifiers(data, 2 * GRAM, 1)]
    shape = ((last - first) << 8 | at - first).astype(np.uint64)
    end = last + LENGTH - 2 * GRAM
    later = np.minimum(first + 2 * GRAM, end)
    context = [_mixed(d[first] + _mixed(d[later] + _mixed(d[end] + _mixed(shape)))) for d in double]
    return hashes[at], np.stack(context, 1), at, first, last


def chunks(docs: Iterator[tuple[int, bytes]]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents joined up to ``CHUNK`` bytes: bytes, ends, doc_ids and where each begins in its
    document. Longer ones are cut into pieces that overlap, so that each window is in one."""
    held, size = [], 0

    def joined():
        return b"".join(t for _, _, t in held), np.cumsum([len(t) for _, _, t in held]), np.array([d for d, _, _ in held], np.int64), np.array([o for _, o, _ in held], np.int64)

    for doc, text in docs:
        for offset in range(0, max(1, len(text) - LENGTH + 1), CHUNK - LENGTH + 1):
            piece = text[offset : offset + CHUNK]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > CHUNK:
                yield joined()
                held, size = [], 0
            held.append((doc, offset, piece))
            size += len(piece)
    if held:
        yield joined()


def packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A run as one number that sorts by its first window: 7 bits each for the other two."""
    return (first << 14) | ((last - first) << 7) | (anchor - first)


def _digests(parts: Iterator[bytes]) -> np.ndarray:
    """128 bits of each, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.uint64).reshape(-1, 2)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["k1", "k2", "k3", "doc", "run"])


class _Seen(dict):
    """Of contexts that a task met more than once, up to ``SEEN`` of them, the first run so far."""

    def covers(self, key: tuple[int, int, int], at: tuple[int, int]) -> bool:
        """Whether a run with this context came at an earlier place; else this is the first one."""
        if self[key[1]][:3] != key:
            return False
        if self[key[1]][3:] < at:
            return True
        self[key[1]] = (*key, *at)
        return False


def _rows(k1: np.ndarray, k23: np.ndarray, doc: np.ndarray, run: np.ndarray, seen: _Seen) -> pa.RecordBatch:
    """Rows for the shuffle on ``k1``. Runs whose bucket and context come earlier in these rows, or
    in what the task is known to have seen, are covered: their number is complemented, and a bucket
    of their own spreads them. So a passage that is everywhere reaches its bucket once a task."""
    k2, k3 = k23[:, 0], k23[:, 1]
    order = np.lexsort((run, doc, k3, k2, k1))
    k1, k2, k3, doc, run = (x[order] for x in (k1, k2, k3, doc, run))
    again = np.concatenate(([False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (k3[1:] == k3[:-1]))) if len(k1) else np.empty(0, bool)
    place = lambda i: ((int(k1[i]), int(k2[i]), int(k3[i])), (int(doc[i]), int(run[i])))
    for i in [i for i, k in enumerate(k2.tolist()) if k in seen] if seen else ():
        again[i] = again[i] or seen.covers(*place(i))
    for i in np.flatnonzero(~again[:-1] & again[1:]).tolist() if len(again) else ():
        if len(seen) < SEEN and int(k2[i]) not in seen:
            key, at = place(i)
            seen[key[1]] = (*key, *at)
    own = _mixed(doc.view(np.uint64) ^ _mixed(run.view(np.uint64)))
    return _batch(np.where(again, own, k1), k2, k3, doc, np.where(again, ~run, run))


_ROWS = "k1 bigint, k2 bigint, k3 bigint, doc bigint, run bigint"


def _all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Seen()
    docs = ((d, t or b"") for batch in pieces(batches) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for data, ends, ids, offsets in chunks(docs):
        k1, k23, anchor, first, last = runs(np.frombuffer(data, np.uint8), ends)
        piece = np.searchsorted(ends, first, side="right")
        shift = offsets[piece] - np.concatenate(([0], ends[:-1]))[piece]
        yield _rows(k1, k23, ids[piece], packed(first + shift, last + shift, anchor + shift), seen)


def _part_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unsettled runs in four parts: a part's bucket is what all windows of the part's offsets
    share, which is the anchor and more bytes on both sides."""
    width = LENGTH - GRAM + 1
    edges = [width * i // 4 for i in range(5)]
    seen = _Seen()
    for batch in pieces(batches):
        cores, contexts, offsets, rows = [], [], [], []
        for doc, text, unsettled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for run in unsettled:
                first, last, anchor = run >> 14, (run >> 14) + (run >> 7 & 127), (run >> 14) + (run & 127)
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    a, b = max(first, anchor - high + 1), min(last, anchor - low)
                    if a <= b:
                        cores.append(text[anchor - low : anchor - high + 1 + LENGTH])
                        contexts.append(text[a : b + LENGTH])
                        offsets.append((low, anchor - a))
                        rows.append((doc, a << 14 | b - a << 7 | anchor - a))
        low, offset = np.array(offsets, np.uint64).reshape(-1, 2).T
        doc, run = np.array(rows, np.int64).reshape(-1, 2).T
        yield _rows(_digests(cores)[:, 0] ^ _mixed(low), _digests(contexts) ^ _mixed(offset)[:, None], doc, run, seen)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unsettled runs as single windows, of each class in a chunk the first one only."""
    def flush(held: list[tuple[int, bytes, np.ndarray]]) -> pa.RecordBatch:
        held.sort(key=lambda d: d[0])
        data = b"".join(t for _, t, _ in held)
        begins = np.cumsum([0, *(len(t) for _, t, _ in held[:-1])])
        starts = np.concatenate([s + o for (_, _, s), o in zip(held, begins, strict=True)])
        docs = np.repeat(np.array([d for d, _, _ in held], np.int64), [len(s) for _, _, s in held])
        local = np.concatenate([s for _, _, s in held])
        bucket = refined(np.frombuffer(data, np.uint8), starts)
        _, first = np.unique(bucket, return_index=True)
        again = np.ones(len(starts), bool)
        again[first] = False
        keys = _digests(data[s : s + LENGTH] for s in starts[first].tolist())
        k1 = _mixed(docs.view(np.uint64) ^ _mixed(local.view(np.uint64)))
        k2 = np.zeros(len(starts), np.uint64)
        k1[first], k2[first] = keys[:, 0], keys[:, 1]
        run = packed(local, local, local)
        # covered windows that follow each other go on as one run of up to 128
        joins = np.concatenate(([False], again[1:] & again[:-1] & (docs[1:] == docs[:-1]) & (local[1:] == local[:-1] + 1)))
        head = np.flatnonzero(~joins)
        size = np.diff(np.append(head, len(starts)))
        more = [(h + k, min(128, n - k)) for h, n in zip(head.tolist(), size.tolist(), strict=True) for k in range(0, n, 128)]
        at, n = np.array([m[0] for m in more], np.int64), np.array([m[1] for m in more], np.int64)
        run = packed(local[at], local[at] + n - 1, local[at])
        return _batch(k1[at], k2[at], np.zeros(len(at), np.uint64), docs[at], np.where(again[at], ~run, run))

    held, size = [], 0
    for batch in pieces(batches):
        for doc, text, unsettled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            starts = np.unique(np.concatenate([np.arange(r >> 14, (r >> 14) + (r >> 7 & 127) + 1) for r in unsettled]))
            held.append((doc, text, starts))
            size += len(text) + 8 * len(starts)
            if size > CHUNK:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def refined(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket of each position of ``starts`` such that two share one if and only if their
    ``LENGTH`` bytes are equal. Buckets of 8 bytes are refined by sorting on the pair of bucket
    identifiers of a position and of a later one, over just the positions that the next depth
    asks for."""
    steps, depth = [], 8
    while 2 * depth <= LENGTH:
        steps.append((depth, depth))
        depth *= 2
    if depth < LENGTH:
        steps.append((depth, LENGTH - depth))
    needed = [starts]
    for _, offset in reversed(steps):
        needed.insert(0, np.union1d(needed[0], needed[0] + offset))
    grams = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), 0, (1,))
    _, bucket = np.unique(grams[needed[0]].astype(np.uint64), return_inverse=True)
    for (_, offset), held, wanted in zip(steps, needed[:-1], needed[1:], strict=True):
        here, there = bucket[np.searchsorted(held, wanted)], bucket[np.searchsorted(held, wanted + offset)]
        _, bucket = np.unique(here.astype(np.uint64) * np.uint64(len(held) + 1) + there.astype(np.uint64), return_inverse=True)
    return bucket


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, context, document and run -> covered runs, and the first runs of
    the contexts of buckets that have several. Holds one row, and the last batch."""
    before: tuple[int, int, int] | None = None
    waiting: tuple[int, int] | None = None  # first run of a bucket that has had one context
    several = False

    def out(covered: int, doc: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), covered, np.int32)), pa.array(doc), pa.array(run)], names=["covered", "doc", "run"])

    for batch in batches:
        k1, k2, k3, doc, run = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        known = run < 0
        if known.any():
            yield out(1, doc[known], ~run[known])
            k1, k2, k3, doc, run = (x[~known] for x in (k1, k2, k3, doc, run))
        if not len(k1):
            continue
        same = np.concatenate(([before is not None and k1[0] == before[0]], k1[1:] == k1[:-1]))
        equal = same & np.concatenate(([before is not None and (k2[0], k3[0]) == before[1:]], (k2[1:] == k2[:-1]) & (k3[1:] == k3[:-1])))
        bucket = np.cumsum(~same) - (0 if same[0] else 1)
        mixed = np.bincount(bucket, weights=same & ~equal) > 0
        if same[0]:
            if mixed[0] and waiting is not None:
                yield out(0, np.array(waiting[:1], np.int64), np.array(waiting[1:], np.int64))
                waiting = None
            mixed[0] |= several
        yield out(1, doc[equal], run[equal])
        go_on = ~equal & mixed[bucket]
        yield out(0, doc[go_on], run[go_on])
        several = bool(mixed[-1])
        if several:
            waiting = None
        elif bucket[-1] > 0 or not same[0]:
            at = int(np.searchsorted(bucket, bucket[-1]))
            waiting = (int(doc[at]), int(run[at]))
        before = (k1[-1], k2[-1], k3[-1])


def _settled(rows: DataFrame, name: str) -> DataFrame:
    dealt = rows.repartition("k1").sortWithinPartitions("k1", "k2", "k3", "doc", "run")
    return staged(dealt.mapInArrow(_settle, "covered int, doc bigint, run bigint"), name)


def covered_runs(docs: DataFrame) -> list[DataFrame]:
    """``docs`` has ``doc`` (distinct, not null) and ``text`` (binary). Staged tables whose rows
    with ``covered = 1`` are runs of windows that occur earlier."""

    def of(level: DataFrame, step, name: str) -> DataFrame:
        # the frames of the level before are gone, so its shuffle files can go before this one's come
        release(docs.sparkSession)
        todo = level.where("covered = 0").groupBy("doc").agg(F.collect_list("run").alias("runs"))
        return _settled(docs.join(todo, "doc").select("doc", "text", "runs").mapInArrow(step, _ROWS), name)

    whole = _settled(docs.select("doc", "text").mapInArrow(_all_runs, _ROWS), "runs")
    parts = of(whole, _part_runs, "parts")
    windows = of(parts, _windows, "windows")
    return [whole, parts, windows]


def _cut(text: bytes, covered: list[int] | None) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and number of maximal removed spans."""
    if not covered:
        return text, 0, 0
    at = np.array(covered, np.int64)
    begin = at >> 14
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], (begin + (at >> 7 & 127) + LENGTH)[order]
    end = np.maximum.accumulate(end)
    fresh = np.concatenate(([True], begin[1:] > end[:-1]))
    begin, end = begin[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]
    left, last = [], 0
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        left.append(text[last:b])
        last = e
    left.append(text[last:])
    return b"".join(left), int((end - begin).sum()), len(begin)


def dedup_spans(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, kept_text: bool = False) -> DataFrame:
    """``df`` (its columns ``keep``; all without it) with ``RESULT``; with ``kept_text``, its text
    column has what is left, without bytes that no longer form a character."""
    keep = [c for c in keep or df.columns if c not in RESULT]
    df, key = keyed(df, doc_id, text)
    at, runs_of = unused(df, "_at", "_runs")
    docs = df.select(F.col(key).alias("doc"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    with scratch() as stays:
        found = covered_runs(docs)
        spans = found[0].where("covered = 1")
        for level in found[1:]:
            spans = spans.union(level.where("covered = 1"))
        spans = stays(staged(spans.groupBy("doc").agg(F.collect_list("run").alias(runs_of)).withColumnRenamed("doc", at), "spans"))
    release(df.sparkSession)
    joined = df.select(key, *dict.fromkeys([*keep, text])).join(spans, F.col(key) == F.col(at), "left").select(*dict.fromkeys([*keep, text]), runs_of)
    schema = extend(df.select(*keep).schema, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = col[text].cast(pa.binary()).to_pylist()
            cuts = [_cut(t or b"", r) for t, r in zip(texts, col[runs_of].to_pylist(), strict=True)]
            made = {
                "n_bytes": pa.array([len(t or b"") for t in texts], pa.int64()),
                "n_removed": pa.array([n for _, n, _ in cuts], pa.int64()),
                "n_spans": pa.array([n for _, _, n in cuts], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in cuts]),
            }
            if kept_text:
                made[text] = pa.array([None if t is None else k.decode("utf-8", "ignore") for t, (k, _, _) in zip(texts, cuts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([made.get(n, col.get(n)) for n in schema.names], names=schema.names)

    return joined.mapInArrow(run, schema)
