"""Sharding by minimax contiguous partition.

Rows with equal texts form an atomic group. Groups stand in the order of their key, a 60-bit hash
of the text, and a shard is a contiguous run of that order, so the shard of a row follows from
its key and ``shards - 1`` cut points without a join. The cuts are those of the smallest feasible
capacity: the least C such that filling shards greedily, none above C bytes, uses all groups.

C is found by binary search. The search needs running sums of group sizes only where a greedy
cut can fall, so keys are summed into a fixed number of cells; a search with cells taken whole
gives a feasible capacity and one with cells taken as divisible a lower bound, and cells in which
a cut of any capacity between the two can lie are split further until each holds one group. The
driver holds some ten thousand sums at a time, however many rows there are. Where one group
outweighs a shard's share, that capacity leaves room, and cuts within it are made as even as fits.

Slots are numbered without one task per shard: rows are counted by (shard, cell, salt), with the
salt from doc_id so that a group of copies spreads, and numbered within those.

Defined cases: a null text has size 1 and its own group; an empty table gives no rows; repeated
rows are numbered each; a null doc_id is allowed; input columns named like a result column are
replaced. The law is ``bytes``, so ``grown_shard`` is null.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import staged

KEY_BITS = 60
#: cells of the first look and of each finer one (powers of two)
FIRST_BITS, FINER_BITS = 14, 16
#: cells and salts for numbering slots; their product bounds what the driver holds
SLOT_CELLS, SLOT_SALTS = 1024, 32
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def group_key(text: Column) -> Column:
    """A 60-bit hash of the text, in the order of which groups are dealt to shards."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint"), F.lit(0))


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where shards end (indices, exclusive) if each takes as many whole items as fit; None if
    more shards would be needed."""
    sums, ends, at = [0, *accumulate(sizes)], [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        ends.append(at)
        if at == len(sizes):
            return ends + [at] * (shards - len(ends))
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which ``greedy`` needs no more than ``shards``."""
    low = max([max(sizes, default=0), -(-sum(sizes) // shards)])
    high = max(low, sum(sizes))
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """The last key of each shard but the last one. ``groups`` has ``key`` and ``size`` rows."""
    # cells: (first key, width in bits, bytes, holds one key), in key order
    cells = _sums(groups, [(0, KEY_BITS)], FIRST_BITS)
    while True:
        sizes = [c[2] for c in cells]
        upper = smallest_capacity(sizes, shards)
        lower = max([-(-sum(sizes) // shards), *(c[2] for c in cells if c[3])])
        split = [] if lower >= upper else [c for c in _touched(cells, lower, upper, shards) if not c[3]]
        if not split:
            ends = even_ends(sizes, upper, shards)
            return [cells[e - 1][0] + (1 << cells[e - 1][1]) - 1 if e else -1 for e in ends[:-1]]
        gone = {c[0] for c in split}
        cells = sorted([c for c in cells if c[0] not in gone] + _sums(groups, [c[:2] for c in split], FINER_BITS))


def _touched(cells: list[tuple], lower: int, upper: int, shards: int) -> list[tuple]:
    """Cells in which the end of a greedy shard can lie for some capacity from ``lower`` to
    ``upper``: not before that of whole cells at ``lower``, not after that of bytes at ``upper``."""
    sums, out, at = [0, *accumulate(c[2] for c in cells)], {}, 0
    for i in range(1, shards):
        at = bisect_right(sums, sums[at] + lower) - 1
        for c in cells[at : bisect_right(sums, i * upper)]:
            out[c[0]] = c
    return list(out.values())


def even_ends(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of shards within ``capacity`` that are as even as can be: each shard ends nearest to
    its share of what is left, if the rest still fits, and else where the greedy one does."""
    sums, ends, at = [0, *accumulate(sizes)], [], 0
    for left in range(shards, 1, -1):
        share = sums[at] + (sums[-1] - sums[at]) / left
        full = bisect_right(sums, sums[at] + capacity) - 1
        high = min(bisect_right(sums, share), full)
        near = min((max(at, high - 1), high), key=lambda e: abs(sums[e] - share))
        at = next((e for e in (near, high) if greedy(sizes[e:], capacity, left - 1) is not None), full)
        ends.append(at)
    return [*ends, len(sizes)]


def _sums(groups: DataFrame, ranges: list[tuple[int, int]], total_bits: int) -> list[tuple]:
    """Each range of keys (first, width in bits) in cells that hold rows, about 2**total_bits in
    all whatever the number of ranges."""
    by_bits: dict[int, list[int]] = {}
    for start, bits in ranges:
        by_bits.setdefault(bits, []).append(start)
    out = []
    for bits, starts in by_bits.items():
        step = max(0, bits - max(1, total_bits - (len(starts) - 1).bit_length()))
        held = groups if bits == KEY_BITS else groups.where(F.shiftright("key", bits).isin([s >> bits for s in starts]))
        cell = F.shiftleft(F.shiftright("key", step), step)
        rows = held.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        out += [(r.cell, step, r["size"], r.a == r.b) for r in rows]
    return sorted(out)


def shard_documents(df: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` but for its text, with the columns ``RESULT``; shard sizes differ by as little as atomic
    groups allow."""
    keep = [c for c in df.columns if c not in RESULT and c != text]
    spark, size = df.sparkSession, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    # the texts are read once; all that follows works on keys and sizes
    kept = F.struct(*keep) if keep else F.lit(None).cast("string")
    base = staged(df.select(kept.alias("kept"), F.col(doc_id).alias("id"), group_key(F.col(text)).alias("key"), size.alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("text_crc32"), F.pmod(F.xxhash64(doc_id), F.lit(SLOT_SALTS)).cast("int").alias("salt")), "sharding")
    cuts = cut_keys(base.select("key", "size"), shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") > F.lit(c)).cast("int")
    base = base.withColumn("shard", shard.cast("int")).withColumn("cell", F.shiftright("key", KEY_BITS - SLOT_CELLS.bit_length() + 1).cast("int"))
    cell = ["shard", "cell", "salt"]
    # at most (SLOT_CELLS + shards) * SLOT_SALTS rows, so this broadcast has a fixed bound
    counts = base.groupBy(*cell).count().collect()
    starts, seen = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["cell"], r["salt"])):
        starts.append((r["shard"], r["cell"], r["salt"], seen.get(r["shard"], 0)))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["count"]
    first = spark.createDataFrame(starts, "shard int, cell int, salt int, first bigint")
    row = F.row_number().over(Window.partitionBy(*cell).orderBy("key", F.col("id").asc_nulls_last()))
    numbered = base.withColumn("row", row).join(F.broadcast(first), cell)
    return numbered.select(
        *[F.col("kept").getField(c).alias(c) for c in keep],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("row") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
