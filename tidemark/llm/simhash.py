"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint is 8 bytes at 8 positions. Fingerprints that differ in at most ``bits`` bits (0 to
6) share at least ``8 - bits`` positional bytes, so a pair qualifies only if its tally of shared
positional bytes reaches that, and is then verified by its bit difference.

Posting lists of single positional bytes would hold 1/256 of all fingerprints each, and tallying
over them visits a constant share of all pairs. The index is therefore keyed by sets of positional
bytes: a family of position sets (``position_sets``) of which any two qualifying fingerprints share
one, so that every qualifying pair meets in a posting list; the tally is then taken over all 8
positions. Lists are counted first. One longer than ``LOCAL_LIST`` is refined: its pairs share a
further position, so its members are posted again under the set and each other position. A list
that is still longer when its set has all the positions that a pair must share is tied together by
values: two fingerprints differ in at most ``bits`` bits if and only if some value differs from one
in at most the lower half of ``bits`` and from the other in at most the upper half, so each is sent
to its values and tied to the least document near there - linear in the list, and exact. No list is
ever streamed through one task but in pieces of ``LOCAL_LIST``, and no case is left out at any size.

``similar_groups`` is for groups by similarity: texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more are in one component. It is exact and has four steps.

1. Texts with equal sets are one class. SimHash links (as above) of classes are verified on the
   sets themselves; they tie most of what is close.
2. In one order of all shingles, those rare in the corpus first, two sets that are similar share one
   of their first ``n - ceil(0.8 n) + 1``. Pairs that do and lie in different components so far are
   candidates, unless positions, sizes or parities of the sets rule them out for certain. Only rows
   outside a list's largest component look for partners, so a large component costs nothing.
3. A large group of near copies is many components at first, of which all pairs would be candidates.
   So long lists are dealt into cells of about ``DEALT`` rows by a hash, anew in each round, and only
   candidates of one cell are verified, a number in proportion to the list; what they tie is one
   component from then on. Rounds go on while each at least halves the rows of long lists that are
   outside the largest component. They leave nothing out: the next step looks at whole lists.
4. Of all candidates that lie apart then, one of each two components is verified, then all that still
   lie apart. Sets close to each other but below the similarity stay apart in all rounds, and all
   pairs of those that the bounds allow are candidates here.

The order comes from how many documents hold a shingle, counted over all of them in ``CELLS`` cells
by hash; any order is exact, and this one keeps lists short.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any
other; a row without doc_id is fingerprinted and shares the component of its fingerprint's other
rows (null if there are none); repeated rows stay; an empty table gives no rows; input columns
named like a result column are replaced; a doc_id that is no integer raises TypeError, and ``bits``
beyond 6 a ValueError. ``similar_groups`` needs a doc_id that names each row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.ngrams import WHITE, Words, rolled
from tidemark.llm.staging import discard, extend, integer, only, pieces, release, scratch, staged

SEED, BITS, SHINGLE = 42, 4, 4
POSITIONS = 8
#: posting lists up to this length are compared where they are read
LOCAL_LIST = 4096
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: places, a multiple of 64, whose parities bound how much two sets differ: in lists, and of pairs
PARITIES, MARKS = 512, 4096
#: rows of a cell, on average, of long lists while parts are merged
DEALT = 8
#: cells by hash in which documents that hold a shingle are counted
CELLS = 1 << 18
_BLOCK, _SHORT = 512, 32
_SET_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles (ASCII white space, A-Z lower-cased)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate(([0], ends[:-shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are 1 where over half of the hashes have a 1."""
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, POSITIONS)
    out = 0
    for k in range(POSITIONS):
        ones = np.bincount(columns[:, k], minlength=256) @ _SET_BITS
        out |= int(((ones * 2 > len(hashes)) << np.arange(8)).sum()) << (8 * k)
    return out


def position_sets(bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``8 - bits`` of the 8 contain one."""
    halves, twos = (range(4), range(4, 8)), ((0, 1), (2, 3), (4, 5), (6, 7))
    if bits == 0:
        return [tuple(range(POSITIONS))]
    if bits == 1:  # of 7 positions four are a half
        return [tuple(h) for h in halves]
    if bits == 2:  # of 6 positions two twos are whole
        return [a + b for a, b in combinations(twos, 2)]
    if bits == 3:  # of 5 positions three lie in one half
        return [t for h in halves for t in combinations(h, 3)]
    if bits == 4:  # of 4 positions in three groups, three lie in one, or two in one and one in the next
        out, group = [], (0, 0, 0, 1, 1, 1, 2, 2)
        for t in combinations(range(POSITIONS), 3):
            held = sorted((group[p] for p in t), key=[group[p] for p in t].count)
            if held[0] == held[2] or held[1] == held[2] and held[0] == (held[2] + 1) % 3:
                out.append(t)
        return out
    if bits == 5:  # of 3 positions two lie in one half
        return [t for h in halves for t in combinations(h, 2)]
    if bits == 6:
        return list(combinations(range(POSITIONS), 2))
    raise ValueError("bits must be 0 to 6")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bytes_at(fp: Column, positions: tuple[int, ...]) -> Column:
    return fp.bitwiseAND(F.lit(_signed(sum(0xFF << 8 * p for p in positions))).cast("bigint"))


def _posted(classes: DataFrame, bits: int) -> DataFrame:
    """``rep, _fp`` once for each position set, with the set and the bytes there."""
    keys = [F.struct(F.lit(sum(1 << p for p in s)).alias("set"), _bytes_at(F.col("_fp"), s).alias("head")) for s in position_sets(bits)]
    return classes.select("rep", "_fp", F.explode(F.array(*keys)).alias("k")).select("k.set", "k.head", "rep", "_fp")


def _refined(lists: DataFrame) -> DataFrame:
    """Members of lists again, under each set that has one position more."""
    keys = [F.when(F.col("set").bitwiseAND(F.lit(1 << p)) == 0, F.struct(F.col("set").bitwiseOR(F.lit(1 << p)).alias("set"), F.col("head").bitwiseOR(_bytes_at(F.col("_fp"), (p,))).alias("head"))) for p in range(POSITIONS)]
    rows = lists.select("rep", "_fp", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k"))
    return rows.select("k.set", "k.head", "rep", "_fp").distinct()


def with_fingerprints(df: DataFrame, of: Callable, kind: str) -> DataFrame:
    """``doc_id, _fp`` for rows of doc_id and text; ``of`` gives a fingerprint of type ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = [of(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "_fp"])

    return df.mapInArrow(run, extend(df.select("doc_id").schema, {"_fp": kind}))


def forest(fps: np.ndarray, least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``fps`` has a row of bytes for each fingerprint. Pairs that tie together, without cycles,
    all that is linked: by tally of shared positional bytes, then by bits."""
    n = len(fps)
    root, out = list(range(n)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    words = np.ascontiguousarray(fps).view(np.uint64)
    for b in range(0, n, _BLOCK):
        for a in range(0, b + 1, _BLOCK):
            if n <= _SHORT:
                tally = (fps[:, None] == fps[None]).sum(2, dtype=np.int8)
            else:
                tally = np.zeros((min(_BLOCK, n - a), min(_BLOCK, n - b)), np.int8)
                for k in range(fps.shape[1]):
                    tally += fps[a : a + _BLOCK, k, None] == fps[None, b : b + _BLOCK, k]
            left, right = np.nonzero(tally >= least)
            left, right = left[m := left + a < right + b] + a, right[m] + b
            close = np.bitwise_count(words[left] ^ words[right]).sum(1, dtype=np.int64) <= bits
            for i, j in zip(left[close].tolist(), right[close].tolist(), strict=True):
                if (x := find(i)) != (y := find(j)):
                    root[max(x, y)] = min(x, y)
                    out.append((j, i))
    j, i = zip(*out, strict=True) if out else ((), ())
    return np.array(j, np.int64), np.array(i, np.int64)


def _compared(bits: int):
    """Rows set, head, rep, fingerprint in the order of the first two -> links ``a, b``. Holds one
    list, and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), np.int64)

        def tied(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = rows[np.argsort(rows[:, 2])]
            j, i = forest(np.ascontiguousarray(rows[:, 3:]).view(np.uint8), POSITIONS - bits, bits)
            return rows[j, 2], rows[i, 2]

        def out(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)])
            starts = np.flatnonzero(np.concatenate(([True], (held[1:, :2] != held[:-1, :2]).any(1)))) if len(held) else []
            if found := [tied(held[s:e]) for s, e in zip(starts[:-1], starts[1:], strict=True) if e - s > 1]:
                yield out(found)
            held = held[starts[-1] :] if len(held) else held
        if len(held) > 1:
            yield out([tied(held)])

    return run


def _values(bits: int):
    """Members of long lists -> the values that differ from each in at most half of ``bits``, the
    upper half, at positions outside the list's set; ``inner`` where it is the lower half."""
    low, high = bits // 2, -(-bits // 2)

    def masks(held: int) -> tuple[np.ndarray, np.ndarray]:
        places = [8 * p + k for p in range(POSITIONS) if not held >> p & 1 for k in range(8)]
        picked = [c for n in range(high + 1) for c in combinations(places, n)]
        return np.array([sum(1 << i for i in c) for c in picked], np.uint64).view(np.int64), np.array([len(c) <= low for c in picked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for held, head, rep, fp in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True):
                mask, inner = known[held] if held in known else known.setdefault(held, masks(held))
                same = [pa.array(np.full(len(mask), x, t)) for x, t in ((held, np.int32), (head, np.int64), (rep, np.int64))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(fp ^ mask), pa.array(inner)], names=["set", "head", "rep", "value", "inner"])

    return run


def links(classes: DataFrame, bits: int = BITS, local: int = LOCAL_LIST) -> DataFrame:
    """``classes`` has one row per distinct fingerprint, ``_fp`` and its least document ``rep``.
    Gives pairs ``a, b`` of such documents, all within ``bits``, that tie together all that is."""
    with scratch() as keep:
        return keep(staged(_links(classes, bits, local).distinct(), "links", narrow=True))


def _links(classes: DataFrame, bits: int, local: int) -> DataFrame:
    posted, size = _posted(classes, bits), len(position_sets(bits)[0])
    found = None
    while True:
        several = posted.groupBy("set", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        lists = staged(posted.join(several, ["set", "head"]), "postings")
        dealt = lists.where(F.col("n") <= local).select("set", "head", "rep", "_fp").repartition("set", "head").sortWithinPartitions("set", "head")
        near = dealt.mapInArrow(_compared(bits), "a bigint, b bigint")
        found = near if found is None else found.union(near)
        hot = lists.where(F.col("n") > local).select("set", "head", "rep", "_fp")
        if hot.isEmpty():
            return found
        if size < POSITIONS - bits:
            posted, size = _refined(hot), size + 1
            continue
        sent = hot.mapInArrow(_values(bits), "set int, head bigint, rep bigint, value bigint, inner boolean")
        least = sent.where("inner").groupBy("set", "head", "value").agg(F.min("rep").alias("b"))
        tied = sent.join(least, ["set", "head", "value"]).select(F.col("rep").alias("a"), "b").where("a <> b")
        return found.union(tied)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS, shingle: int = SHINGLE, local: int = LOCAL_LIST) -> DataFrame:
    """One row ``doc_id, fingerprint, component_id`` for each row of ``df``."""
    plain = df.select(integer(df, doc_id).alias("doc_id"), F.col(text).alias("text"))
    with scratch() as keep:
        prints = staged(with_fingerprints(plain, lambda t: _signed(fingerprint(t, shingle)), "bigint"), "fingerprints")
        classes = prints.groupBy("_fp").agg(F.min("doc_id").alias("rep"))
        parts = connected_components(links(classes.where("rep is not null"), bits, local))
        named = classes.join(parts, F.col("rep") == F.col("node"), "left").select("_fp", F.coalesce("component", "rep").alias("component_id"))
        out = prints.join(named, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
        return keep(staged(out, "near-duplicates", narrow=True))


# -- groups by similarity of shingle sets ------------------------------------------------------------


def shingle_sets(texts: Iterator[bytes | None], shingle: int = SIMILAR_SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's set of word shingles (fewer words: the whole sequence;
    none: none)."""
    words = Words([t or b"" for t in texts], WHITE)
    whole, out = rolled(words.hashes, shingle), []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        h = whole[a : b - shingle + 1] if b - a >= shingle else rolled(words.hashes[a:b], max(1, b - a))
        out.append(np.unique(h.view(np.int64)))
    return out


def shingle_counts(plain: DataFrame, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """How many documents hold a shingle of each cell, over all documents: ``CELLS`` logarithms, six
    to a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, np.int64)
        for batch in pieces(batches):
            sets = shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), shingle)
            held += np.bincount(np.concatenate(sets) & (CELLS - 1), minlength=CELLS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["at", "n"])

    found = plain.select("text").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[found.column("at").to_numpy()] = np.minimum(255, 6 * np.log2(found.column("n").to_numpy() + 1.0)).astype(np.uint8)
    return out


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set, in an order of all shingles (by their cell's count, then by hash), such
    that sets of at least this similarity have one of them in common."""
    order = np.lexsort((hashes, counts[hashes & (len(counts) - 1)]))
    return hashes[order[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1]]


def _parities(hashes: np.ndarray, places: int) -> np.ndarray:
    return np.packbits(np.bincount((hashes >> 20) & (places - 1), minlength=places) & 1).view(np.int64)


def _sets(counts: np.ndarray, similarity: float, shingle: int):
    """For each text its SimHash and a digest of its set of shingles, the set's size, the parities
    of how many of the set fall on each of ``PARITIES`` places, and the set's prefix."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for h in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), shingle):
                rows.append((_signed(majority(h.view(np.uint64))) if len(h) else 0, xxhash.xxh3_128_digest(h.tobytes()), len(h), _parities(h, PARITIES), prefix(h, counts, similarity)))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int32(), longs, longs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "_fp", "digest", "n", "bits", "prefix"])

    return run


def similar_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, local: int = LOCAL_LIST) -> DataFrame:
    """One row ``doc_id, component_id`` for each row of ``df``: texts whose sets of shingles have
    at least this similarity are in one component, named by its least doc_id."""
    with scratch() as keep:
        return keep(staged(_groups(df, text, doc_id, similarity, shingle, local), "groups", narrow=True))


def _groups(df: DataFrame, text: str, doc_id: str, similarity: float, shingle: int, local: int) -> DataFrame:
    spark = df.sparkSession
    plain = df.select(integer(df, doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = "doc_id bigint, _fp bigint, digest binary, n int, bits array<bigint>, prefix array<bigint>"
    prints = staged(plain.mapInArrow(_sets(shingle_counts(plain, shingle), similarity, shingle), made), "fingerprints")
    classes = prints.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = staged(prints.join(classes.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("rep"), "_fp", "n", "bits", "prefix"), "members")
    # SimHash links, and classes of one fingerprint
    fps = members.groupBy("_fp").agg(F.min("rep").alias("rep"))
    equal = members.select("_fp", F.col("rep").alias("a")).join(fps.withColumnRenamed("rep", "b"), "_fp").where("a <> b").select("a", "b")
    close = verified(plain, links(fps, local=local).union(equal), similarity, shingle)
    release(spark)
    part = connected_components(close)
    parted = members.join(part, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("part"), "n", "bits", "prefix")
    lists = staged(_mixed(parted), "mixed")
    discard(members)
    release(spark)
    found, tied = _merged(plain, lists, similarity, shingle)
    if found is not None:
        close, lists = close.union(found), _renamed(lists, connected_components(tied))
        release(spark)
    pairs = apart(lists.join(_sizes(lists).select("key", "most"), "key"), similarity)
    release(spark)
    # one pair of each two components first; what then still lies apart is verified in full
    close = close.union(verified(plain, _firsts(pairs).select("a", "b"), similarity, shingle))
    part = connected_components(close)
    for side in "ab":
        now = part.select(F.col("node").alias(side), F.col("component").alias(f"{side}now"))
        pairs = pairs.join(now, side, "left")
    rest = pairs.where(F.coalesce("anow", "a") != F.coalesce("bnow", "b")).select("a", "b")
    part = connected_components(close.union(verified(plain, rest, similarity, shingle)))
    named = classes.join(part, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")


def _mixed(parted: DataFrame) -> DataFrame:
    """Rows ``key, rep, at, part, n, bits`` of those lists that are not of one part."""
    parts = parted.select("part", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"))
    posted = parted.select("rep", F.posexplode("prefix").alias("at", "key")).join(parts.where("x <> y").select("key"), "key")
    return posted.join(parted.select("rep", "part", "n", "bits"), "rep")


def _sizes(lists: DataFrame) -> DataFrame:
    """Of each list that is not of one part: the part that has most of it, its rows and those of
    other parts."""
    sizes = lists.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("rows"))
    return sizes.select("key", F.col("m.part").alias("most"), "rows", (F.col("rows") - F.col("m.c")).alias("others")).where("others > 0")


def _renamed(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """``lists`` with the components of parts for parts."""
    joined = lists.join(parts, F.col("part") == F.col("node"), "left")
    return joined.withColumn("part", F.coalesce("component", "part")).drop("node", "component")


def _firsts(pairs: DataFrame) -> DataFrame:
    """The pair with the fewest unlike parities of each two parts."""
    least = F.min_by(F.struct("a", "b"), F.struct("unlike", "a", "b")).alias("p")
    return pairs.groupBy("apart", "bpart").agg(least).select("apart", "bpart", "p.a", "p.b")


def _merged(plain: DataFrame, lists: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Rounds over the long ones of ``lists``. Similar pairs ``a, b``, and the parts that these tie
    together as ``a, b``; none if no list is long."""
    rows, found, tied, left, turn = lists, None, None, math.inf, 0
    while True:
        sizes = staged(_sizes(rows).where(F.col("others") > DEALT), "sizes", narrow=True)
        now = sizes.agg(F.sum("others")).first()[0] or 0
        if not now or 2 * now > left:
            return found, tied
        held = staged(rows.join(sizes.select("key", "most", "rows"), "key"), "long")
        cell = F.pmod(F.xxhash64(F.lit(turn), "key", "rep"), F.ceil(F.col("rows") / DEALT))
        first = staged(_firsts(apart(held.withColumn("cell", cell), similarity, "cell")), "firsts", narrow=True)
        similar = verified(plain, first.select("a", "b"), similarity, shingle)
        ties = staged(first.join(similar, ["a", "b"]).select(F.col("apart").alias("a"), F.col("bpart").alias("b")), "ties", narrow=True)
        found, tied = (similar, ties) if found is None else (found.union(similar), tied.union(ties))
        rows = _renamed(held.drop("most", "rows"), connected_components(ties))
        left, turn = now, turn + 1
        release(plain.sparkSession)


def apart(lists: DataFrame, similarity: float, *within: str) -> DataFrame:
    """Distinct pairs ``a, b`` that share a list, and what else ``within`` names, are of different
    ``part`` and can be that similar, with both parts and the number of unlike parities. Both tests
    are bounds, so no similar pair is lost: a set of ``n`` shares at most the ``n - at`` from the key
    on, and sets differ in at least as many members as they have unlike parities. ``lists`` has the
    part that has most of a list as ``most``: of each pair of parts, one is another."""
    with scratch() as keep:
        return keep(staged(_apart(lists, similarity, *within), "apart", narrow=True))


def _apart(lists: DataFrame, similarity: float, *within: str) -> DataFrame:
    on = ["key", *within]
    x, y = (lists.select(*on, *(F.col(c).alias(side + c) for c in ("rep", "part", "n", "at", "bits", "most"))) for side in "xy")
    need = (F.col("xn") + F.col("yn")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    room = F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat"))
    unlike = sum((F.bit_count(F.col("xbits")[i].bitwiseXOR(F.col("ybits")[i])) for i in range(PARITIES // 64)), F.lit(0))
    once = (F.col("ypart") == F.col("ymost")) | (F.col("xpart") < F.col("ypart"))
    both = x.where("xpart <> xmost").join(y, on).where(once & (room >= need))
    both = both.where(unlike <= F.col("xn") + F.col("yn") - 2 * need).withColumn("unlike", unlike)
    sides = [F.struct(F.col(f"{s}rep").alias("rep"), F.col(f"{s}part").alias("part")) for s in "xy"]
    return both.select(F.greatest(*sides).alias("u"), F.least(*sides).alias("v"), "unlike").select(F.col("u.rep").alias("a"), F.col("v.rep").alias("b"), F.col("u.part").alias("apart"), F.col("v.part").alias("bpart"), "unlike").distinct()


def verified(docs: DataFrame, pairs: DataFrame, similarity: float, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """Those of ``pairs`` whose texts' shingle sets have at least this Jaccard similarity. Only
    documents of a pair are hashed; their sets travel once per pair that ``MARKS`` parities allow."""
    with scratch() as keep:
        return keep(staged(_verified(docs, pairs, similarity, shingle), "verified", narrow=True))


def _verified(docs: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, longs), pa.array([_parities(h, MARKS) for h in sets], longs)], names=["doc_id", "grams", "marks"])

    pairs = staged(pairs, "candidates", narrow=True)
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = staged(only(docs.select("doc_id", "text"), named, "doc_id").mapInArrow(run, "doc_id bigint, grams array<bigint>, marks array<bigint>"), "shingles")
    size = sets.select("doc_id", F.size("grams").alias("n"), "marks")
    a, b = (size.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}n"), F.col("marks").alias(f"{c}marks")) for c in "ab")
    unlike = F.aggregate(F.zip_with("amarks", "bmarks", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, k: t + k)
    bound = (F.col("an") + F.col("bn")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    pairs = pairs.join(a, "a").join(b, "b").where(unlike <= bound).select("a", "b")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - F.lit(1e-9)).select("a", "b")
