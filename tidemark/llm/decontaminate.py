"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. An
item's windows are its runs of ``window`` consecutive words (the whole item if it is shorter).

1. The shingles of all windows (``SHINGLE`` words; the whole window if it is shorter) are counted
   over all documents, which orders them by rarity.
2. Exact containment needs every shingle of a window, so the necessary prefix of a window in that
   order is its one rarest shingle. The index has it with its offset in the window.
3. Documents' shingles are joined to the index on their hash. What no prefix can be equal to is left
   out before, by a filter of a fixed number of bits, and what is sent carries the words around it.
4. The offset and the document's length bound where the window can lie, and all its words are
   compared there.

Both sides are tables: the benchmark may be of any size, and nothing of it but the filter is held by
the driver or by a task. The number of passes over the documents does not depend on it. Hits are
joined back to the documents that have some; the others are never shuffled.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no
windows; an item without item_id marks hits but is not listed; equal item_ids are one item;
repeated documents are each judged; an empty benchmark contaminates nothing; a doc_id that is no
integer raises TypeError; input columns named like a result column are replaced, and names of inner
columns do not meet those of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngrams import Words, rolled
from tidemark.llm.staging import bits_of, extend, keyed, pieces, scratch, split, staged, unused

WINDOW, SHINGLE = 10, 3
#: every byte that cannot be part of a word becomes a space, A-Z become a-z
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean", "items": "array<string>"}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows_of(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def _item_windows(window: int):
    """Items -> their windows: the words, how many, and the hashes of their shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for w in windows_of(words_of(text), window):
                    width = min(SHINGLE, len(w))
                    rows.append((item, b" ".join(w).decode("utf-8", "replace"), len(w), width, rolled(Words([b" ".join(w)], _TABLE).hashes, width).view(np.int64)))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["item", "words", "size", "width", "shingles"])

    return run


def _counts(bits: np.ndarray, widths: list[int]):
    """Texts -> how often each shingle that the filter lets through occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, found = Words([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()], _TABLE), [np.empty(0, np.int64)]
            for width in widths:
                h, _ = words.rolled(width)
                found.append(h[_passing(h, bits)].view(np.int64))
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def _probes(bits: np.ndarray, widths: list[int], window: int):
    """Documents -> the shingles that the filter lets through: where they are, and the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, rows = Words([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], _TABLE), []
            data, starts, ends, bounds, docs = words.data, words.starts, words.ends, words.bounds, batch.column(0).to_pylist()
            for width in widths:
                hashes, first = words.rolled(width)
                for k in _passing(hashes, bits).tolist():
                    at = int(first[k])
                    t = int(np.searchsorted(bounds, at, side="right")) - 1
                    low, high = max(int(bounds[t]), at - window + width), min(int(bounds[t + 1]), at + window)
                    around = b" ".join([data[a:b] for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)])
                    rows.append((docs[t], at - int(bounds[t]), low - int(bounds[t]), int(hashes[k].view(np.int64)), around.decode("utf-8", "replace")))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc", "at", "low", "h", "around"])

    return run


def found_windows(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``docs`` has ``doc`` and ``text``. One row for each document with hits: ``doc``, ``spans`` (first
    word and number of words of each window that occurs) and ``items``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    owned = staged(items.mapInArrow(_item_windows(window), "item string, words string, size int, width int, shingles array<bigint>"), "windows")
    windows = owned.dropDuplicates(["words"]).select("words", "size", "width", "shingles")
    widths = sorted(r.width for r in windows.select("width").distinct().collect())
    shingles = windows.select("words", "size", F.posexplode("shingles").alias("offset", "h"))
    counts = docs.select("text").mapInArrow(_counts(bits_of(shingles, "h"), widths), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    ranked = shingles.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    index = ranked.groupBy("words", "size").agg(F.min(F.struct("n", "h", "offset")).alias("least"))
    index = staged(index.select("words", "size", F.col("least.h").alias("h"), F.col("least.offset").alias("offset")), "index", narrow=True)
    probes = docs.select("doc", "text").mapInArrow(_probes(bits_of(index, "h"), widths, window), "doc bigint, at int, low int, h bigint, around string")
    begin = F.col("at") - F.col("offset")
    here = F.array_join(F.slice(F.split("around", " "), begin - F.col("low") + 1, F.col("size")), " ")
    met = probes.join(index, "h").where((begin >= F.col("low")) & (begin >= 0)).where(here == F.col("words"))
    met = staged(met.select("doc", begin.alias("begin"), "size", "words").distinct(), "met", narrow=True)
    named = met.select("doc", "words").distinct().join(owned.where("item is not null").select("words", "item").distinct(), "words")
    spans = met.groupBy("doc").agg(F.collect_set(F.struct("begin", "size")).alias("spans"))
    return spans.join(named.groupBy("doc").agg(F.collect_set("item").alias("items")), "doc", "left")


def _covered(spans: list[dict] | None) -> int:
    """Number of words in any of the spans."""
    total = last = 0
    for begin, end in sorted((s["begin"], s["begin"] + s["size"]) for s in spans or ()):
        total += max(0, end - max(begin, last))
        last = max(last, end)
    return total


def mark_windows(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """``documents`` (its columns ``keep``; all without it) with ``RESULT``; ``items`` are the
    sorted ids of the items that occur."""
    keep = [c for c in keep or documents.columns if c not in RESULT]
    docs, key = keyed(documents, doc_id, "text")
    spans, items = unused(docs, "_spans", "_items")
    with scratch() as stays:
        found = stays(staged(found_windows(docs.select(F.col(key).alias("doc"), "text"), benchmark, window).select(F.col("doc").alias(key), F.col("spans").alias(spans), F.col("items").alias(items)), "hits", narrow=True))
    some, others = split(docs, found, key)
    held = list(dict.fromkeys([*keep, "text"]))
    rows = some.join(found, key, "left").select(*held, spans, items)
    rows = rows.unionByName(others.select(*held), allowMissingColumns=True)
    schema = extend(documents.select(*keep).schema, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n_hit = [_covered(s) for s in col[spans].to_pylist()]
            named = [sorted(i or ()) for i in col[items].to_pylist()]
            made = {
                "n_words": pa.array([len(words_of(t)) for t in col["text"].cast(pa.binary()).to_pylist()], pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(i) for i in named], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in named]),
                "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
                "items": pa.array(named, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([made.get(n, col.get(n)) for n in schema.names], names=schema.names)

    return rows.mapInArrow(run, schema)
