"""Hashed word n-gram indicators, and the labelled sample that a classifier is fitted on."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import extend, pieces

_WORDS_KEPT = 150_000


class Hasher:
    """Token -> number, remembered up to a bound."""

    def __init__(self, pattern: str, bits: int, order: int):
        self.find, self.mask, self.order = re.compile(pattern).findall, (1 << bits) - 1, order
        self.seen: dict[str, int] = {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def _number(self, token: str) -> int:
        if len(self.seen) >= _WORDS_KEPT:
            self.seen.clear()
        out = self.seen[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Sorted distinct n-gram numbers, for n up to the order."""
        seen = self.seen
        ids = np.array([seen[t] if t in seen else self._number(t) for t in self.find((text or "").lower())], np.uint64)
        parts, grams = [ids & np.uint64(self.mask)], ids
        for n in range(1, self.order):
            if len(ids) <= n:
                break
            grams = (grams[:-1] * np.uint64(0x9E3779B1) + ids[n:]) & np.uint64((1 << 40) - 1)
            parts.append((grams ^ (grams >> np.uint64(17))) & np.uint64(self.mask))
        if len(ids) > 3:
            # an n-gram that only says a token or a pair again is an indicator of its own
            once, twice = ids[1:] == ids[:-1], ids[2:] == ids[:-2]
            shapes = (once.any(), (once[1:] & once[:-1]).any(), (twice[1:] & twice[:-1]).any())
            parts.append(np.flatnonzero(shapes).astype(np.uint64))
        return np.unique(np.concatenate(parts)).astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: an odd multiplier and its inverse modulo 2**64
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
#: bytes whose words are hashed at a time; more where one word is longer
_BLOCK = 1 << 19
_SPACE = 32
#: what words are split at where they end at ASCII white space; A-Z become a-z
WHITE = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (_BASE, _INVERSE))


class Words:
    """Words of several texts at once: of word ``i`` the hash and the place in ``data``; words of text
    ``t`` are ``bounds[t]`` to ``bounds[t + 1]``. ``table`` maps bytes, those between words to spaces."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.data = b" ".join([*texts, b""]).translate(table) if texts else b""
        parts, at = [], 0
        while at < len(self.data):
            end = at + _BLOCK
            if end < len(self.data):  # a block ends with a space: the last one, or the next
                cut = self.data.rfind(b" ", at, end)
                end = cut + 1 if cut >= at else self.data.index(b" ", end) + 1
            parts.append(self._block(at, min(end, len(self.data))))
            at = end
        self.hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, begins)

    def _block(self, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(self.data, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], data != _SPACE, [False]))))
        starts, ends = edges[::2], edges[1::2]
        size = max(_BLOCK, 1 << (len(data) - 1).bit_length())
        power, inverse = (p[: len(data) + 1] for p in _powers(size + 1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])))
        # the sum of a word's bytes, each times the power of its place in the word
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return _mixed(h + (ends - starts).astype(np.uint64) * _ODD), starts + at, ends + at

    def rolled(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``width`` words, and the first word of each; none goes over texts."""
        h = rolled(self.hashes, width)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        first = np.flatnonzero(text[: len(h)] == text[width - 1 :])
        return h[first], first


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, given the words' hashes; none if there are fewer."""
    h = np.full(max(0, len(ids) - width + 1), width, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + len(h)]) * _ODD
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: bytes of features that a classifier is fitted on, at most
SAMPLE_BYTES = 64 << 20


def labelled_sample(labels: DataFrame, label: str, fold: Column, rows: int) -> DataFrame:
    """Up to ``rows`` labelled rows by the order of a hash of doc_id; so many rows at most are
    ever broadcast, whatever the size of the label table."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & fold)
    return usable.select("doc_id", F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(rows)


def sample_features(documents: DataFrame, sample: DataFrame, extract: Callable[[str | None], bytes], rows: int, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, list[memoryview]]:
    """Labels and features of the sample's documents, in the order of doc_id, label and a digest. Documents
    may share a doc_id, so both bounds are taken again after the join, in the sample's order."""
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, text, label = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "_label"))
            yield pa.RecordBatch.from_arrays([ids, label, pa.array([extract(t.as_py()) for t in text], pa.binary())], names=["doc_id", "_label", "x"])

    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_label"), F.col("x")]
    made = texts.mapInArrow(run, extend(texts.select("doc_id", "_label").schema, {"x": "binary"})).orderBy(*order).limit(rows)
    so_far = F.sum(F.octet_length("x") + 64).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over ``rows`` rows
    # in parts, so that no result is large
    found = made.withColumn("_bytes", so_far).where(F.col("_bytes") <= most_bytes).select("doc_id", "_label", "x").repartition(16).toArrow()
    keys = list(zip(found.column("doc_id").to_pylist(), found.column("_label").to_pylist(), strict=True))
    held = [memoryview(v.as_buffer()) for chunk in found.column("x").chunks for v in chunk]  # no copies
    order = sorted(range(len(held)), key=lambda i: (*keys[i], xxhash.xxh3_128_digest(held[i])))
    return np.array([keys[i][1] for i in order], np.int64), [held[i] for i in order]


def scored(df: DataFrame, score: Callable[[str | None], float], keep: list[str], text: str = "text") -> DataFrame:
    """``df`` with ``score`` of each whole text."""
    schema = extend(df.select(*keep).schema, {"score": "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [score(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(values, pa.float64())], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn margins into probabilities (Platt's targets, Newton steps)."""
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, ab = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ ab)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * ab)
        ab += step / max(1.0, float(np.abs(step).max()) / 5)
    return float(ab[0]), float(ab[1])
