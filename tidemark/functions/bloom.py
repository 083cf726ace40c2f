"""A Bloom filter over binary keys with pinned hashes, for diagnostics of segment pruning.

Building is distributed: each task sets bits of its own keys and sends those bit positions, which
an aggregate makes distinct; the filter's size depends on the key count and rate alone.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: two bases and the prime of FNV-1a, multipliers of the murmur3 finaliser
FNV_BASES = (0xCBF29CE484222325, 0x9E3779B97F4A7C15)
FNV_PRIME = 0x100000001B3
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _fnv(keys: list[bytes], basis: int) -> np.ndarray:
    """FNV-1a of many keys at once, one column of bytes after the other."""
    sizes = np.array([len(k) for k in keys], np.int64)
    out = np.full(len(keys), basis, np.uint64)
    if not len(keys):
        return out
    table = np.frombuffer(b"".join(k.ljust(int(sizes.max()), b"\0") for k in keys), np.uint8).reshape(len(keys), -1)
    for i in range(table.shape[1]):
        on = sizes > i
        out[on] = (out[on] ^ table[on, i]) * np.uint64(FNV_PRIME)
    return out


def _finish(z: np.ndarray) -> np.ndarray:
    for m in MIX:
        z = (z ^ (z >> np.uint64(33))) * np.uint64(m)
    return z ^ (z >> np.uint64(33))


def hash_pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (_finish(_fnv(keys, basis)) for basis in FNV_BASES)
    return a, b | np.uint64(1)


@dataclass
class Bloom:
    """``for_keys`` sizes it; ``bits`` is a boolean array of ``num_bits``."""

    num_bits: int
    num_hashes: int
    num_inserted: int = 0
    bits: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        if self.bits is None:
            self.bits = np.zeros(self.num_bits, bool)

    @classmethod
    def for_keys(cls, expected: int, rate: float = 0.01) -> Bloom:
        n, p = max(expected, 1), min(max(rate, 1e-9), 0.5)
        m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        return cls(m, int(min(30, max(1, math.floor(m / n * math.log(2) + 0.5)))))

    def probes(self, keys: list[bytes]) -> np.ndarray:
        """Bit positions, one row per key."""
        a, b = hash_pairs(keys)
        steps = np.arange(self.num_hashes, dtype=np.uint64)
        return ((a[:, None] + steps[None, :] * b[:, None]) % np.uint64(self.num_bits)).astype(np.int64)

    def insert(self, keys: list[bytes]) -> None:
        self.bits[self.probes(keys).ravel()] = True
        self.num_inserted += len(keys)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        return self.bits[self.probes(keys)].all(axis=1)

    def size_bytes(self) -> int:
        return -(-self.num_bits // 64) * 8

    def fill_ratio(self) -> float:
        return float(self.bits.sum()) / self.num_bits

    def estimated_fp_rate(self) -> float:
        return self.fill_ratio() ** self.num_hashes

    def encode(self) -> bytes:
        """crc32 of the rest, number of hashes, of bits, and the bits in 64-bit words."""
        words = np.packbits(np.pad(self.bits, (0, -self.num_bits % 64)), bitorder="little").tobytes()
        rest = struct.pack("<IQQ", self.num_hashes, self.num_bits, self.num_inserted) + words
        return struct.pack("<I", zlib.crc32(rest)) + rest

    @classmethod
    def decode(cls, data: bytes) -> Bloom | None:
        """None for anything that is not a whole, intact filter: pruning is then left out."""
        if len(data) < 24 or struct.unpack_from("<I", data)[0] != zlib.crc32(data[4:]):
            return None
        k, m, n = struct.unpack_from("<IQQ", data, 4)
        if m == 0 or k == 0 or len(data) != 24 + -(-m // 64) * 8:
            return None
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=24), bitorder="little")[:m].astype(bool)
        return cls(m, k, n, bits)


def segment_blooms(segments: DataFrame, rate: float = 0.01) -> DataFrame:
    """Per segment, over its distinct keys (deleted ones included): keys, bits, hashes, bits set,
    estimated rate. Only distinct bit positions are shuffled."""
    slot = ["table_seq", "generation"]
    keys = segments.select(*slot, "user_key").distinct()
    sized = keys.join(keys.groupBy(*slot).agg(F.count(F.lit(1)).alias("num_keys")), slot)

    def positions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (a, g, n), part in frame.groupby([*slot, "num_keys"]):
                bits = np.unique(Bloom.for_keys(int(n), rate).probes([bytes(k) for k in part["user_key"]]))
                yield pd.DataFrame({"table_seq": a, "generation": g, "num_keys": n, "bit": bits})

    bits = sized.mapInPandas(positions, "table_seq bigint, generation int, num_keys bigint, bit bigint").distinct()
    counted = bits.groupBy(*slot, "num_keys").agg(F.count(F.lit(1)).alias("bits_set"))
    p = min(max(rate, 1e-9), 0.5)
    num_bits = F.greatest(F.lit(64), F.ceil(F.col("num_keys") * F.lit(-math.log(p) / math.log(2) ** 2)))
    out = counted.withColumn("num_bits", num_bits.cast("bigint"))
    out = out.withColumn("num_hashes", F.least(F.lit(30), F.greatest(F.lit(1), F.floor(F.col("num_bits") / F.col("num_keys") * F.lit(math.log(2)) + 0.5))).cast("int"))
    return out.withColumn("fp_rate", F.pow(F.col("bits_set") / F.col("num_bits"), F.col("num_hashes")))
