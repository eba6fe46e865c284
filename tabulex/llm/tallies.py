"""Counts by 64-bit key: summed in tasks, cut to the most frequent, looked up for many keys at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tally:
    """Sums of (training, all) counts by 63-bit key, merged now and then."""

    def __init__(self, limit: int = 800_000):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        """Keys as they occur, and which of them are in training documents."""
        packed = (keys.astype(np.uint64) << np.uint64(1)) | train.astype(np.uint64)
        packed.sort()
        keys = (packed >> np.uint64(1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.put(keys[first], np.add.reduceat((packed & np.uint64(1)).astype(np.int64), first) if len(first) else first, np.diff(first, append=len(keys)))

    def put(self, keys: np.ndarray, train: np.ndarray, every: np.ndarray) -> None:
        self.parts.append((keys, train, every))
        self.size += len(keys)
        if self.size > self.limit and len(self.parts) > 1:
            self.merge()

    def merge(self) -> None:
        keys, train, every = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        self.parts = []
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[first], np.add.reduceat(train[order], first), np.add.reduceat(every[order], first))]
        self.size = len(first)

    def full(self) -> bool:
        return self.size > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.merge()
        out = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 3
        self.parts, self.size = [], 0
        return out


def word_keys(own: list[np.ndarray]) -> np.ndarray:
    """63 bits of the words' hashes."""
    return (np.concatenate(own) >> np.uint64(1)).astype(np.int64)


def frequent(df: DataFrame, most: int) -> pa.Table:
    """The rows with the largest ``every``, as many as whole steps of a sixteenth of a doubling allow under ``most``."""
    step = F.floor(F.log2(F.col("every")) * 16).cast("int")
    taken, least = 0, 1 << 30
    for r in sorted(df.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"]):
        taken += r["n"]
        if taken > most:
            break
        least = r["s"]
    return df.where(step >= least).toArrow()


class Lookup:
    """Values of up to some hundred thousand 64-bit keys: a slot table first, a search for keys that share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 21):
        order = np.argsort(keys)
        self.keys, self.values, self.shift = keys[order], values[order], np.uint64(64 - bits)
        self.slot = np.full(1 << bits, len(keys), np.int32)
        self.slot[self.place(self.keys)] = np.arange(len(keys), dtype=np.int32)
        self.padded = np.append(self.keys, np.int64(-1))
        self.padded_values = np.append(self.values, 0.0)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); 0 where not found."""
        at = self.slot[self.place(keys)]
        found = (self.padded[at] == keys) & (at < len(self.keys))
        values = np.where(found, self.padded_values[at], 0.0)
        if len(self.keys) and not found.all():
            miss = np.flatnonzero(~found)
            own = keys[miss]
            i = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = self.keys[i] == own
            values[miss[hit]] = self.values[i[hit]]
            found[miss[hit]] = True
        return values, found
