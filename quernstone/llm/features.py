"""Hashed word and byte n-gram features of many texts at once, and the bounded sample of labelled rows for training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import RELEASES

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Labelled rows that a classifier is fitted on, at most: they are collected to the driver.
TRAIN_ROWS = 4000


def _drop_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


RELEASES.append(_drop_powers)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, _P_INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Bytes:
    """The texts' bytes one after another, each between separators, with hashes of any span by prefix sums."""

    def __init__(self, texts: list[bytes], separator: bytes = b" "):
        joined = separator + separator.join(texts) + separator if texts else separator
        self.raw = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_starts = np.cumsum(lengths + 1) - lengths
        up, self._down = _power_tables(len(self.raw) + 1)
        with np.errstate(over="ignore"):
            terms = self.raw.astype(np.uint64) + np.uint64(1)
            terms *= up[: len(terms)]
            self._sums = np.zeros(len(terms) + 1, np.uint64)
            np.cumsum(terms, out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def words(self, separates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word; separates: for each byte value, whether it parts words."""
        inside = ~separates[self.raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, np.searchsorted(self.doc_starts, starts, side="right") - 1


def grams(source: Bytes, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte n-grams of each word with one separator on either side, and how many each word has."""
    flat, counts = [], []
    for n in sizes:
        count = np.maximum(ends - starts + 2 - n + 1, 1)
        first = np.repeat(starts - 1, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        last = np.minimum(first + n, np.repeat(ends + 1, count))
        flat.append(source.hashes(first, last))
        counts.append(count)
    if len(sizes) == 1:
        return flat[0], counts[0]
    total = sum(counts)
    out = np.empty(int(total.sum()), np.uint64)
    begin = np.cumsum(total) - total
    for hashes, count in zip(flat, counts, strict=True):
        out[np.repeat(begin, count) + np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)] = hashes
        begin = begin + count
    return out, total


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS) -> list[tuple[bytes, int]]:
    """Whole texts with their labels, `limit` rows at most, picked by a hash of the id.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are used. Rows without a text, id or label are left out; of
    repeated ids one row counts.
    """
    learnable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learnable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    found = sorted((r.doc_id, r.text, r.y) for r in rows.collect())
    return [(text.encode(), y) for _, text, y in found]


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0
