"""Latency histogram with power-of-two buckets, and counters in the order in which they are served."""

from __future__ import annotations

import logging
import threading
import time
from contextlib import contextmanager

VERSION = (0, 1, 0)
BUCKETS = 40
HEALTH = ("ready", "durable", "catalog_columns", "host_bytes", "wal_pending", "dropped_writes")
STATS = ("cold_borrows", "rebalances", "migrations", "columns", "host_bytes", "cold_bytes", "query_count", "total_ns", "max_ns", "p50_ns", "p99_ns", "version")
log = logging.getLogger("quernstone")
log.setLevel(logging.WARNING)


def packed_version() -> int:
    major, minor, patch = VERSION
    return major << 32 | minor << 16 | patch


class Latency:
    def __init__(self):
        self.buckets, self.count, self.total, self.largest, self.lock = [0] * BUCKETS, 0, 0, 0, threading.Lock()

    def record(self, nanos: int) -> None:
        with self.lock:
            self.buckets[min(BUCKETS - 1, (nanos + 1).bit_length() - 1)] += 1
            self.count, self.total, self.largest = self.count + 1, self.total + nanos, max(self.largest, nanos)

    @contextmanager
    def timed(self):
        began = time.perf_counter_ns()
        try:
            yield
        finally:
            self.record(time.perf_counter_ns() - began)

    def percentile(self, share: float) -> int:
        """Upper end of the bucket in which that share of all queries is reached; 0 without queries."""
        need, seen = share * self.count, 0
        for k, n in enumerate(self.buckets):
            seen += n
            if n and seen >= need:
                return (1 << (k + 1)) - 2
        return 0
