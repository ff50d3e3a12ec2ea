"""The engine's own counters as samples, so that it can be queried like any other source."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from loomline.functions import labels as L

#: Upper bounds of the duration buckets in seconds.
BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 30.0, math.inf)
JOB = "loomline_self_monitor"


class Stats:
    """Queries planned, failed and the time that took; safe to use from several threads."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.queries = self.errors = 0
        self.seconds = 0.0
        self.buckets = [0] * len(BOUNDS)

    @contextmanager
    def query(self) -> Iterator[None]:
        began, failed = time.perf_counter(), 1
        try:
            yield
            failed = 0
        finally:
            took = time.perf_counter() - began
            with self.lock:
                self.queries, self.errors, self.seconds = self.queries + 1, self.errors + failed, self.seconds + took
                self.buckets[next(i for i, b in enumerate(BOUNDS) if took <= b)] += 1

    def samples(self, spark: SparkSession, at_ms: int) -> DataFrame:
        """metric, lkey, ts_ms, value: counters, and the durations as a cumulative histogram."""
        key = f"job{L.PAIR}{JOB}"
        with self.lock:
            rows = [("engine_queries_total", key, float(self.queries)), ("engine_query_errors_total", key, float(self.errors)), ("engine_query_duration_seconds_sum", key, self.seconds), ("engine_query_duration_seconds_count", key, float(self.queries))]
            n = 0
            for bound, count in zip(BOUNDS, self.buckets):
                n += count
                le = "+Inf" if math.isinf(bound) else f"{bound:g}"
                rows.append(("engine_query_duration_seconds_bucket", f"{key}{L.SEP}le{L.PAIR}{le}", float(n)))
        return spark.createDataFrame([(m, k, at_ms, v) for m, k, v in rows], "metric string, lkey string, ts_ms bigint, value double")


STATS = Stats()
