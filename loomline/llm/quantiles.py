"""Percentiles by deterministic buffer collapsing, with partial results that can be joined.

Values go into sorted buffers of ``K`` values of weight 1. Whenever ``FAN`` buffers of one level
exist, they collapse into one of the next level: of their weighted merge, every FAN-th position is
kept, so a buffer of level l has weight FAN**l. Collapsing to weight W moves a rank by at most W/2,
so the rank error is at most half the sum of the weights collapsed to, which every result states.
Sketches join by putting their buffers together and collapsing on; which tasks, days or groups they
come from does not matter.

Defined cases. Null and NaN values are none; infinite values are ordered as numbers. Of several rows
with one series and time the last ingested counts. Absent labels make no group. Groups of up to K
values, and any that never collapsed, are exact. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import cut, is_small, join_small
from loomline.sources.tables import series_dims

K, FAN = 512, 8
LABELS = ("service", "method", "zone")
PERCENTS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Rows of a day that one part of it should have; the parts of a day make sketches of their own, which join.
ROWS_PER_PART = 100_000

PARTIAL = "metric string, day string, label_name string, label_value string, level int, collapsed double, data array<double>"


class Sketch:
    """Buffers by level; ``loose`` holds fewer than K values that fill no buffer yet."""

    def __init__(self, k: int = K, fan: int = FAN):
        self.k, self.fan, self.collapsed = k, fan, 0.0
        self.levels: list[list[np.ndarray]] = []
        self.loose: list[np.ndarray] = []
        self.n_loose = 0

    def add(self, x: np.ndarray) -> None:
        self.loose.append(x)
        self.n_loose += len(x)
        if self.n_loose >= self.k:
            every = np.concatenate(self.loose)
            full = len(every) // self.k
            for i in range(full):
                self.push(0, np.sort(every[i * self.k : (i + 1) * self.k]))
            rest = every[full * self.k :].copy()
            self.loose, self.n_loose = [rest], len(rest)

    def push(self, level: int, buffer: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(buffer)
        if len(self.levels[level]) == self.fan:
            merged = np.sort(np.concatenate(self.levels[level]))
            self.levels[level] = []
            # alternate between the two middles, so that errors of successive collapses tend to cancel
            middle = self.fan // 2 - int(self.fan % 2 == 0 and (self.collapsed / self.fan ** (level + 1)) % 2 >= 1)
            self.collapsed += self.fan ** (level + 1)
            self.push(level + 1, merged[middle :: self.fan][: self.k])

    def parts(self) -> Iterator[tuple[int, float, np.ndarray]]:
        """(level, collapsed, values); level -1 are loose values, and the first part carries the error."""
        owed = self.collapsed
        yield -1, owed, np.concatenate(self.loose) if self.loose else np.zeros(0)
        for i, buffers in enumerate(self.levels):
            for b in buffers:
                yield i, 0.0, b

    def join(self, level: int, collapsed: float, values: np.ndarray) -> None:
        self.collapsed += collapsed
        if level < 0:
            self.add(values)
        else:
            self.push(level, values)

    def percentiles(self, shares: tuple[float, ...]) -> tuple[int, np.ndarray, float]:
        """Number of values, value at each share, bound of the rank error in ranks."""
        parts = [(b, float(self.fan**i)) for i, bs in enumerate(self.levels) for b in bs] + [(x, 1.0) for x in self.loose if len(x)]
        if not parts:
            return 0, np.full(len(shares), np.nan), 0.0
        x = np.concatenate([p for p, _ in parts])
        w = np.concatenate([np.full(len(p), v) for p, v in parts])
        order = np.argsort(x, kind="stable")
        x, w = x[order], w[order]
        n = int(w.sum())
        # a value of weight w stands for w ranks around the middle of its share
        ranks = np.cumsum(w) - w / 2 + 0.5
        want = np.maximum(np.ceil(np.asarray(shares) * n), 1)
        at = np.minimum(np.searchsorted(ranks, want - 0.25), len(x) - 1)
        top = max(v for _, v in parts)
        return n, x[at], self.collapsed / 2 + (top / 2 if top > 1 else 0.0)


def build(batches: Iterator[pa.RecordBatch], labels: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sketches of a task's rows, sorted by (day, series, time): one per group, day and task."""
    sketches: dict[tuple, Sketch] = {}
    at: int | None = None
    kept: tuple | None = None  # last row seen, not yet known to count

    def emit() -> pa.RecordBatch:
        rows = [(*key, level, owed, values) for key, s in sketches.items() for level, owed, values in s.parts() if len(values) or owed]
        cols = list(zip(*rows)) if rows else [[]] * 7
        sketches.clear()
        return pa.RecordBatch.from_pydict({"metric": pa.array(cols[0], pa.string()), "day": pa.array(cols[1], pa.string()), "label_name": pa.array(cols[2], pa.string()), "label_value": pa.array(cols[3], pa.string()), "level": pa.array(cols[4], pa.int32()), "collapsed": pa.array(cols[5], pa.float64()), "data": pa.array(list(cols[6]), pa.list_(pa.float64()))})

    def take(keys: tuple, x: np.ndarray) -> None:
        metric, day, held = keys
        groups = [(metric, day, "", "")] + [(metric, day, n, v) for n, v in zip(labels, held) if v is not None]
        for g in groups:
            s = sketches.get(g)
            if s is None:
                s = sketches[g] = Sketch()
            s.add(x)

    for b in batches:
        if not b.num_rows:
            continue
        days = b.column("day_no").to_numpy()
        sid, ts = (b.column(k).to_numpy() for k in ("series_id", "ts_ms"))
        x = b.column("value").to_numpy(zero_copy_only=False)
        n = len(ts)
        same = np.zeros(n, bool)
        same[:-1] = (sid[1:] == sid[:-1]) & (ts[1:] == ts[:-1])
        counts = ~same
        counts[-1] = False  # the next batch may correct it
        run = np.r_[0, np.flatnonzero((sid[1:] != sid[:-1]) | (days[1:] != days[:-1])) + 1, n]
        heads = pa.array(run[:-1])
        names = [b.column(k).take(heads).to_pylist() for k in ("metric", *(f"label_{i}" for i in range(len(labels))))]
        day_names = np.datetime_as_string(days[run[:-1]].astype("datetime64[D]"))
        if kept is not None:
            if kept[0] != (sid[0], ts[0]) and kept[2] == kept[2]:
                take(kept[1], np.array([kept[2]]))
            kept = None
        for i, (lo, hi) in enumerate(zip(run[:-1], run[1:])):
            now = days[lo]
            if at is not None and now != at and sketches:
                yield emit()
            at = now
            keys = (names[0][i], str(day_names[i]), tuple(c[i] for c in names[1:]))
            v = x[lo:hi][counts[lo:hi]]
            v = v[v == v]
            if len(v):
                take(keys, v)
            if hi == n:
                kept = ((sid[-1], ts[-1]), keys, x[-1])
    if kept is not None and kept[2] == kept[2]:
        take(kept[1], np.array([kept[2]]))
    if sketches:
        yield emit()


def partials(samples: DataFrame, timeseries: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Sketches per metric, day and label value (label_name empty: all of the metric).

    Rows meet by (day, part): the part is a hash of series and hour, so that neither a day nor a series
    can fill a task. Every day has as many parts as its own rows need, so a day with most of all rows is
    split and a stray reading of another century changes nothing. Rows that repeat a series and time have
    to meet before they may be counted, so readings are shuffled once, as numbers; metric and labels are
    attached to them afterwards where the series table is small enough to be broadcast.
    """
    rows = samples.where(F.col("series_id").isNotNull() & F.col("ts_ms").isNotNull()).select("series_id", "ts_ms", "value", "ingested_at")
    day = F.floor(F.col("ts_ms") / 86_400_000).cast("int")
    sizes = cut(rows.groupBy(day.alias("day_no")).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_PART).cast("int").alias("parts")))
    # one number stands for day and part, so that no more than that is shuffled with a reading
    part = F.pmod(F.xxhash64("series_id", F.floor(F.col("ts_ms") / 3_600_000)), F.col("parts"))
    keyed = join_small(rows.withColumn("day_no", day), sizes, "day_no").withColumn("spot", F.hash("day_no", part)).drop("parts", "day_no")
    names = [f"label_{i}" for i in range(len(labels))]
    dims = cut(series_dims(timeseries).select("series_id", "metric", *[F.col("labels")[k].alias(n) for k, n in zip(labels, names)]))
    if is_small(dims):
        ready = keyed.repartition("spot").join(F.broadcast(dims), "series_id", "left")
    else:
        ready = keyed.join(dims, "series_id", "left").repartition("spot")
    order = ["day_no", "series_id", "ts_ms"]
    ready = ready.withColumn("day_no", day).sortWithinPartitions(*order, "ingested_at").select(*order, "value", "metric", *names)
    return ready.mapInArrow(lambda batches: build(batches, labels), PARTIAL)


def joined(parts: DataFrame, groups: list[str], shares: tuple[float, ...] = PERCENTS) -> DataFrame:
    """Percentiles of the joined sketches of each group."""
    schema = ", ".join(f"{g} string" for g in groups) + ", share double, value double, n bigint, rank_error double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        sketch = Sketch()

        def rows() -> list[tuple]:
            n, values, e = sketch.percentiles(shares)
            return [(*at, q, float(v), n, e / max(n, 1)) for q, v in zip(shares, values)] if n else []

        for b in batches:
            out: list[tuple] = []
            keys = list(zip(*[b[g] for g in groups]))
            for key, level, owed, values in zip(keys, b["level"], b["collapsed"], b["data"]):
                if key != at:
                    if at is not None:
                        out += rows()
                    at, sketch = key, Sketch()
                sketch.join(int(level), float(owed), np.asarray(values, float))
            yield pd.DataFrame(out, columns=[*groups, "share", "value", "n", "rank_error"])
        if at is not None:
            yield pd.DataFrame(rows(), columns=[*groups, "share", "value", "n", "rank_error"])

    return parts.select(*groups, "level", "collapsed", "data").repartition(*groups).sortWithinPartitions(*groups, F.desc("level")).mapInPandas(run, schema)
