"""Series cut into time blocks with context, so that no task ever holds a whole series.

A block spans a fixed number of nominal intervals of its source. Rows near a block's border are also
sent to the neighbour as context (``home`` false). One shuffle by (series, block), one sort; Python
sees blocks in a bounded stream of Arrow batches, an overfull block in overlapping slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Rows a kernel gets at once, and rows that two slices of an overfull block share on either side of their border.
ROWS, OVERLAP_ROWS = 150_000, 4096


def to_blocks(samples: DataFrame, span: str, context: str, keep: list[str]) -> DataFrame:
    """samples (series_id, ts_ms, value, ingested_at, ``span``, ``context`` and ``keep`` columns) by block.

    Sorted by series, block, time and time of ingestion, so that the last row of a time counts.
    Rows with a null ``series_id`` or ``ts_ms`` are no readings and are left out.
    """
    s, c = F.col(span), F.col(context)
    off = F.pmod(F.col("ts_ms"), s)
    block = F.expr(f"(ts_ms - pmod(ts_ms, {span})) div {span}")
    targets = F.array_compact(F.array(F.struct(block.alias("block"), F.lit(True).alias("home")), F.when(off < c, F.struct((block - 1).alias("block"), F.lit(False).alias("home"))), F.when(off >= s - c, F.struct((block + 1).alias("block"), F.lit(False).alias("home")))))
    return (
        samples.where(F.col("series_id").isNotNull() & F.col("ts_ms").isNotNull())
        .select("series_id", "ts_ms", "value", "ingested_at", *keep, F.explode(targets).alias("to"))
        .select("series_id", F.col("to.block").alias("block"), "ts_ms", "value", F.col("to.home").alias("home"), *keep, "ingested_at")
        .repartition("series_id", "block")
        .sortWithinPartitions("series_id", "block", "ts_ms", "ingested_at")
        .drop("ingested_at")
    )


def over_blocks(df: DataFrame, kernel: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str, rows: int | None = None, overlap: int | None = None) -> DataFrame:
    """Run ``kernel(columns, starts)`` over (series_id, block) groups, about ``rows`` rows at a time.

    ``columns`` hold the counting rows only (the last per series, block and time); null values are NaN.
    ``starts`` are the groups' first rows plus the end. A group of more rows than that (a source that
    reads far more often than it says) comes in slices that share ``overlap`` rows on either side as
    context; ``columns["sliced"]`` marks the rows of all slices of a group but its first.
    """
    names = [f.name for f in df.schema]
    rows, overlap = rows or ROWS, OVERLAP_ROWS if overlap is None else overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = lead = 0  # rows held; of these, rows at the start that an earlier slice of their group has answered for
        sliced = False

        def emit(last: bool) -> pa.RecordBatch | None:
            nonlocal held, n, lead, sliced
            t = pa.Table.from_batches(held)
            cols = {k: t.column(k).to_numpy() for k in names}
            sid, blk, ts = cols["series_id"], cols["block"], cols["ts_ms"]
            new = np.flatnonzero((sid[1:] != sid[:-1]) | (blk[1:] != blk[:-1])) + 1
            end = rest = n
            own = np.arange(n) >= lead
            more = np.zeros(n, bool)
            if sliced:
                more[: new[0] if len(new) else n] = True
            if not last and len(new):
                end = rest = int(new[-1])
            elif not last:
                at = int(np.searchsorted(ts, ts[-1]))  # a time whose rows may not all be here
                if at <= 2 * overlap:
                    return None
                own[at - overlap :] = False
                rest, end = at - 2 * overlap, n if overlap else at
            held = t.slice(rest).combine_chunks().to_batches() if rest < n else []
            sliced = bool(rest < n and not len(new))
            lead = overlap if sliced else 0
            n -= rest
            sid, blk, ts = sid[:end], blk[:end], ts[:end]
            keep = np.ones(end, bool)
            keep[:-1] = (sid[1:] != sid[:-1]) | (blk[1:] != blk[:-1]) | (ts[1:] != ts[:-1])
            cols = {k: v[:end][keep] for k, v in cols.items()}
            cols["home"], cols["sliced"] = cols["home"] & own[:end][keep], more[:end][keep]
            sid, blk = cols["series_id"], cols["block"]
            starts = np.r_[0, np.flatnonzero((sid[1:] != sid[:-1]) | (blk[1:] != blk[:-1])) + 1, len(sid)]
            return pa.RecordBatch.from_pydict(kernel(cols, starts))

        want = rows
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= want:
                out = emit(False)
                want = 2 * n if out is None else max(rows, n + rows // 2)  # None: nearly all rows have one time
                if out is not None and out.num_rows:
                    yield out
        if n:
            out = emit(True)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def windows(starts: np.ndarray, core: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal-length windows over groups of rows, for recursions that run over many windows at once.

    Returns (first row, last row + 1, offset of the core) per window; windows of a group overlap by
    ``overlap`` rows on both sides of their core of ``core`` rows.
    """
    sizes = np.diff(starts)
    n = np.maximum(1, -(-sizes // core)) * (sizes > 0)
    g = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    lo, hi = starts[:-1][g], starts[1:][g]
    a = lo + k * core
    first, last = np.maximum(a - overlap, lo), np.minimum(a + core + overlap, hi)
    return first, last, a - first


def window_matrix(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (windows x longest window), and which of them are real; padding repeats the last row."""
    width = int((last - first).max()) if len(first) else 0
    at = first[:, None] + np.arange(width)[None, :]
    real = at < last[:, None]
    return np.where(real, at, last[:, None] - 1), real
