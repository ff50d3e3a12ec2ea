"""Implausible readings: a hidden Markov model per source.

States: normal, spike, stuck, out of range. Each reading gives three observations: its distance from
the source's course in units of the source's scatter, whether it equals a neighbour, and whether the
unit allows it. The emissions of normal, spike and stuck overlap everywhere: how wide a source's normal
distances reach and how often its normal readings repeat is fitted per source, and so are the moves
between states, by one round of Baum-Welch from common prior moves. Forward-backward probabilities
under the fitted model set the flags; hard bounds decide what is out of range, and a stuck reading must
stand in a run of STUCK equal ones. Blocks of a source are fitted one by one, each with its context.

Defined cases. Rows with null or NaN value are no readings; of several rows with one time the last
ingested counts. Infinite readings are always flagged. A series without a metric in the catalogue has
no bounds and is treated as no gauge. An empty table gives an empty result. Blocks with fewer than
``MIN_READINGS`` finite readings have no known normal scatter; no reading of them is a spike. Whether a
source holds values for long is known from the runs of equal readings of its whole series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.chunks import over_blocks, to_blocks, window_matrix, windows
from loomline.runtime import cut, join_small
from loomline.sources.tables import DEFAULT_INTERVAL_MS, series_dims, unit_bounds

SCHEMA = "series_id bigint, ts_ms bigint, value double, flag string, p_spike double, p_stuck double"

#: Intervals in a block, and of context on either side.
BLOCK, CONTEXT = 4096, 384
#: Readings on either side that make the course (a running median).
HALF = 7
MIN_READINGS = 12
#: Distances of normal readings, in scatters: half-normal, and a wider half-normal for steep places of the course.
WIDE, SHARE_WIDE = 3.0, 0.03
#: Distances of spikes: log-normal with this median and this standard deviation of the logarithm.
SPIKE, SPIKE_LOG = 40.0, 1.0
#: How far a source's width of normal distances may be fitted, and its share of readings that equal a neighbour.
WIDTHS, REPEATS = (1.0, 1.2), (0.01, 0.15)
#: Weight of the prior moves against those counted in a block, in readings.
PRIOR = 2000.0
#: Distance in scatters from which on a reading is off the course of its source, in the search for levels and ends.
OFF = 5.0
#: Held values have no scatter but steps; a spike of 6 usual steps is as far as 10 scatters.
STEP_WEIGHT = 10 / 6
#: Readings of one value in a row that count as stuck.
STUCK = 8
#: Usual (median) length of runs of equal readings from which a source holds values; longer runs than RUNS tell no more.
HOLDS, RUNS = 4, 8
#: Share of readings off the course from which a source may switch between levels, and readings around that show a level.
SWITCHING, AROUND = 0.04, 96
#: Prior start and move probabilities of normal, spike, stuck, out of range.
START = np.array([0.985, 0.005, 0.005, 0.005])
MOVE = np.array([[0.9925, 0.0050, 0.0015, 0.0010], [0.595, 0.400, 0.0025, 0.0025], [0.045, 0.003, 0.950, 0.002], [0.900, 0.020, 0.010, 0.070]])


def course(x: np.ndarray, half: int = HALF) -> np.ndarray:
    """Running median of 2 * half + 1 readings; at the ends the readings are mirrored."""
    h = min(half, len(x) - 1)
    return np.median(sliding_window_view(np.pad(x, h, mode="reflect"), 2 * h + 1), axis=1)


def distances(x: np.ndarray, held: bool) -> np.ndarray:
    """Distance of each reading from the course in scatters. ``held``: the source holds values for long.

    Unless it does, a run of STUCK or more equal readings counts once, so that it can't pass for scatter.
    """
    lengths = np.diff(np.r_[-1, np.flatnonzero(x[1:] != x[:-1]), len(x) - 1])
    if held or lengths.max() < STUCK:
        return departures(x, held)
    first = np.cumsum(lengths) - lengths
    use = np.repeat(lengths < STUCK, lengths)
    use[first] = True
    z = np.zeros(len(x))
    if use.sum() >= MIN_READINGS:
        z[use] = departures(x[use], False)
    return z


def departures(x: np.ndarray, held: bool) -> np.ndarray:
    n = len(x)
    dx = np.abs(np.diff(x))
    m = course(x)
    r = np.abs(x - m)
    size = float(np.abs(np.median(x)))
    if held:
        steps = np.abs(np.diff(m))
        steps = steps[steps > 0]
        s = 1.4826 * float(np.median(np.r_[steps, 0.005 * size, 0.005 * size] if len(steps) < 6 else steps))
    else:
        s = min(1.4826 * float(np.median(r)), 1.4826 / np.sqrt(2) * float(np.median(dx)))
        near = dx[dx > 0]
        s = max(s, 0.5 * float(np.min(near)) if len(near) else 0.0)
    s = max(s, 1e-12 * size, 1e-300)
    z = r / s * (STEP_WEIGHT if held else 1.0)
    far = np.flatnonzero(z > OFF)
    if len(far) >= SWITCHING * n and not held:
        # levels the source keeps switching to: other readings nearby, not of the same excursion, agree with it
        order = np.minimum(np.maximum(far[:, None] + np.r_[-AROUND:-3, 4 : AROUND + 1][None, :], 0), n - 1)
        agree = (np.abs(x[order] - x[far][:, None]) <= 5 * s).sum(axis=1)
        z[far[agree >= max(6, 0.05 * order.shape[1])]] = 0.0
    # an excursion has readings on course before and after it
    out = np.flatnonzero(z > OFF)
    if len(out):
        on = z <= OFF
        a, b = int(np.argmax(on)), n - int(np.argmax(on[::-1]))
        z[:a] = np.where(z[:a] > OFF, 0.0, z[:a])
        z[b:] = np.where(z[b:] > OFF, 0.0, z[b:])
    return z


def half_normal(z: np.ndarray, width: np.ndarray) -> np.ndarray:
    return 0.79788456 / width * np.exp(-0.5 * (z / width) ** 2)


def emissions(z: np.ndarray, equal: np.ndarray, barred: np.ndarray, width: np.ndarray, repeats: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Densities (rows x 4) of a distance and of equality to a neighbour in every state.

    ``width`` and ``repeats`` are the source's; a source that holds values (``held``) has no stuck state.
    """
    zc = np.minimum(z, 1e12)
    normal = (1 - SHARE_WIDE) * half_normal(zc, width) + SHARE_WIDE * half_normal(zc, WIDE * width)
    at = np.maximum(zc, 1e-3)
    spike = 0.39894228 / (SPIKE_LOG * at) * np.exp(-0.5 * (np.log(at / SPIKE) / SPIKE_LOG) ** 2)
    e = np.empty((len(z), 4))
    usual = np.where(equal, repeats, 1 - repeats)
    e[:, 0], e[:, 1] = normal * usual, spike * usual
    e[:, 2] = (0.9 * normal + 0.1 * spike) * np.where(held, 0.0, np.where(equal, 0.995, 0.005))
    e[:, 3] = 0.0
    e[barred] = (0.0, 0.0, 0.0, 1.0)
    return e + 1e-300


def posteriors(e: np.ndarray, starts: np.ndarray, move: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward state probabilities (rows x 4) of groups of rows given by ``starts``; ``move``: a matrix per group."""
    out = np.empty((len(e), 4))
    first, last, skip = windows(starts, 256, 32)
    if not len(first):
        return out
    at, real = window_matrix(first, last)
    c, width = at.shape
    m = np.broadcast_to(MOVE, (c, 4, 4)) if move is None else move[np.searchsorted(starts, first, "right") - 1]
    turn = np.ascontiguousarray(m.transpose(0, 2, 1))
    alpha = np.empty((width, c, 4))
    beta = np.empty((width, c, 4))
    a = START[None, :] * e[at[:, 0]]
    alpha[0] = a / a.sum(1, keepdims=True)
    for i in range(1, width):
        a = (alpha[i - 1][:, None, :] @ m)[:, 0] * e[at[:, i]]
        alpha[i] = a / a.sum(1, keepdims=True)
    beta[-1] = 1.0
    b = np.ones((c, 4))
    for i in range(width - 2, -1, -1):
        b = ((b * e[at[:, i + 1]])[:, None, :] @ turn)[:, 0]
        b /= b.sum(1, keepdims=True)
        b[~real[:, i + 1]] = 1.0
        beta[i] = b
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    col = np.arange(width)[None, :]
    core = real & (col >= skip[:, None]) & (col < skip[:, None] + 256)
    out[at[core]] = p.transpose(1, 0, 2)[core]
    return out


def fitted_moves(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Moves per group: the expected moves between neighbouring readings, added to PRIOR readings' worth of prior moves."""
    g = len(starts) - 1
    group = np.repeat(np.arange(g), np.diff(starts))
    inner = np.flatnonzero(group[1:] == group[:-1])
    counts = np.stack([np.bincount(group[inner], weights=p[inner, i] * p[inner + 1, j], minlength=g) for i in range(4) for j in range(4)], 1).reshape(g, 4, 4)
    counts = counts + PRIOR * STILL[:, None] * MOVE
    return counts / counts.sum(2, keepdims=True)


#: Share of readings that the prior moves leave in each state in the long run.
STILL = np.linalg.matrix_power(MOVE, 4096)[0]


def equal_runs(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the run of equal readings that each row is in; runs end with their group."""
    if not len(x):
        return np.zeros(0, int)
    cut = np.r_[True, (x[1:] != x[:-1]) | (group[1:] != group[:-1])]
    at = np.flatnonzero(cut)
    return np.repeat(np.diff(np.r_[at, len(x)]), np.diff(np.r_[at, len(x)]))


RUN_COLUMNS = ["series_id", "block", "ts_ms", "first", "n_first", "last", "n_last", "runs", *(f"n{i}" for i in range(1, RUNS + 1))]
RUN_SCHEMA = ", ".join(f"{c} {'double' if c in ('first', 'last') else 'bigint'}" for c in RUN_COLUMNS)


def make_run_kernel(lo: np.ndarray, hi: np.ndarray):
    """Per block: value and length of the first and last run of equal readings, and how many runs have which length."""
    def kernel(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        x, code = cols["value"], cols["code"]
        ok = np.isfinite(x) & (x >= lo[code]) & (x <= hi[code])
        x, group = x[ok], group[ok]
        at = np.flatnonzero(np.r_[np.ones(min(len(x), 1), bool), (x[1:] != x[:-1]) | (group[1:] != group[:-1])])
        lengths, of = np.diff(np.r_[at, len(x)]), group[at]
        groups, first, runs = np.unique(of, return_index=True, return_counts=True)
        last = first + runs - 1
        rank = np.repeat(np.arange(len(groups)), runs)
        hist = np.bincount(rank * RUNS + np.minimum(lengths, RUNS) - 1, minlength=len(groups) * RUNS).reshape(-1, RUNS)
        row = starts[:-1][groups]
        return dict(zip(RUN_COLUMNS, [cols["series_id"][row], cols["block"][row], cols["ts_ms"][row], x[at[first]], lengths[first], x[at[last]], lengths[last], runs, *hist.T.copy()]))

    return kernel


def holds(counts: np.ndarray) -> bool:
    """Whether the median of run lengths, given how many runs have length 1, 2, ... RUNS or more, reaches HOLDS."""
    n, upto = counts.sum(), np.cumsum(counts)
    return bool(n) and np.searchsorted(upto, [(n - 1) // 2, n // 2], side="right").sum() + 2 >= 2 * HOLDS


def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Series that hold values, of blocks sorted by series and time; a run that goes over block borders is one."""
    at, counts, value, length = None, np.zeros(RUNS, int), 0.0, 0
    for b in batches:
        out = []
        for sid, _, _, first, n_first, last, n_last, runs, *hist in b[RUN_COLUMNS].itertuples(index=False, name=None):
            if sid != at:
                if length:
                    counts[min(length, RUNS) - 1] += 1
                    out += [at] if holds(counts) else []
                at, counts, length = sid, np.zeros(RUNS, int), 0
            counts += np.array(hist)
            counts[min(n_first, RUNS) - 1] -= 1
            if length and value != first:
                counts[min(length, RUNS) - 1] += 1
                length = 0
            value, length = first, length + n_first
            if runs > 1:
                counts[min(length, RUNS) - 1] += 1
                counts[min(n_last, RUNS) - 1] -= 1
                value, length = last, n_last
        yield pd.DataFrame({"series_id": np.array(out, np.int64)})
    if length:
        counts[min(length, RUNS) - 1] += 1
        if holds(counts):
            yield pd.DataFrame({"series_id": np.array([at], np.int64)})


def make_kernel(gauge: np.ndarray, lo: np.ndarray, hi: np.ndarray, everything: bool):
    def kernel(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        ok = ~np.isnan(cols["value"])
        sid, ts, x, home, code, group = (v[ok] for v in (cols["series_id"], cols["ts_ms"], cols["value"], cols["home"], cols["code"], group))
        barred = ~np.isfinite(x) | (x < lo[code]) | (x > hi[code])
        n = len(x)
        flag = np.where(barred, 3, 0)
        p = np.zeros((n, 4))
        p[:, 0], p[:, 3] = ~barred, barred
        g = np.flatnonzero(gauge[code])
        if len(g):
            gx, gg, gb = x[g], group[g], barred[g]
            held = cols["held"][ok][g]
            z, width, repeats = np.zeros(len(g)), np.ones(len(g)), np.full(len(g), 0.999)
            run = equal_runs(gx, gg)
            edges = np.r_[0, np.flatnonzero(gg[1:] != gg[:-1]) + 1, len(g)]
            for a, b in zip(edges[:-1], edges[1:]):
                use = np.flatnonzero(~gb[a:b]) + a
                if len(use) < MIN_READINGS:
                    continue
                z[use] = distances(gx[use], bool(held[a]))
                width[a:b] = np.clip(np.quantile(z[use], 0.9) / 1.645, *WIDTHS)
            for a, b in zip(edges[:-1], edges[1:]):
                if not held[a]:
                    repeats[a:b] = np.clip(np.mean((run[a:b] > 1) & (run[a:b] < STUCK)), *REPEATS)
            e = emissions(z, run > 1, gb, width, repeats, held)
            p[g] = q = posteriors(e, edges, fitted_moves(posteriors(e, edges), edges))
            stuck = (q[:, 2] > 0.5) & (run >= STUCK)
            flag[g] = np.where(gb, 3, np.where(stuck, 2, np.where(q[:, 1] > q[:, 0], 1, 0)))
        pick = home if everything else home & (flag > 0)
        return {"series_id": sid[pick], "ts_ms": ts[pick], "value": x[pick], "flag": np.array(["normal", "spike", "stuck", "out_of_range"], object)[flag[pick]], "p_spike": p[pick, 1], "p_stuck": p[pick, 2]}

    return kernel


def flag_readings(samples: DataFrame, timeseries: DataFrame, catalog: DataFrame, everything: bool = False) -> DataFrame:
    """Flags of readings (``everything``: also of normal ones) as series_id, ts_ms, value, flag and probabilities.

    Two shuffles of the samples, the first of gauges only: the usual run length of a series is that of all
    its readings, so it is known before the series is cut into blocks with context. The catalogue (one row per metric) is read to the driver, at most
    100,000 rows of it are allowed; the series table is joined by a size-checked broadcast.
    """
    limits = unit_bounds(catalog).orderBy("metric").limit(100_001).collect()
    if len(limits) > 100_000:
        raise ValueError("the metric catalogue has more than 100,000 metrics")
    gauge = np.array([r.mtype == "gauge" for r in limits] + [False])
    lo = np.array([-np.inf if r.lo is None else r.lo for r in limits] + [-np.inf])
    hi = np.array([np.inf if r.hi is None else r.hi for r in limits] + [np.inf])
    spark = samples.sparkSession
    codes = spark.createDataFrame([(r.metric, i, r.mtype == "gauge") for i, r in enumerate(limits)], "metric string, code int, gauge boolean")
    dims = series_dims(timeseries).join(F.broadcast(codes), "metric", "left")
    dims = dims.select("series_id", "code", "gauge", "interval_ms")
    rows = join_small(samples.select("series_id", "ts_ms", "value", "ingested_at"), dims, "series_id", "left")
    interval = F.coalesce("interval_ms", F.lit(DEFAULT_INTERVAL_MS))
    rows = rows.select("series_id", "ts_ms", "value", "ingested_at", F.coalesce("code", F.lit(len(limits))).alias("code"), "gauge", (interval * BLOCK).alias("span"), (interval * CONTEXT).alias("context"))
    runs = over_blocks(to_blocks(rows.where("gauge").withColumn("context", F.col("context") * 0), "span", "context", ["code"]), make_run_kernel(lo, hi), RUN_SCHEMA, overlap=0)
    held = cut(runs.repartition("series_id").sortWithinPartitions("series_id", "block", "ts_ms").mapInPandas(holding, "series_id bigint"))
    rows = join_small(rows, held.withColumn("held", F.lit(True)), "series_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    return over_blocks(to_blocks(rows, "span", "context", ["code", "held"]), make_kernel(gauge, lo, hi, everything), SCHEMA)
