"""Irregular readings onto a regular grid by a Kalman smoother per source.

Model: local linear trend in continuous time; level and slope move as integrated random walks between
readings, and each reading is the level plus noise. The noise shares come from robust differences at
two lags. Forward filter and backward smoother run over many windows of readings at once; values at
grid times between two readings come from the filtered state before and the smoothed state after.

A slot is ``[slot_ms, slot_ms + interval)``, ``slot_ms`` a multiple of the source's interval. Slots
without readings between two slots with readings are missing and get a filled value and its standard
deviation; where the two lie more than ``AWAY_MS`` apart the source was away and has no slots there.

Defined cases. Null and NaN values are no readings; of several rows with one time the last ingested
counts. An infinite reading occupies its slot but is not believed. Before a source's first finite
reading the value is null. Sources missing from the series table have the default interval of one
minute. Empty tables give empty results. A source's first slot is valued at its first reading, all
others at ``slot_ms``.

Blocks and windows are smoothed with readings of their neighbours as context, not with the whole series;
noise shares are those of the block and its context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.chunks import DAY_MS, over_blocks, to_blocks, window_matrix, windows
from loomline.runtime import cut, join_small
from loomline.sources.tables import DEFAULT_INTERVAL_MS, series_dims

AWAY_MS = DAY_MS
#: Intervals in a block (at least a day, so that a gap never spans a whole block) and of context.
BLOCK, CONTEXT = 4096, 96
#: Readings kept of an open block end, to fill a gap that reaches over it.
TAIL = 48
CORE, OVERLAP = 256, 32
#: Standard deviations up to which a reading is believed as it is.
DOUBT = 4.0

SLOTS = "series_id bigint, slot_ms bigint, value double, sd double, n_readings int, missing boolean"
EDGE = "edge int, block bigint, interval_ms bigint, edge_ts array<bigint>, edge_value array<double>"


def noise_shares(t: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Reading noise and level noise per interval, from median squared differences at lags 1 and 8."""
    if len(x) < 3:
        return 1.0, 0.1

    def at(lag: int) -> tuple[float, float]:
        d, dt = np.abs(x[lag:] - x[:-lag]), t[lag:] - t[:-lag]
        return (1.4826 * float(np.median(d))) ** 2, max(float(np.median(dt)), 1e-9)

    far = min(8, len(x) - 1)
    (v1, t1), (v8, t8) = at(1), at(far)
    q = max((v8 - v1) / (t8 - t1), 0.0) if t8 > t1 else 0.0
    r = max((v1 - q * t1) / 2, 0.0)
    top = max(v1, v8, float(np.var(x)) * 1e-4, 1e-24)
    return max(r, 1e-4 * top), max(q, 1e-5 * top)


def predict(m0, m1, p00, p01, p11, dt, q, w):
    """State of level and slope after ``dt`` intervals."""
    return m0 + m1 * dt, m1, p00 + 2 * dt * p01 + dt * dt * p11 + q * dt + w * dt**3 / 3, p01 + dt * p11 + w * dt * dt / 2, p11 + w * dt


def back(f, pred, later, dt):
    """One backward step: state ``f`` before, its prediction ``pred`` over ``dt``, smoothed state ``later``."""
    m0, m1, a, b, c = f
    n0, n1, pa_, pb, pc = pred
    s0, s1, sa, sb, sc = later
    det = np.maximum(pa_ * pc - pb * pb, 1e-12 * pa_ * pc + 1e-300)
    # gain = P F' inv(P_predicted)
    u0, u1, v0, v1 = a + b * dt, b, b + c * dt, c
    g00, g01 = (u0 * pc - u1 * pb) / det, (u1 * pa_ - u0 * pb) / det
    g10, g11 = (v0 * pc - v1 * pb) / det, (v1 * pa_ - v0 * pb) / det
    d0, d1 = s0 - n0, s1 - n1
    ea, eb, ec = sa - pa_, sb - pb, sc - pc
    return (
        m0 + g00 * d0 + g01 * d1,
        m1 + g10 * d0 + g11 * d1,
        np.maximum(a + g00 * g00 * ea + 2 * g00 * g01 * eb + g01 * g01 * ec, 0.0),
        b + g00 * g10 * ea + (g00 * g11 + g01 * g10) * eb + g01 * g11 * ec,
        np.maximum(c + g10 * g10 * ea + 2 * g10 * g11 * eb + g11 * g11 * ec, 0.0),
    )


def smooth(t: np.ndarray, x: np.ndarray, r: np.ndarray, q: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered and smoothed states (5 x rows) of groups of readings; t in intervals, x may be NaN (not believed)."""
    n = len(x)
    filtered, smoothed = np.zeros((5, n)), np.zeros((5, n))
    first, last, skip = windows(starts, CORE, OVERLAP)
    if not len(first):
        return filtered, smoothed
    at, real = window_matrix(first, last)
    width = at.shape[1]
    xt, tt = x[at], t[at]
    rr, qq, ww = r[first], q[first], w[first]
    known = real & np.isfinite(xt)
    begin = np.where(known.any(1), xt[np.arange(len(at)), known.argmax(1)], 0.0)
    fs = np.empty((width, 5, len(at)))
    state = (begin, np.zeros(len(at)), np.full(len(at), 1e6) * (rr + qq), np.zeros(len(at)), qq + ww + 1e-12)
    for i in range(width):
        if i:
            state = predict(*state, tt[:, i] - tt[:, i - 1], qq, ww)
        m0, m1, a, b, c = state
        k = known[:, i]
        d = np.where(k, xt[:, i] - m0, 0.0)
        # a reading beyond DOUBT standard deviations is given the noise that makes it plausible
        s = np.maximum(a + rr, np.minimum(np.abs(d), 1e100) ** 2 / DOUBT**2)
        k0, k1 = np.where(k, a / s, 0.0), np.where(k, b / s, 0.0)
        state = (m0 + k0 * d, m1 + k1 * d, (1 - k0) * a, (1 - k0) * b, np.maximum(c - k1 * b, 0.0))
        fs[i] = state
    ss = np.empty_like(fs)
    ss[-1] = fs[-1]
    later = tuple(fs[-1])
    for i in range(width - 2, -1, -1):
        dt = tt[:, i + 1] - tt[:, i]
        f = tuple(fs[i])
        new = back(f, predict(*f, dt, qq, ww), later, dt)
        go = real[:, i + 1]
        later = tuple(np.where(go, y, z) for y, z in zip(new, f))
        ss[i] = later
    col = np.arange(width)[None, :]
    core = real & (col >= skip[:, None]) & (col < skip[:, None] + CORE)
    filtered[:, at[core]] = fs.transpose(1, 2, 0)[:, core]
    smoothed[:, at[core]] = ss.transpose(1, 2, 0)[:, core]
    return filtered, smoothed


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group its number repeated, and 0, 1, ... within it."""
    g = np.repeat(np.arange(len(counts)), counts)
    return g, np.arange(len(g)) - np.repeat(np.cumsum(counts) - counts, counts)


def fill(ts: np.ndarray, x: np.ndarray, step: np.ndarray, starts: np.ndarray, left: np.ndarray, slots: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Value and standard deviation at ``slots``, each between reading ``left`` and the next one of its group, then those of the readings ``at``."""
    n = len(x)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    origin = ts[starts[:-1]]
    t = (ts - origin[group]) / step
    mid, unit = np.zeros(len(starts) - 1), np.ones(len(starts) - 1)
    r, q = np.empty(n), np.empty(n)
    seen = np.zeros(len(starts) - 1, bool)
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        ok = np.isfinite(x[a:b])
        if ok.any():
            xs = x[a:b][ok]
            mid[k] = np.median(xs)
            unit[k] = max(float(np.median(np.abs(xs - mid[k]))), 1e-6 * abs(mid[k]), 1e-300)
            seen[k] = True
            r[a:b], q[a:b] = noise_shares(t[a:b][ok], (xs - mid[k]) / unit[k])
        else:
            r[a:b], q[a:b] = 1.0, 0.1
    with np.errstate(all="ignore"):
        scaled = np.where(np.isfinite(x), (x - mid[group]) / unit[group], np.nan)
    w = 1e-4 * q
    f, s = smooth(t, scaled, r, q, w, starts)
    g = group[left]
    dt1 = (slots - origin[g]) / step[left] - t[left]
    dt2 = t[left + 1] - t[left] - dt1
    mine = tuple(f[:, left])
    here = predict(*mine, dt1, q[left], w[left])
    m0, _, p00, _, _ = back(here, predict(*here, dt2, q[left], w[left]), tuple(s[:, left + 1]), dt2)
    if at is not None:
        g, m0, p00 = np.r_[g, group[at]], np.r_[m0, s[0, at]], np.r_[p00, s[2, at]]
    value = np.where(seen[g], m0 * unit[g] + mid[g], np.nan)
    return value, np.where(seen[g], np.sqrt(np.maximum(p00, 0.0)) * unit[g], np.nan)


def span_of(step: np.ndarray) -> np.ndarray:
    """Length of a block in ms: BLOCK intervals, and more than AWAY_MS."""
    return step * np.maximum(BLOCK, -(-AWAY_MS // step) + 1)


def make_kernel(everything: bool):
    def kernel(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, object]:
        ok = ~np.isnan(cols["value"])
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[ok]
        sid, block, ts, x, home, step = (cols[k][ok] for k in ("series_id", "block", "ts_ms", "value", "home", "interval_ms"))
        n = len(x)
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
        edges = np.r_[new, n]
        slot = ts - ts % step
        tail = np.zeros(n, bool)
        tail[edges[1:] - 1] = True
        nxt = np.minimum(np.arange(n) + 1, max(n - 1, 0))
        gap = np.where(tail, 0, slot[nxt] - slot)
        holes = np.where(home & (gap > step) & (gap <= AWAY_MS), gap // step - 1, 0)
        left, k = spread(holes)
        at = slot[left] + (k + 1) * step[left]
        rows = {"series_id": sid[left], "slot_ms": at, "missing": np.ones(len(left), bool), "n_readings": np.zeros(len(left), np.int32)}
        begin = np.zeros(0, int)
        if everything:
            # a slot with readings belongs to the block of its first reading; its time lies between that and the reading before
            head = np.r_[True, (slot[1:] != slot[:-1]) | (group[1:] != group[:-1])] if n else np.zeros(0, bool)
            count = np.diff(np.r_[np.flatnonzero(head), n])
            pick = home[head]
            first, count = np.flatnonzero(head)[pick], count[pick]
            opens = np.r_[True, group[1:] != group[:-1]][first] if n else np.zeros(0, bool)
            begin, first, count = first[opens], first[~opens], np.r_[count[~opens], count[opens]]  # nothing stands before a source's first reading
            every = np.r_[first, begin]
            rows = {"series_id": np.r_[rows["series_id"], sid[every]], "slot_ms": np.r_[at, slot[every]], "missing": np.r_[rows["missing"], np.zeros(len(every), bool)], "n_readings": np.r_[rows["n_readings"], count].astype(np.int32)}
            left, at = np.r_[left, first - 1], np.r_[at, slot[first]]
        value, sd = fill(ts, x, step.astype(float), edges, left, at, begin) if len(left) or len(begin) else (np.zeros(0), np.zeros(0))
        # open ends: a gap may reach from the block's last reading beyond its context
        lone_end = np.flatnonzero(home & tail)
        # the first own reading of a block is out of its predecessor's sight beyond the context
        first_own = home & ~cols["sliced"][ok] & np.r_[True, (group[1:] != group[:-1]) | ~home[:-1]] if n else np.zeros(0, bool)
        lone_begin = np.flatnonzero(first_own & (ts - block * span_of(step) >= CONTEXT * step))
        open_ = [(1, i, max(edges[np.searchsorted(edges, i, "right") - 1], i + 1 - TAIL), i + 1) for i in lone_end] + [(2, i, i, min(edges[np.searchsorted(edges, i, "right")], i + TAIL)) for i in lone_begin]
        m, e = len(value), len(open_)
        nan = np.isnan(value)
        idx = np.array([o[1] for o in open_], int)
        return {
            "series_id": np.r_[rows["series_id"], sid[idx]],
            "slot_ms": pa.array(np.r_[rows["slot_ms"], np.zeros(e, np.int64)], pa.int64()),
            "value": pa.array(np.r_[value, np.zeros(e)], pa.float64(), mask=np.r_[nan, np.ones(e, bool)]),
            "sd": pa.array(np.r_[sd, np.zeros(e)], pa.float64(), mask=np.r_[nan, np.ones(e, bool)]),
            "n_readings": pa.array(np.r_[rows["n_readings"], np.zeros(e, np.int32)].astype(np.int32)),
            "missing": np.r_[rows["missing"], np.zeros(e, bool)],
            "edge": pa.array([0] * m + [o[0] for o in open_], pa.int32()),
            "block": np.r_[np.zeros(m, np.int64), block[idx]],
            "interval_ms": np.r_[np.zeros(m, np.int64), step[idx]],
            "edge_ts": pa.array([None] * m + [ts[o[2] : o[3]].tolist() for o in open_], pa.list_(pa.int64())),
            "edge_value": pa.array([None] * m + [x[o[2] : o[3]].tolist() for o in open_], pa.list_(pa.float64())),
        }

    return kernel


def bridge(batches):
    """Fill gaps between an open block end (a) and the next block's open begin (b)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.to_pydict()
        parts = [np.r_[np.array(a, np.int64), np.array(b, np.int64)] for a, b in zip(c["a_ts"], c["b_ts"])]
        ts = np.concatenate(parts)
        x = np.concatenate([np.r_[np.array(a, float), np.array(b, float)] for a, b in zip(c["a_value"], c["b_value"])])
        sizes = np.array([len(p) for p in parts])
        starts = np.r_[0, np.cumsum(sizes)]
        step_of = np.array(c["interval_ms"], np.int64)
        step = np.repeat(step_of, sizes)
        left_at = starts[:-1] + np.array([len(a) for a in c["a_ts"]]) - 1
        slot = ts - ts % step
        gap = slot[left_at + 1] - slot[left_at]
        g, k = spread(np.where((gap > step_of) & (gap <= AWAY_MS), gap // step_of - 1, 0))
        left = left_at[g]
        at = slot[left] + (k + 1) * step[left]
        if not len(at):
            continue
        value, sd = fill(ts, x, step.astype(float), starts, left, at)
        nan = np.isnan(value)
        yield pa.RecordBatch.from_pydict({"series_id": np.array(c["series_id"], np.int64)[g], "slot_ms": at, "value": pa.array(value, mask=nan), "sd": pa.array(sd, mask=nan), "n_readings": np.zeros(len(at), np.int32), "missing": np.ones(len(at), bool)})


def regular_grid(samples: DataFrame, timeseries: DataFrame, everything: bool = True) -> DataFrame:
    """series_id, slot_ms, value, sd, n_readings, missing on each source's regular grid.

    ``everything`` false: only missing slots. Values are those at ``slot_ms``, also of slots with readings. One shuffle of the samples; the result is kept in the checkpoint folder,
    because the few gaps that reach over a block's end are filled from what its neighbours report.
    """
    dims = series_dims(timeseries).select("series_id", "interval_ms")
    rows = join_small(samples.select("series_id", "ts_ms", "value", "ingested_at"), dims, "series_id", "left")
    rows = rows.withColumn("interval_ms", F.coalesce("interval_ms", F.lit(DEFAULT_INTERVAL_MS)))
    day = F.ceil(F.lit(AWAY_MS) / F.col("interval_ms")).cast("long") + 1  # as in span_of
    rows = rows.withColumn("span", F.col("interval_ms") * F.greatest(F.lit(BLOCK).cast("long"), day)).withColumn("context", F.col("interval_ms") * CONTEXT)
    out = cut(over_blocks(to_blocks(rows, "span", "context", ["interval_ms"]), make_kernel(everything), f"{SLOTS}, {EDGE}"))
    names = ["series_id", "slot_ms", "value", "sd", "n_readings", "missing"]
    ends = out.where("edge = 1").select("series_id", "block", "interval_ms", F.col("edge_ts").alias("a_ts"), F.col("edge_value").alias("a_value"))
    begins = out.where("edge = 2").select("series_id", (F.col("block") - 1).alias("block"), F.col("edge_ts").alias("b_ts"), F.col("edge_value").alias("b_value"))
    over = ends.join(begins, ["series_id", "block"]).where(F.col("b_ts")[0] - F.element_at("a_ts", -1) <= AWAY_MS + F.col("interval_ms"))
    return out.where("edge = 0").select(*names).unionByName(over.mapInArrow(bridge, SLOTS))
