import datetime as dt
import json
import math
import zlib

import numpy as np
import pandas as pd
import pytest

from loomline.operators import chunks, drift, spikes
from loomline.operators.grid import regular_grid
from loomline.operators.spikes import flag_readings
from loomline.sources.tables import duration_ms, series_dims, unit_bounds

T = 1_456_790_400_000
SAMPLES = "series_id bigint, ts_ms bigint, value double, labels_crc32 bigint, ingested_at timestamp_ntz"
SERIES = "reg_id bigint, series_id bigint, metric string, labels map<string,string>, labels_crc32 bigint, registered_at timestamp_ntz"
CATALOG = "metric string, mtype string, unit string, lowest double, highest double, help string"
AT = dt.datetime(2016, 3, 1)
CAT = [("temp", "gauge", "c", -60.0, 150.0, None), ("temp2", "gauge", "c", None, None, None), ("hits", "counter", "n", 0.0, None, None), ("odd", "gauge", "u", None, None, None)]


def tables(spark, series, metric="temp", extra=(), labels=None):
    rows = [(s, t, v, None, AT) for s, pts in series.items() for t, v in pts] + list(extra)
    reg = [(i, s, metric, labels or {"scrape_interval": "15s"}, None, AT) for i, s in enumerate(series)]
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(reg, SERIES), spark.createDataFrame(CAT, CATALOG)


def flags(*t, **k):
    return {(r.series_id, r.ts_ms): r.flag for r in flag_readings(*t, **k).collect()}


def noise(n, seed=1, level=20.0, sd=0.5):
    g = np.random.default_rng(seed)
    return [(T + i * 15_000, float(round(level + 3 * math.sin(i / 50) + sd * g.standard_normal(), 3))) for i in range(n)]


def test_durations(spark):
    df = spark.createDataFrame([("15s",), ("1m0s",), ("0.5m",), ("60000ms",), ("1h30m",), ("2m",), ("x",), ("",), (None,), ("0s",), ("5 m",)], "t string")
    assert [r[0] for r in df.select(duration_ms(df.t)).collect()] == [15_000, 60_000, 30_000, 60_000, 5_400_000, 120_000, None, None, None, None, None]


def test_unit_bounds_are_shared(spark):
    b = {r.metric: (r.lo, r.hi) for r in unit_bounds(spark.createDataFrame(CAT, CATALOG)).collect()}
    assert b["temp2"] == (-60.0, 150.0) and b["hits"] == (0.0, None) and b["odd"] == (None, None)


def test_spikes_stuck_and_bounds(spark):
    pts = noise(600)
    wanted = {}
    for i, v, f in ((100, 60.0, "spike"), (101, 61.0, "spike"), (200, -5.0, "spike"), (300, 500.0, "out_of_range"), (301, math.inf, "out_of_range")):
        pts[i] = (pts[i][0], v)
        wanted[1, pts[i][0]] = f
    for i in range(400, 412):
        pts[i] = (pts[i][0], 21.5)
        wanted[1, pts[i][0]] = "stuck"
    for i in range(450, 600):  # a lasting change of level is no case
        pts[i] = (pts[i][0], pts[i][1] + 40)
    assert flags(*tables(spark, {1: pts})) == wanted


def test_levels_and_held_values_are_no_cases(spark):
    g = np.random.default_rng(3)
    level, switching = 0, []
    for i in range(500):
        if g.random() < 0.3:
            level = 1 - level
        switching.append((T + i * 15_000, float(20 + 12 * level + 0.5 * g.standard_normal())))
    held, v = [], 30.0
    for i in range(500):
        if g.random() < 0.05:
            v += float(g.standard_normal())
        held.append((T + i * 15_000, v))
    held[250] = (held[250][0], held[250][1] + 40)
    got = flags(*tables(spark, {1: switching, 2: held}))
    assert got == {(2, held[250][0]): "spike"}


def test_mostly_stuck_series(spark):
    pts = noise(70)
    for i in range(20, 60):
        pts[i] = (pts[i][0], 20.25)
    pts[10] = (pts[10][0], 70.0)
    got = flags(*tables(spark, {1: pts}))
    assert got == {(1, pts[10][0]): "spike"} | {(1, pts[i][0]): "stuck" for i in range(20, 60)}


def test_counters_have_bounds_only(spark):
    pts = [(T + i * 15_000, float(i % 50)) for i in range(100)]
    pts[10] = (pts[10][0], 1e9)
    pts[20] = (pts[20][0], -1.0)
    assert flags(*tables(spark, {1: pts}, "hits")) == {(1, pts[20][0]): "out_of_range"}


def test_counting_rows_nulls_and_unknown_series(spark):
    pts = noise(100)
    late = AT + dt.timedelta(hours=5)
    extra = [(1, pts[50][0], 1e6, None, AT - dt.timedelta(hours=1)), (1, pts[60][0], math.nan, None, late), (1, None, 3.0, None, AT), (None, T, 1e9, None, AT), (7, T, math.inf, None, None), (7, T + 1, 5.0, None, None), (1, pts[70][0], 900.0, None, late)]
    assert flags(*tables(spark, {1: pts}, extra=extra)) == {(7, T): "out_of_range", (1, pts[70][0]): "out_of_range"}


def test_short_long_and_empty(spark):
    assert flags(*tables(spark, {1: [(T, 1.0), (T + 1, 900.0)]})) == {(1, T + 1): "out_of_range"}
    s, t, c = tables(spark, {1: [(T, 1.0)]})
    assert flag_readings(s.limit(0), t, c).count() == 0 and flag_readings(s, t.limit(0), c.limit(0)).count() == 0
    clash = s.selectExpr("*", "1 as span", "2 as code", "3 as block", "4 as interval_ms")
    assert flag_readings(clash, t, c, everything=True).count() == 1


def test_series_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 128)
    monkeypatch.setattr(spikes, "CONTEXT", 32)
    pts = noise(1000)
    hit = [127, 128, 129, 255, 256, 640]
    for i in hit:
        pts[i] = (pts[i][0], 70.0)
    for i in range(380, 392):
        pts[i] = (pts[i][0], 19.0)
    got = flags(*tables(spark, {1: pts}))
    assert set(got) == {(1, pts[i][0]) for i in [*hit, *range(380, 392)]}


def test_stuck_for_whole_blocks(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 128)
    monkeypatch.setattr(spikes, "CONTEXT", 32)
    pts = noise(1000)
    for i in range(150, 750):
        pts[i] = (pts[i][0], 21.25)
    held = [(T + i * 15_000, 30.0 + i // 20 % 7) for i in range(1000)]
    assert flags(*tables(spark, {1: pts, 2: held})) == {(1, pts[i][0]): "stuck" for i in range(150, 750)}


def test_run_lengths_of_blocks_add_up():
    x = np.repeat(np.arange(60.0), np.random.default_rng(4).integers(1, 9, 60))
    for size in (3, 7, 50, len(x)):
        n = -(-len(x) // size)
        starts = np.minimum(np.arange(n + 1) * size, len(x))
        cols = {"series_id": np.full(len(x), 5), "block": np.arange(len(x)) // size, "ts_ms": np.arange(len(x)), "value": x, "code": np.zeros(len(x), int)}
        for shift in range(0, 60, 5):  # other medians
            cols["value"] = np.where(np.arange(len(x)) < 4 * shift, np.arange(len(x)) + 0.5, x)
            got = spikes.make_run_kernel(np.array([-np.inf]), np.array([np.inf]))(cols, starts)
            lengths = np.diff(np.flatnonzero(np.r_[True, np.diff(cols["value"]) != 0, True]))
            found = [s for b in spikes.holding(iter([pd.DataFrame(got)])) for s in b.series_id]
            assert found == [5] * bool(np.median(lengths) >= 4)


def test_forward_backward_is_exact():
    g = np.random.default_rng(0)
    z = np.abs(g.standard_normal(40)) * 9
    no = np.zeros(40, bool)
    e = spikes.emissions(z, g.random(40) < 0.3, no, np.ones(40), np.full(40, 0.02), no)
    move = spikes.fitted_moves(spikes.posteriors(e, np.array([0, 40])), np.array([0, 40]))
    assert np.allclose(move.sum(2), 1) and not np.allclose(move[0], spikes.MOVE, atol=1e-3)
    got = spikes.posteriors(e, np.array([0, 40]), move)
    a = [spikes.START * e[0]]
    for x in e[1:]:
        a.append((a[-1] / a[-1].sum() @ move[0]) * x)
    b = [np.ones(4)]
    for x in e[:0:-1]:
        b.insert(0, move[0] @ (x * b[0] / b[0].sum()))
    p = np.array(a) * np.array(b)
    assert np.allclose(got, p / p.sum(1, keepdims=True), atol=1e-6)


def test_moves_between_states_decide_flags(spark):
    pts = noise(600, sd=0.5)
    wave = lambda i: 20 + 3 * math.sin(i / 50)
    pts[100], pts[101], pts[300] = (pts[100][0], wave(100) + 30), (pts[101][0], wave(101) + 4.0), (pts[300][0], wave(300) + 4.0)
    t = tables(spark, {1: pts})
    # eight scatters are a spike beside a spike, and none alone
    assert flags(*t) == {(1, pts[100][0]): "spike", (1, pts[101][0]): "spike"}
    z, no = np.full(60, 0.7), np.zeros(60, bool)
    z[30] = 8.0
    e = spikes.emissions(z, no, no, np.ones(60), np.full(60, 0.02), no)
    spike = [spikes.posteriors(e, np.array([0, 60]), m)[30, 1] for m in (None, np.full((1, 4, 4), 0.25))]
    assert spike[0] < 0.5 < spike[1]


def test_overfull_blocks_come_in_slices(spark, monkeypatch):
    """A source that reads every 10 ms and says once a minute: all readings lie in one block."""
    monkeypatch.setattr(chunks, "ROWS", 400)
    monkeypatch.setattr(chunks, "OVERLAP_ROWS", 60)
    g = np.random.default_rng(6)
    start = T - T % (60_000 * 4096)
    pts = [(start + i * 10, float(round(20 + g.standard_normal(), 3))) for i in range(5000)]
    hit = [0 + 20, 399, 400, 401, 777, 1999, 4000, 4990]
    for i in hit:
        pts[i] = (pts[i][0], 90.0)
    for i in range(790, 850):
        pts[i] = (pts[i][0], 20.5)
    s, t, c = tables(spark, {1: pts, 2: noise(100)}, labels={"a": "b"})
    assert set(flags(s, t, c)) == {(1, pts[i][0]) for i in [*hit, *range(790, 850)]}
    later = [(start + 6 * 3_600_000 + i * 10, 1.0 + i % 2) for i in range(1500)]
    s, t, _ = tables(spark, {1: pts + later}, labels={"a": "b"})
    got = grid_of(regular_grid(s, t))
    assert sum(r.n_readings for r in got.values()) == 6500 and len(got) == 361
    assert {k[1] for k, r in got.items() if r.missing} == set(range(start + 60_000, start + 6 * 3_600_000, 60_000))


# ------------------------------------------------------------------------------------------------- grid


def grid_of(df):
    return {(r.series_id, r.slot_ms): r for r in df.collect()}


def test_missing_slots_and_values(spark):
    step = 15_000
    pts = [(T + i * step + (i * 37) % 9000, 10.0 + 0.01 * i) for i in range(400) if i % 50 not in (7, 8) and not 100 <= i < 130]
    s, t, _ = tables(spark, {1: pts})
    got = grid_of(regular_grid(s, t))
    missing = {k[1] for k, r in got.items() if r.missing}
    assert missing == {T + i * step for i in range(400) if i % 50 in (7, 8) or 100 <= i < 130} and len(got) == 400
    assert all(abs(got[1, m].value - (10.0 + 0.01 * (m - T) / step)) < 0.05 and got[1, m].sd > 0 for m in missing)
    assert {r.slot_ms for r in regular_grid(s, t, everything=False).collect()} == missing


def test_away_gaps_and_block_borders(spark):
    step, day = 60_000, 86_400_000
    base = T - T % (step * 4096)
    ts = [base - 5 * step, base - 4 * step, base + 500 * step, base + 501 * step, base + 501 * step + day, base + 501 * step + 2 * day + step]
    s, t, _ = tables(spark, {1: [(x, float(i)) for i, x in enumerate(ts)]}, labels={"a": "b"})
    got = {r.slot_ms: r for r in regular_grid(s, t, everything=False).collect()}
    assert set(got) == {*range(base - 3 * step, base + 500 * step, step), *range(base + 502 * step, base + 501 * step + day, step)}
    assert all(r.value is not None and math.isfinite(r.value) for r in got.values())


def test_grid_odd_input(spark):
    late = AT + dt.timedelta(hours=5)
    extra = [(1, T + 15_000, None, None, late), (1, T + 30_000, math.nan, None, AT), (1, T + 45_000, math.inf, None, AT), (2, T, 5.0, None, None), (None, T, 1.0, None, AT), (1, None, 1.0, None, AT)]
    s, t, _ = tables(spark, {1: [(T, 1.0), (T + 15_000, 2.0), (T + 60_000, 3.0), (T + 60_001, 3.0)]}, extra=extra)
    got = grid_of(regular_grid(s, t))
    assert {k[1] for k, r in got.items() if r.missing} == {T + 15_000, T + 30_000}
    assert got[1, T + 60_000].n_readings == 2 and got[1, T + 45_000].n_readings == 1 and got[2, T].value == 5.0
    assert regular_grid(s.limit(0), t).count() == 0
    assert regular_grid(s.selectExpr("*", "1 as span", "1 as block", "1 as home"), t).count() == len(got)


# ------------------------------------------------------------------------------------------------ schemas

BLOCKS = "file_id bigint, file_path string, writer string, written_at timestamp_ntz, row_no int, payload string"


def blocks(spark, files):
    """files: (file_id, writer, hour, records)"""
    rows = [(f, "", w, AT + dt.timedelta(hours=h), i, r if isinstance(r, str) or r is None else json.dumps(r)) for f, w, h, rs in files for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, BLOCKS)


def record(i, **more):
    tags = {"__name__": "m", "pod": f"p{i % 5}"}
    base = {"timestamp": T + i, "value": 1.5 + i, "series_id": 2**60 + i % 5, "labels_crc32": drift.crc_of(sorted(tags.items())), "tags": tags}
    return {k: v for k, v in (base | more).items() if v != "-"}


def changes(df):
    return {tuple(r) for r in drift.schema_changes(df).select("file_id", "change", "field_name", "old_name").collect()}


def test_changes(spark):
    def text(i):
        return ",".join(f"{k}={v}" for k, v in record(i)["tags"].items())

    a = [record(i, owner=f"crew-{i % 5}", rack=i % 5) for i in range(20)]
    b = [record(i, team=f"crew-{i % 5}", rack="-", az=f"z{i % 3}") for i in range(20)]
    c = [record(i, team=f"crew-{i % 5}", az=f"z{i % 3}", tags="-", labels=text(i), labels_crc32=str(record(i)["labels_crc32"])) for i in range(20)]
    d = [record(i, team=f"crew-{i % 5}", az=f"z{i % 3}", tags="-", series_id="-", sid=2**60 + i % 5, labels=text(i), labels_crc32=record(i)["labels_crc32"] - 2**32 * (record(i)["labels_crc32"] >= 2**31)) for i in range(20)]
    df = blocks(spark, [(9, "w", 0, a), (3, "w", 1, b), (5, "w", 2, c), (1, "w", 3, d), (7, "other", 1, b)])
    assert changes(df) == {
        (3, "renamed", "team", "owner"), (3, "removed", "rack", ""), (3, "added", "az", ""),
        (5, "renamed", "labels", "tags"), (5, "retyped", "labels", ""), (5, "retyped", "labels_crc32", ""),
        (1, "renamed", "sid", "series_id"), (1, "retyped", "labels_crc32", ""),
    }
    table = drift.one_table(df, drift.schema_changes(df)).toPandas()
    assert len(table) == 100 and table.crc_ok.all() and table.series_id.notna().all() and set(table.tags) == {f"__name__=m,pod=p{i}" for i in range(5)}


def test_same_name_other_content_is_no_renaming(spark):
    a = [record(i, owner=f"crew-{i % 5}") for i in range(20)]
    b = [record(i, build=f"r{i}.1") for i in range(20)]
    assert changes(blocks(spark, [(1, "w", 0, a), (2, "w", 1, b)])) == {(2, "removed", "owner", ""), (2, "added", "build", "")}


def test_flooding_decides_renamings(monkeypatch):
    def file(**fields):
        p = drift.Profile()
        for i in range(10):
            p.add({k: f(i) for k, f in fields.items()})
        return p.fields

    old = file(timestamp=lambda i: i, owner=lambda i: f"crew-{i}", rack=lambda i: f"r{i}", hostName=lambda i: f"h{i}")
    new = file(timestamp=lambda i: i, team=lambda i: f"crew-{i}", zone=lambda i: f"z{i}", host_name=lambda i: f"h{i}")
    counts = {(a, b): (10, 0, 0) for a in old for b in new if a != b} | {("owner", "team"): (10, 9, 9)}
    del counts["hostName", "host_name"]  # no common series: the names decide
    got = {b: a for b, (a, _) in drift.correspond(old, new, counts).items()}
    assert got == {"timestamp": "timestamp", "team": "owner", "host_name": "hostName"}
    sim = drift.flood(old, new, counts)
    assert sim["owner", "team"] > drift.ACCEPT > max(sim["owner", "zone"], sim["rack", "zone"], sim["rack", "team"])
    monkeypatch.setattr(drift, "flood", lambda o, n, c: {(a, b): 0.5 for a in o for b in n})
    assert {b: a for b, (a, _) in drift.correspond(old, new, counts).items()} != got


def test_two_fields_under_one_name(spark):
    a = [record(i, owner=f"crew-{i % 5}") for i in range(20)]
    b = [record(i, team=f"crew-{i % 5}") for i in range(20)]
    both = [record(i, team="x", owner="y") for i in range(3)]
    df = blocks(spark, [(1, "w", 0, a), (2, "w", 1, b), (3, "v", 0, both)])
    rows = drift.one_table(df, drift.schema_changes(df)).where("file_id = 3").collect()
    assert all(r.owner == "y" and json.loads(r.extra) == {"team": "x"} for r in rows) and len(rows) == 3


def test_unreadable_null_and_empty(spark):
    a = [record(i) for i in range(6)]
    broken = json.dumps(record(1, extra=1))[:40]
    df = blocks(spark, [(1, "w", 0, a), (2, "w", 1, [broken, None, "[1]", *a, record(3, note=None)]), (3, None, 0, a), (4, None, 1, [record(1, x=True)]), (5, "w", 3, [])])
    assert changes(df) == {(4, "added", "x", "")}
    assert drift.schema_changes(df.limit(0)).count() == 0
    assert drift.one_table(df.limit(0), drift.schema_changes(df.limit(0))).count() == 0
    assert drift.one_table(df.unionByName(df).selectExpr("*", "1 as profile"), drift.schema_changes(df)).count() == 6 + 7 + 6 + 1


def test_renaming_is_found_in_a_few_series_of_a_large_file(spark):
    by_hash = sorted(range(10_000), key=lambda i: -zlib.crc32(str(2**60 + i).encode()))
    few = by_hash[:4]
    paths = [[f"/{i}/{k}" for k in range(12)] for i in range(4)]
    a = [record(0, series_id=2**60 + s, owner=f"crew-{i}", path=p) for i, s in enumerate(few) for p in paths[i]]
    a += [record(0, series_id=2**60 + s, owner=f"crew-{s % 50}", path="/") for s in by_hash[4:]]
    b = [record(0, series_id=2**60 + s, team=f"crew-{i}", route=max(paths[i], key=lambda p: zlib.crc32(drift.content(p).encode()))) for i, s in enumerate(few)]
    assert changes(blocks(spark, [(1, "w", 0, a), (2, "w", 1, b)])) == {(2, "renamed", "team", "owner"), (2, "renamed", "route", "path")}


def test_every_field_is_cast_to_one_type(spark):
    big = 2**60 + 1
    a = [record(i, shard=i, weight=i + 0.5, sampled=i % 2 == 0, note="x", dims={"a": i}, Shard=True) for i in range(20)]
    b = [record(i, shard=str(i), weight=f"{i}.5", sampled="True", note=7, dims=f"a={i}", extra=big) for i in range(10)]
    b += [record(10, shard="n/a", weight=2, sampled=None, note=None, series_id="none", timestamp="never")]
    df = blocks(spark, [(1, "w", 0, a), (2, "w", 1, b)])
    got = drift.one_table(df, drift.schema_changes(df))
    assert {k: t for k, t in got.dtypes if k in ("shard", "Shard_2", "Shard", "shard_2", "weight", "sampled", "note", "dims", "extra_2", "extra")} == {"Shard": "boolean", "shard_2": "bigint", "weight": "double", "sampled": "boolean", "note": "string", "dims": "string", "extra_2": "bigint", "extra": "string"}
    rows = {(r.file_id, r.row_no): r for r in got.collect()}
    assert len(rows) == 31
    for i in range(10):
        for f in (1, 2):
            r = rows[f, i]
            assert (r.shard_2, r.weight, r.dims, r.extra, r.series_id) == (i, i + 0.5, json.dumps({"a": str(i)}), "{}", 2**60 + i % 5)
        assert rows[2, i].sampled is True and rows[2, i].note == "7" and rows[2, i].extra_2 == big
    last = rows[2, 10]
    assert last.shard_2 is None and last.weight == 2.0 and json.loads(last.extra) == {"shard": "n/a", "series_id": "none", "timestamp": "never"}


@pytest.mark.parametrize("v", ["pod=a,__name__=m", {"pod": "a", "__name__": "m", "x": None}, [{"key": "pod", "value": "a"}, {"key": "__name__", "value": "m"}, {"key": "x", "value": None}], ["__name__=m", "pod=a"], [["pod", "a"], ["__name__", "m"]], [{"pod": "a"}, {"__name__": "m"}]])
def test_tag_spellings(v):
    assert drift.pairs_of(v) == [("__name__", "m"), ("pod", "a")]


def test_types_and_content():
    assert [drift.kind_of(v) for v in (True, 1, 1.0, "a", {}, [])] == ["boolean", "integer", "fraction", "string", "object", "array"]
    assert drift.main_type({"integer": 5, "fraction": 1}) == "fraction"
    n = 4056856311
    assert len({drift.content(v) for v in (n, str(n), float(n), f"{n}.0", n - 2**32, str(n - 2**32), hex(n))}) == 1
    assert drift.content("x=1,y=2", drift.pairs_of("x=1,y=2")) == drift.content({}, drift.pairs_of({"y": "2", "x": "1"}))
    assert drift.content(True) == drift.content("true") and drift.content("a") != drift.content(1) and drift.content(0.5) == drift.content("0.5")


def test_dims_take_one_registration(spark):
    _, t, _ = tables(spark, {1: []})
    both = t.unionByName(spark.createDataFrame([(9, 1, "temp", {"scrape_interval": None}, None, AT)], SERIES))
    assert [(r.series_id, r.interval_ms) for r in series_dims(both).collect()] == [(1, 15_000)]
