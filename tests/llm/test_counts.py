import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import distinct as D
from loomline.llm import quantiles as Q
from loomline.llm.frequent import frequent_items

AT = dt.datetime(2016, 3, 1)
LOG = "log_id bigint, seen_at timestamp_ntz, arrived_at timestamp_ntz, tenant string, cluster string, series_id bigint, label_name string, label_value string"


def log(spark, rows):
    """rows: (day, tenant, cluster, series, name, value)"""
    return spark.createDataFrame([(i, AT + dt.timedelta(days=d), None, t, c, s, n, v) for i, (d, t, c, s, n, v) in enumerate(rows)], LOG)


# ----------------------------------------------------------------------------------------------- distinct


@pytest.mark.parametrize("base", [1.05, 1.2, 2.0])
def test_estimates_keep_the_stated_error(spark, base):
    df = spark.range(100_000).select((F.col("id") % 5).alias("g"), F.xxhash64("id").alias("h"))
    parts = D.registers(df.unionByName(df), ["g"], "h", 1024, base)
    got = D.estimates(parts, ["g"], 1024, base).collect()
    assert len(got) == 5 and all(abs(r.distinct_estimate - 20_000) < 4 * r.relative_error * 20_000 for r in got)


def contents(df, m):
    t = df.select("registers").toArrow()
    row, code = D.entries(t.column("registers"), m)
    return sorted(zip(row.tolist(), code.tolist()))


@pytest.mark.parametrize("n", [100, 20_000])  # few registers used, and all
def test_merging_equals_counting_together(spark, monkeypatch, n):
    monkeypatch.setattr(D, "HELD_ROWS", 900)
    monkeypatch.setattr(D, "HELD_ENTRIES", 700)
    df = spark.range(n).select((F.col("id") % 7).cast("string").alias("day"), F.xxhash64(F.col("id") % (n * 3 // 5)).alias("h"))
    together = D.registers(df.withColumn("x", F.lit(1)), ["x"], "h")
    merged = D.merge(D.registers(df, ["day"], "h").withColumn("x", F.lit(1)), ["x"])
    assert together.count() == 1 and contents(together, D.M) == contents(merged, D.M)
    want = {r.r: r.l for r in df.groupBy(D.register(F.col("h")).alias("r")).agg(F.max(D.level(F.col("h"))).alias("l")).collect()}
    assert {c >> 16: c & 0xFFFF for _, c in contents(together, D.M)} == want


def test_fold_in_chunks_equals_fold_at_once():
    import pyarrow as pa

    g = np.random.default_rng(3)
    group, code = np.sort(g.integers(0, 40, 5000)), g.integers(0, 64, 5000) << 16 | g.integers(1, 99, 5000)
    t = pa.table({"g": pa.array([None if x == 7 else f"g{x}" for x in group]), "registers": pa.array(code)})
    whole = D.fold(t, ["g"], 64)
    assert whole.num_rows == 40
    old = D.HELD_ROWS, D.HELD_ENTRIES
    D.HELD_ROWS, D.HELD_ENTRIES = 300, 120
    try:
        parts = list(D.folding(["g"], 64, False)(iter(t.to_batches(max_chunksize=37))))
        got = pa.Table.from_batches(list(D.folding(["g"], 64, True)(iter(pa.Table.from_batches(parts).sort_by("g").to_batches(max_chunksize=5)))))
    finally:
        D.HELD_ROWS, D.HELD_ENTRIES = old
    assert got.num_rows == 40 and sorted(map(repr, got.to_pylist())) == sorted(map(repr, whole.to_pylist()))


def test_groupings_and_odd_rows(spark):
    rows = [(d, t, c, s, "pod", f"p{s % 30}") for d in (0, 1) for t in ("a", None) for c in ("x", "y") for s in range(50)]
    rows += [(0, "a", "x", None, "pod", None), (0, "a", "x", None, "pod", ""), (0, "a", "x", 1, None, "v")]
    got = {(r.kind, r.grouping, r.day, r.tenant, r.cluster): r.distinct_estimate for r in D.distinct_counts(log(spark, rows + rows)).collect()}
    assert len(got) == 2 * (8 + 3 * 4 + 3 * 2 + 1)
    assert all(abs(v - (50 if k[0] == "series_id" else 30)) < 3 for k, v in got.items())
    assert ("series_id", "tenant", None, None, None) in got and ("series_id", "", None, None, None) in got
    assert D.distinct_counts(log(spark, rows).limit(0)).count() == 0
    assert D.distinct_counts(log(spark, rows).selectExpr("*", "1 as kind", "2 as h", "3 as day", "4 as register")).count() == len(got)


def test_rate_is_the_likelihood_maximum():
    g = np.random.default_rng(1)
    for n in (1, 30, 5000):
        u = g.random(n)
        k = np.floor(1 - np.log(u) / np.log(1.2)).astype(int)
        reg = np.zeros(256, int)
        np.maximum.at(reg, g.integers(0, 256, n), k)
        c = np.bincount(reg, minlength=D.levels() + 1)[None, :].astype(float)
        best = float(D.rate(c)[0])
        f = lambda lam: float(sum(x * np.log(math.exp(-lam * 1.2**-i) - (math.exp(-lam * 1.2 ** -(i - 1)) if i else 0)) for i, x in enumerate(c[0]) if x))
        assert f(best) >= max(f(best * 1.01), f(best * 0.99)) and best * 256 == pytest.approx(n, rel=0.3, abs=1)


@pytest.mark.parametrize("only_a,only_b,both", [(4000, 2000, 3000), (1000, 1000, 0), (0, 0, 5000), (50, 20, 10)])
def test_joint_estimates(spark, only_a, only_b, both):
    a = spark.range(0, only_a + both).select(F.lit("k").alias("k"), F.xxhash64("id").alias("h"))
    b = spark.range(only_a, only_a + both + only_b).select(F.lit("k").alias("k"), F.xxhash64("id").alias("h"))
    r = D.overlaps(D.registers(a, ["k"], "h"), D.registers(b, ["k"], "h"), ["k"]).first()
    union = only_a + only_b + both
    assert r.union_estimate == pytest.approx(union, rel=0.09)
    assert abs(r.jaccard_estimate - both / union) < 0.05 and abs(r.intersection_estimate - both) < 0.07 * union + 3
    assert abs(r.union_estimate - union) <= 4 * r.union_error + 2 and (union < 1000 or r.union_error <= 0.04 * union)
    assert abs(r.intersection_estimate - both) <= 4 * r.intersection_error + 2 and abs(r.jaccard_estimate - both / union) <= 4 * r.jaccard_error + 0.01


def test_overlaps_of_days_and_clusters(spark):
    rows = [(d, t, c, 100 * d + 50 * k + s, "pod", f"p{s}") for d in (0, 1, 3) for t in ("a", None) for k, c in enumerate("xyz") for s in range(100)]
    got = {(r.kind, r.tenant, r.day): r for r in D.next_day_overlap(log(spark, rows)).collect()}
    assert set(got) == {(k, t, "2016-03-01") for k in ("series_id", "label:pod") for t in ("a", None)}
    assert abs(got["series_id", None, "2016-03-01"].intersection_estimate - 100) < 20
    got = {(r.kind, r.tenant, r.cluster): r for r in D.cluster_overlap(log(spark, rows)).collect()}
    assert {k[1:] for k in got} == {(t, c) for t in ("a", None) for c in "xy"} and got["series_id", "a", "x"].next_cluster == "y"
    assert D.next_day_overlap(log(spark, rows).limit(0)).count() == 0 == D.cluster_overlap(log(spark, rows).limit(0)).count()


# ----------------------------------------------------------------------------------------------- frequent


def brute(rows, share):
    from collections import Counter

    c = Counter((n, v) for n, v in rows if v and n is not None)
    total = Counter(n for n, v in rows if v and n is not None)
    return {(n, v): k for (n, v), k in c.items() if k >= share * total[n]}


def test_frequent_items_are_exact(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), f"v{int(rnd.paretovariate(0.7))}") for _ in range(20_000)] + [("a", None), ("a", ""), (None, "x")] * 500
    rows += [("tie", f"t{i % 100}") for i in range(1000)]
    df = spark.createDataFrame(rows, "label_name string, label_value string")
    got = {(r.label_name, r["item"]): r for r in frequent_items(df, ["label_name"], "label_value", 1, 100).collect()}
    want = brute(rows, 0.01)
    assert {k: r.n_rows for k, r in got.items()} == want and sum(k[0] == "tie" for k in got) == 100
    assert all(r.coarse_bound >= r.n_rows for r in got.values())


def test_frequent_numbers_without_groups_of_values(spark):
    df = spark.createDataFrame([("d", i % 50 if i % 2 else 7) for i in range(1000)] + [("d", None)], "day string, series_id bigint")
    got = {r["item"]: r.n_rows for r in frequent_items(df, ["day"], "series_id", 1, 10).collect()}
    assert got == {7: 520}
    assert frequent_items(df.limit(0), ["day"], "series_id", 1, 10).count() == 0
    clash = df.selectExpr("*", "1 as item", "2 as bucket", "3 as n", "4 as hash")
    assert frequent_items(clash, ["day"], "series_id", 1, 10).count() == 1
    with pytest.raises(ValueError):
        frequent_items(df, ["day"], "series_id", 1, 10_000)


# ---------------------------------------------------------------------------------------------- quantiles


def rank_error(values, x, share):
    s = np.sort(values)
    want = max(math.ceil(share * len(s)), 1)
    return max(np.searchsorted(s, x, "left") + 1 - want, want - np.searchsorted(s, x, "right"), 0)


@pytest.mark.parametrize("order", ["random", "sorted", "reversed", "ties"])
def test_rank_error_stays_in_its_bound(order):
    g = np.random.default_rng(4)
    x = g.lognormal(size=60_000)
    x = {"random": x, "sorted": np.sort(x), "reversed": np.sort(x)[::-1].copy(), "ties": np.round(x)}[order]
    parts = [Q.Sketch(64, 8) for _ in range(7)]
    for i, chunk in enumerate(np.array_split(x, 200)):
        parts[i % 7].add(chunk)
    whole = Q.Sketch(64, 8)
    for p in parts:
        for piece in p.parts():
            whole.join(*piece)
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    n, values, bound = whole.percentiles(shares)
    assert n == len(x) and bound / n < 0.05
    assert all(rank_error(x, v, q) <= bound + 1 for v, q in zip(values, shares))
    assert sum(len(v) for _, _, v in whole.parts()) < 64 * 8 * 5


def test_small_sketches_are_exact():
    s = Q.Sketch()
    s.add(np.array([3.0, 1.0, math.inf, 2.0]))
    assert s.percentiles((0.25, 0.5, 1.0))[1].tolist() == [1.0, 2.0, math.inf] and s.percentiles((0.5,))[2] == 0
    assert Q.Sketch().percentiles((0.5,))[0] == 0


def test_percentiles_per_group(spark):
    t = 1_456_790_400_000
    rows = [(s, t + i * 60_000, float(i + 1000 * s), None, AT) for s in (1, 2) for i in range(2000)]
    rows += [(1, t, 1e9, None, AT - dt.timedelta(days=1)), (1, t + 60_000, math.nan, None, AT + dt.timedelta(days=1)), (2, t + 120_000, None, None, AT + dt.timedelta(days=1)), (None, t, 1.0, None, None), (1, None, 1.0, None, None)]
    samples = spark.createDataFrame(rows, "series_id bigint, ts_ms bigint, value double, labels_crc32 bigint, ingested_at timestamp_ntz")
    series = spark.createDataFrame([(1, 1, "m", {"service": "a", "zone": "z"}, None, AT), (2, 2, "m", {"service": "b", "zone": None}, None, AT)], "reg_id bigint, series_id bigint, metric string, labels map<string,string>, labels_crc32 bigint, registered_at timestamp_ntz")
    got = {(r.day, r.label_name, r.label_value, r.share): r for r in Q.joined(Q.partials(samples, series), ["metric", "day", "label_name", "label_value"]).collect()}
    assert {k[1:3] for k in got} == {("", ""), ("service", "a"), ("service", "b"), ("zone", "z")}
    a = [float(i + 1000) for i in range(1440) if i != 1]
    r = got["2016-03-01", "service", "a", 0.5]
    assert r.n == 1439 and rank_error(a, r.value, 0.5) <= r.rank_error * r.n + 1
    assert got["2016-03-01", "service", "b", 0.5].n == 1439 and got["2016-03-02", "zone", "z", 0.5].n == 560
    days = Q.joined(Q.partials(samples, series), ["metric", "label_name", "label_value"]).where("label_name = '' and share = 0.5").first()
    assert days.n == 3998
    assert Q.joined(Q.partials(samples.limit(0), series), ["metric", "day", "label_name", "label_value"]).count() == 0
    assert Q.partials(samples.selectExpr("*", "1 as part", "2 as metric", "3 as day_no"), series.limit(0)).count() > 0


def test_many_parts_give_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(Q, "ROWS_PER_PART", 100)
    t = 1_456_790_400_000
    samples = spark.createDataFrame([(1, t + i * 15_000, float(i), None, AT) for i in range(4000)], "series_id bigint, ts_ms bigint, value double, labels_crc32 bigint, ingested_at timestamp_ntz")
    series = spark.createDataFrame([(1, 1, "m", {"service": "a"}, None, AT)], "reg_id bigint, series_id bigint, metric string, labels map<string,string>, labels_crc32 bigint, registered_at timestamp_ntz")
    parts = Q.partials(samples, series)
    assert parts.count() > 8  # from all tasks
    r = Q.joined(parts, ["metric", "label_name"]).where("label_name = 'service' and share = 0.9").first()
    assert r.n == 4000 and abs(r.value - 3599) <= r.rank_error * 4000 + 1


def test_a_hot_day_a_stray_day_and_other_labels(spark, monkeypatch):
    monkeypatch.setattr(Q, "ROWS_PER_PART", 100)
    t = 1_456_790_400_000
    rows = [(1, t + i * 20_000, float(i), None, AT) for i in range(4000)] + [(1, 0, 5.0, None, AT), (1, t + 40 * 86_400_000, 6.0, None, AT)]
    samples = spark.createDataFrame(rows, "series_id bigint, ts_ms bigint, value double, labels_crc32 bigint, ingested_at timestamp_ntz")
    series = spark.createDataFrame([(1, 1, "m", {"pod": "a", "env": "e"}, None, AT)], "reg_id bigint, series_id bigint, metric string, labels map<string,string>, labels_crc32 bigint, registered_at timestamp_ntz")
    parts = Q.partials(samples, series, labels=("pod", "env"))
    assert parts.where("label_name = 'pod' and day = '2016-03-01'").count() > 4
    got = {(r.day, r.label_name, r.label_value): r.n for r in Q.joined(parts, ["day", "label_name", "label_value"]).where("share = 0.5").collect()}
    assert got == {(d, *g): n for d, n in (("1970-01-01", 1), ("2016-03-01", 4000), ("2016-04-10", 1)) for g in (("", ""), ("pod", "a"), ("env", "e"))}
