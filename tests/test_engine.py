import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomline.engine import Engine
from loomline.functions import labels as L
from loomline.plans.syntax import QueryError
from loomline.sources.ingest import from_rows

T = 1_704_067_200_000


def engine(spark, rows, **k):
    return Engine(spark, from_rows(spark, [({**l, "__name__": n}, t, float(v)) for n, l, t, v in rows]), **k)


def answer(e, q, at, end=None, step=60_000):
    df = e.instant(q, at) if end is None else e.range(q, at, end, step)
    return {(r.lkey.replace(L.PAIR, "=").replace(L.SEP, ","), r.step): r.value for r in df.collect()}


def values(e, q, at):
    return {k: v for (k, _), v in answer(e, q, at).items()}


@pytest.fixture(scope="module")
def counters(spark):
    rows = []
    for i in range(300):
        t = T - (299 - i) * 10_000
        rows += [("req", {"job": "api", "method": "get", "status": "200"}, t, 10 * i), ("req", {"job": "api", "method": "post", "status": "200"}, t, 5 * i), ("req", {"job": "api", "method": "get", "status": "500"}, t, i), ("req", {"job": "worker", "method": "get", "status": "200"}, t, 20 * i), ("sub", {"job": "test"}, t, 10 * i)]
    rows += [("mem_used", {"instance": "1"}, T, 104857600), ("mem_total", {"instance": "1"}, T, 1073741824)]
    rows += [("up", {"env": "prod", "pod": "a"}, T, 1), ("up", {"env": "dev", "pod": "b"}, T, 1), ("up", {"pod": "c"}, T, 1)]
    rows += [("v", {"i": str(i)}, T, x) for i, x in enumerate((2, 4, 4, 4, 5, 5, 7, 9))]
    return engine(spark, rows)


def test_rates(counters):
    assert values(counters, "sum by (job) (rate(req[5m]))", T) == pytest.approx({"job=api": 1.6, "job=worker": 2.0})
    assert len(values(counters, "rate(req[5m]) > 0.8", T)) == 2
    assert values(counters, "mem_used / mem_total", T) == {"instance=1": 0.09765625}
    assert set(answer(counters, "rate(sub[5m:1m])", T).values()) == {1.0}
    assert values(counters, "count_over_time(sub[5m:1m])", T) == {"job=test": 6.0}


def test_matchers_on_absent_labels(counters):
    assert len(values(counters, 'up{env!="prod"}', T)) == 2
    assert len(values(counters, 'up{env!=""}', T)) == 2
    assert len(values(counters, 'up{nope=""}', T)) == 3
    assert values(counters, 'up{env!~".*"}', T) == {}
    assert len(values(counters, 'up{env=~"pr"}', T)) == 0
    assert values(counters, 'up{env=~"["}', T) == {}


def test_spread_and_topk(counters):
    assert values(counters, "stddev(v)", T) == pytest.approx({"": 2.0}) and values(counters, "stdvar(v)", T) == pytest.approx({"": 4.0})
    assert sorted(values(counters, "topk(3, v)", T).values()) == [5, 7, 9]
    assert sorted(values(counters, "bottomk(2, v)", T).values()) == [2, 4]
    assert values(counters, "topk(0, v)", T) == {}
    assert values(counters, 'count_values("n", v)', T) == {"n=2": 1, "n=4": 3, "n=5": 2, "n=7": 1, "n=9": 1}
    assert values(counters, "quantile(0.5, v)", T) == {"": 4.5}
    assert values(counters, "quantile(2, v)", T) == {"": math.inf}


def test_scalars_and_signs(counters):
    assert values(counters, "vector(-2 ^ 2)", T) == {"": -4.0}
    assert values(counters, 'vector(scalar(up{env="prod"}))', T) == {"": 1.0}
    assert math.isnan(values(counters, "vector(scalar(up))", T)[""])
    assert values(counters, "1 / vector(0)", T) == {"": math.inf} and values(counters, "-1 / vector(0)", T) == {"": -math.inf}
    assert math.isnan(values(counters, "vector(0) / 0", T)[""]) and math.isnan(values(counters, "vector(5) % 0", T)[""])
    assert values(counters, "ln(vector(0))", T) == {"": -math.inf} and math.isnan(values(counters, "ln(vector(-1))", T)[""])
    assert math.isnan(values(counters, "atanh(vector(1))", T)[""]) and values(counters, "asinh(vector(-1e10))", T)[""] == pytest.approx(math.asinh(-1e10))
    assert values(counters, "floor(vector(Inf))", T) == {"": math.inf} and values(counters, "round(vector(-2.5))", T) == {"": -3.0}
    assert values(counters, "clamp(vector(25), 10, 20)", T) == {"": 20.0} and values(counters, "sgn(vector(NaN))", T) == {"": 0.0}


def test_reset_and_few_samples(spark):
    e = engine(spark, [("c", {}, T, 10), ("c", {}, T + 1000, 20), ("c", {}, T + 2000, 5), ("one", {}, T, 1)])
    assert values(e, "increase(c[10s])", T + 2000) == {"": 15.0}
    assert values(engine(spark, [("c", {}, T, 10), ("c", {}, T + 1000, 20), ("c", {}, T + 2000, 5)], reset="sum"), "increase(c[10s])", T + 2000) == {"": 35.0}
    assert values(e, "resets(c[10s])", T + 2000) == {"": 1.0} and values(e, "changes(c[10s])", T + 2000) == {"": 2.0}
    assert values(e, "rate(one[10s])", T) == {} and values(e, "resets(one[10s])", T) == {"": 0.0}
    assert values(e, "delta(c[10s])", T + 2000) == {"": -5.0} and values(e, "idelta(c[10s])", T + 2000) == {"": -15.0}
    assert values(e, "irate(c[10s])", T + 2000) == {"": 5.0}


def test_fits(spark):
    e = engine(spark, [("m", {}, T + i * 1000, i) for i in range(3)])
    assert values(e, "deriv(m[1m])", T + 2000)[""] == pytest.approx(1.0)
    assert values(e, "predict_linear(m[1m], 10)", T + 2000)[""] == pytest.approx(12.0)
    assert values(e, "quantile_over_time(0.5, m[1m])", T + 2000) == {"": 1.0}


def test_matching_errors_and_groups(spark):
    e = engine(spark, [("a", {"x": "1", "h": "p"}, T, 2), ("a", {"x": "1", "h": "q"}, T, 3), ("b", {"x": "1", "t": "z"}, T, 10), ("b2", {"x": "1", "k": "1"}, T, 1), ("b2", {"x": "1", "k": "2"}, T, 1)])
    assert values(e, "a * on (x) group_left (t) b", T) == {"h=p,t=z,x=1": 20, "h=q,t=z,x=1": 30}
    assert values(e, "b * on (x) group_right a", T) == {"h=p,x=1": 20, "h=q,x=1": 30}
    with pytest.raises(Exception, match="one side"):
        values(e, "a * on (x) group_left b2", T)
    for q in ("a and 1", "rate(a)", "sum(1)", "nope(a)", "abs(a, a)", "label_join(a, 'x')", "a[5m] + 1"):
        with pytest.raises(QueryError):
            e.instant(q, T)
    with pytest.raises(QueryError):
        e.range("a", T, T - 1, 1000)


def test_labels(spark):
    e = engine(spark, [("m", {"instance": "localhost:9090", "job": "web", "Zone": "z"}, T, 1)])
    assert list(values(e, 'label_replace(m, "port", "$1", "instance", "localhost:(.*)")', T)) == ["__name__=m,Zone=z,instance=localhost:9090,job=web,port=9090"]
    assert list(values(e, 'label_replace(m, "port", "$1", "instance", "x(.*)")', T)) == ["__name__=m,Zone=z,instance=localhost:9090,job=web"]
    assert list(values(e, 'label_replace(m, "job", "", "instance", ".*")', T)) == ["__name__=m,Zone=z,instance=localhost:9090"]
    assert list(values(e, 'label_join(m, "both", ":", "job", "nope", "Zone")', T)) == ["__name__=m,Zone=z,both=web::z,instance=localhost:9090,job=web"]
    assert list(values(e, "sum by (__name__) (m)", T)) == ["__name__=m"]
    assert list(values(e, 'm{Zone="z"} + 0', T)) == ["Zone=z,instance=localhost:9090,job=web"]


def test_lookback_is_open_on_the_left(spark):
    e = engine(spark, [("m", {}, T, 1)], lookback_ms=1000)
    assert values(e, "m", T + 999) == {"__name__=m": 1.0} and values(e, "m", T + 1000) == {}
    assert len(answer(e, "m", T - 1000, T + 3000, 500)) == 2
    assert values(e, "absent(m)", T + 1000) == {"": 1.0} and values(e, "absent_over_time(m[1s])", T + 1001) == {"": 1.0}


def test_histogram(spark):
    rows = [("h_bucket", {"le": le}, T, n) for le, n in (("0.1", 2), ("0.5", 6), ("+Inf", 8))]
    e = engine(spark, rows)
    assert values(e, "histogram_quantile(0.5, h_bucket)", T)[""] == pytest.approx(0.1 + 0.4 * 2 / 4)
    assert values(e, "histogram_quantile(0.99, h_bucket)", T) == {"": 0.5}
    assert values(e, "histogram_quantile(1.5, h_bucket)", T) == {}
    assert math.isnan(values(e, 'histogram_quantile(0.5, h_bucket{le!="+Inf"})', T)[""])


def test_nan_in_aggregates(spark):
    e = engine(spark, [("m", {"i": "1"}, T, math.nan), ("m", {"i": "2"}, T, 3), ("m", {"i": "3"}, T, 1)])
    assert values(e, "max(m)", T) == {"": 3.0} and values(e, "min(m)", T) == {"": 1.0}
    assert len(values(e, "m == m", T)) == 2 and len(values(e, "m != m", T)) == 1
    assert len(values(e, "topk(2, m)", T)) == 2 and math.nan not in values(e, "topk(2, m)", T).values()


def test_random_against_plain_loops(spark):
    """Window functions on a grid against a direct evaluation."""
    rnd = random.Random(5)
    series = {}
    for s in "ab":
        t = T
        pts = []
        for _ in range(120):
            t += rnd.choice([500, 4000, 15_000, 90_000])
            pts.append((t, rnd.randint(0, 20)))
        series[s] = pts
    e = engine(spark, [("m", {"s": s}, t, v) for s, pts in series.items() for t, v in pts], lookback_ms=20_000)
    start, end, step = T + 5000, T + 3_000_000, 45_000
    for rng in (30_000, 400_000):
        def win(s, t):
            return [(a, v) for a, v in series[s] if t - rng <= a <= t]

        def inc(w):
            return sum(v if v < p else v - p for (_, p), (_, v) in zip(w, w[1:]))

        wanted = {
            "sum_over_time": lambda w: sum(v for _, v in w), "max_over_time": lambda w: max(v for _, v in w), "count_over_time": len,
            "increase": lambda w: inc(w) if len(w) > 1 else None, "rate": lambda w: inc(w) / ((w[-1][0] - w[0][0]) / 1000) if len(w) > 1 else None,
            "changes": lambda w: sum(a[1] != b[1] for a, b in zip(w, w[1:])), "resets": lambda w: sum(b[1] < a[1] for a, b in zip(w, w[1:])),
            "last_over_time": lambda w: w[-1][1], "idelta": lambda w: w[-1][1] - w[-2][1] if len(w) > 1 else None, "delta": lambda w: w[-1][1] - w[0][1] if len(w) > 1 else None,
        }
        for fn, f in wanted.items():
            got = {(k.split("s=")[1], t): v for (k, t), v in answer(e, f"{fn}(m[{rng}ms])", start, end, step).items()}
            exp = {(s, t): float(x) for s in series for t in range(start, end + 1, step) if (w := win(s, t)) and (x := f(w)) is not None}
            assert got.keys() == exp.keys(), fn
            assert all(got[k] == pytest.approx(exp[k]) for k in exp), fn
    got = {(k.split("s=")[1], t): v for (k, t), v in answer(e, "m", start, end, step).items()}
    exp = {(s, t): float(w[-1][1]) for s in series for t in range(start, end + 1, step) if (w := [(a, v) for a, v in series[s] if t - 20_000 < a <= t])}
    assert got == exp


def test_metadata_and_json(counters, spark):
    assert [r.label_name for r in counters.label_names(["up"]).collect()] == ["__name__", "env", "pod"]
    assert [r.label_value for r in counters.label_values("job").collect()] == ["api", "test", "worker"]
    assert counters.series(['up{env="prod"}', "mem_used"]).count() == 2
    assert counters.read({"__name__": "sub", "job": "test"}, T - 20_000, T).count() == 3
    out = json.loads(counters.to_json("mem_used", T))
    assert out["data"]["result"] == [{"metric": {"__name__": "mem_used", "instance": "1"}, "value": [T / 1000, "104857600.000000"]}]
    assert json.loads(counters.to_json("sub", T - 60_000, T, 60_000))["data"]["resultType"] == "matrix"
    assert json.loads(counters.to_json("sum(", T))["status"] == "error"


def test_one_shuffle_per_window_aggregate(counters):
    """An instant sum reads matching rows only and shuffles series, not samples twice."""
    plan = counters.instant("sum by (job) (sum_over_time(req[5m]))", T)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_promoted_labels(spark):
    rows = from_rows(spark, [({"__name__": "m", "job": "a", "x": "1"}, T, 1.0), ({"__name__": "m", "job": "b", "x": "1"}, T, 2.0)])
    e = Engine(spark, rows.withColumn("job", L.label(F.col("lkey"), "job")))
    assert values(e, 'm{job=~"b|c"}', T) == {"__name__=m,job=b,x=1": 2.0}
