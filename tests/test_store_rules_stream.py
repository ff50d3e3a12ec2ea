import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.engine import Engine
from loomline.functions import labels as L
from loomline.operators import sketches as K
from loomline.operators import vectors as V
from loomline.operators.rules import DropRules, RecordingRule, backoff_s, parse_drop_rules, parse_rules, record, run_group
from loomline.plans.syntax import QueryError
from loomline.sources import binary, ingest, store
from loomline.streaming import live

T = 1_704_067_200_000


def rows(spark, n=10, name="m", add=0.0, start=T):
    return ingest.from_rows(spark, [({"__name__": name, "s": str(i % 2)}, start + i * 1000, i + add) for i in range(n)])


def test_write_read_overwrite_compact(spark, tmp_path):
    p, out = str(tmp_path / "a"), str(tmp_path / "b")
    store.write(rows(spark), p, 1)
    store.write(rows(spark, 4, add=100.0), p, 2)
    store.write(rows(spark, 2, start=T + 86_400_000), p, 3)
    now = store.newest(store.read(spark, p))
    assert sorted(r.value for r in now.where(F.col("ts_ms") < T + 86_400_000).collect()) == [4, 5, 6, 7, 8, 9, 100, 101, 102, 103]
    store.compact(spark, p, out)
    assert store.read(spark, out).count() == 12
    e = Engine(spark, store.read(spark, out).select("metric", "lkey", "ts_ms", "value", "date"))
    df = e.instant("sum(m)", T + 9000)
    assert [r.value for r in df.collect()] == [17.0]
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: .*date", plan) and "EqualTo(metric,m)" in plan


def test_ingest_odd_rows(spark):
    df = spark.createDataFrame([({"__name__": "m", "a": "", "b": None, "c": "x"}, T, 1.0), ({}, T, 1.0), (None, T, 1.0), ({"__name__": "m"}, T, None), ({"c": "y"}, T, 2.0)], "labels map<string,string>, ts_ms bigint, value double")
    assert {(r.metric, r.lkey) for r in ingest.from_labels(df).collect()} == {("m", "c\x02x"), ("", "c\x02y")}


def test_telemetry_histogram_and_refusal(spark):
    attr = [{"key": "p", "value": {"stringValue": "x"}}, {"key": "n", "value": {"intValue": "3"}}]
    h = {"name": "lat", "histogram": {"dataPoints": [{"attributes": attr, "timeUnixNano": str(T * 1_000_000), "count": "6", "sum": 2.5, "bucketCounts": ["1", "2", "3"], "explicitBounds": [0.1, 1]}]}}
    g = {"name": "g", "sum": {"dataPoints": [{"timeUnixNano": str(T * 1_000_000), "asInt": "7"}]}}
    body = lambda m: json.dumps({"resourceMetrics": [{"resource": {"attributes": [{"key": "p", "value": {"stringValue": "resource"}}]}, "scopeMetrics": [{"metrics": m}]}]})
    df = spark.createDataFrame([(body([h, g]),), ("{broken",)], "body string")
    got = {(r.metric, r.lkey.replace("\x02", "=").replace("\x01", ",")): r.value for r in ingest.telemetry(df).collect()}
    assert got == {("lat_bucket", "le=0.1,n=3,p=x"): 1, ("lat_bucket", "le=1,n=3,p=x"): 3, ("lat_bucket", "le=+Inf,n=3,p=x"): 6, ("lat_sum", "n=3,p=x"): 2.5, ("lat_count", "n=3,p=x"): 6, ("g", "p=resource"): 7}
    bad = spark.createDataFrame([(body([{"name": "s", "summary": {"dataPoints": ["1"]}, "gauge": {"dataPoints": [{"timeUnixNano": "1", "asDouble": 1.0}]}}]),)], "body string")
    with pytest.raises(Exception, match="Unsupported metric type"):
        ingest.telemetry(bad).collect()


def test_binary_write_requests(spark):
    series = [{"labels": [{"name": "__name__", "value": "m"}, {"name": "ä", "value": "x" * 300}], "samples": [{"value": 1.5, "timestamp": T}, {"value": float("inf"), "timestamp": -5}]}, {"labels": [{"name": "__name__", "value": "n"}], "samples": []}]
    body = binary.encoded(series)
    assert binary.decoded(body) == [({"__name__": "m", "ä": "x" * 300}, T, 1.5), ({"__name__": "m", "ä": "x" * 300}, -5, float("inf"))]
    plain = binary.decompressed(body)
    assert binary.decoded(plain) == binary.decoded(body) and binary.decoded(plain + binary.chunk(9, b"later")) == binary.decoded(body)
    df = spark.createDataFrame([(bytearray(body),), (bytearray(body[:20]),), (bytearray(b"broken"),), (bytearray(),), (None,)], "body binary")
    assert [(r.metric, r.ts_ms, r.value) for r in binary.remote_write(df).orderBy("ts_ms").collect()] == [("m", -5, float("inf")), ("m", T, 1.5)]
    assert binary.remote_write(df.limit(0)).count() == 0


def test_json_result_types_and_spans(spark):
    e = Engine(spark, rows(spark))
    kind = lambda *a: json.loads(e.to_json(*a))["data"]["resultType"]
    assert (kind("1 + 2", T), kind("m", T + 9000), kind("1", T, T + 1000), kind("scalar(sum(m))", T + 9000)) == ("scalar", "vector", "matrix", "scalar")
    assert json.loads(e.to_json("1 + 2", T))["data"]["result"] == [T / 1000, "3.000000"]
    with pytest.raises(QueryError):
        e.label_names(None, T, T + 86_400_001, max_span_ms=86_400_000)
    assert [r[0] for r in e.label_names(None, T, T + 1000, max_span_ms=86_400_000).collect()] == ["__name__", "s"]


def test_rules(spark):
    src = rows(spark)
    made = []

    def now():
        df = src
        for x in made:
            df = df.unionByName(x)
        return df

    group = [RecordingRule("total", "sum(m)"), RecordingRule("broken", "sum("), RecordingRule("twice", "total * 2", interval_ms=1000)]
    out = run_group(group, T + 9000, now, made.append)
    assert out["total"] is None and out["twice"] is None and out["broken"]
    assert [r.value for r in made[1].collect()] == [34.0] and made[1].collect()[0].metric == "twice"
    assert group[1].failures == 1 and group[1].next_run_ms == T + 11_000 and group[0].next_run_ms == T + 69_000
    assert run_group(group, T + 10_000, now, made.append) == {"twice": None}
    assert [backoff_s(n) for n in (1, 5, 9, 20)] == [2, 32, 300, 300]
    e = Engine(spark, src)
    assert record(e, RecordingRule("r", "m", keep=["s"], drop=["s"]), T + 9000).select("lkey").distinct().count() == 2
    assert record(e, RecordingRule("r", "m", drop=["s"]), T + 9000).select("lkey").distinct().count() == 1
    assert record(e, RecordingRule("r", "m", stale_ms=500), T + 9000).count() == 1


def test_rules_from_text():
    got = parse_rules("# comment\n a | sum by (x) (m{y=~\"1|2\"}) |500\n\nb|1|60000")
    assert [(r.name, r.query, r.interval_ms) for r in got] == [("a", 'sum by (x) (m{y=~"1|2"})', 500), ("b", "1", 60_000)]
    for bad in ("a|b", "a|m|x", "|m|5", "a|m|0", "a|sum(|5"):
        with pytest.raises(QueryError):
            parse_rules(bad)
    rules = parse_drop_rules('m{a="b"}\nsys_*\n')
    assert rules.selectors == ['m{a="b"}'] and rules.prefixes == ["sys_"]
    with pytest.raises(QueryError):
        parse_drop_rules("sum(m)")


def test_repeated_match_keys_on_the_left_are_an_error(spark):
    df = ingest.from_rows(spark, [({"__name__": "a", "x": x, "y": "1"}, T, 1.0) for x in "pq"] + [({"__name__": "b", "y": "1"}, T, 2.0)])
    e = Engine(spark, df)
    with pytest.raises(Exception, match="left side"):
        e.instant("a / on (y) b", T).collect()
    assert e.instant("a / on (y) group_left () b", T).count() == 2


def test_stale_windows_give_no_rule_result(spark):
    e = Engine(spark, rows(spark).unionByName(rows(spark, 3, "old")))
    rule = lambda q: record(e, RecordingRule("r", q, stale_ms=5000), T + 9000)
    assert rule("count_over_time(m[1h])").count() == 2 and rule("count_over_time(old[1h])").count() == 0
    assert rule("sum(rate(old[1h]))").count() == 0 and rule("sum(rate(m[1h]))").count() == 1


def test_only_days_of_small_files_are_compacted(spark, tmp_path):
    p, day = str(tmp_path / "s"), 86_400_000
    store.write(rows(spark, 200).repartition(1), p, 1)
    store.write(rows(spark, 1, start=T + day), p, 2)
    for k in range(3):
        store.write(rows(spark, 5, start=T + 2 * day, add=float(k)), p, 3 + k)
    assert store.compact_small(spark, p, 8) == ["2024-01-03"]
    got = store.read(spark, p)
    assert {str(r.date): r.n for r in got.groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect()} == {"2024-01-01": 200, "2024-01-02": 1, "2024-01-03": 5}
    assert {r.value for r in got.where("date = '2024-01-03'").collect()} == {2.0, 3.0, 4.0, 5.0, 6.0}
    assert store.compact_small(spark, p, 8) == []


def test_index_search(spark):
    g = np.random.default_rng(1)
    centres = g.standard_normal((10, 16))
    x = np.repeat(centres, 60, axis=0) + 0.2 * g.standard_normal((600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as query")
    cells = V.fit_cells(df, 10)
    index = V.indexed(df, cells)
    assert index.count() == 600
    got = {(r.query_id, r.vec_id) for r in V.index_search(index, q, cells, 10, 3).collect()}
    want = {(r.query_id, r.vec_id) for r in V.search(df, q, 10).collect()}
    assert len(got) == 60 and len(got & want) >= 0.9 * len(want)
    assert V.index_search(V.indexed(df.limit(0), cells), q, cells, 10, 3).count() == 0


def test_drop_rules(spark):
    df = rows(spark).unionByName(rows(spark, name="debug_x"))
    kept = DropRules(['m{s="1"}'], ["debug_"]).apply(df)
    assert {(r.metric, r.lkey) for r in kept.collect()} == {("m", "s\x020")}


def test_sketches(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 5.0), ("b", None), ("b", float("nan")), ("b", -1.0)], "k string, v double")
    logs = K.log_buckets(df, "v", 0.01, ["k"])
    q = {r.k: r.value for r in K.log_quantile(logs, 0.5, 0.01, ["k"]).collect()}
    assert q["b"] == 5.0 and q["a"] == pytest.approx(50, rel=0.02)
    fixed = K.fixed_buckets(df, "v", [10, 50, 90], ["k"])
    q = {r.k: r.value for r in K.fixed_quantile(fixed, 0.7, [10, 50, 90], ["k"]).collect()}
    assert q["a"] == pytest.approx(70, abs=1.5)
    assert {r.k: r["count"] for r in K.summary(fixed, ["k"]).collect()} == {"a": 100, "b": 2}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    q = df.where("vec_id = 1").selectExpr("vec_id as query_id", "embedding as query")
    got = {r.vec_id: r.score for r in V.search(df, q, 3).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("d", "e", 0.75), ("c", "d", 0.2)], "src string, dst string, corr double")
    assert {r.node: r.community for r in V.communities(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert V.communities(edges.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = rows(spark, 20)
    df.unionByName(rows(spark, 5)).write.parquet(src)
    stream = spark.readStream.schema("metric string, lkey string, ts_ms bigint, value double").parquet(src)
    live.ingest(live.cleaned(stream).drop("event_time"), out, str(tmp_path / "ck"), [RecordingRule("total", "sum(m)")]).awaitTermination(120)
    got = store.newest(store.read(spark, out))
    assert got.where("metric = 'm'").count() == 20 and [r.value for r in got.where("metric = 'total'").collect()] == [37.0]
    q = live.rolled(spark.readStream.schema("metric string, lkey string, ts_ms bigint, value double").parquet(src), "10 seconds").writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rolled").agg(F.sum("n")).first()[0] == 25


def test_stream_rules_reach_back_and_keep_their_grid(spark, tmp_path):
    src, out, hour = str(tmp_path / "src"), str(tmp_path / "out"), 3_600_000
    schema = "metric string, lkey string, ts_ms bigint, value double"

    def feed(hours):
        spark.createDataFrame([("m", "", T + h * hour, 1.0) for h in hours], schema).coalesce(1).write.mode("append").parquet(src)
        rule = RecordingRule("n", "sum(count_over_time(m[12h]))", interval_ms=hour)
        live.ingest(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck"), [rule]).awaitTermination(120)
        return {(r.ts_ms - T) // hour: r.value for r in store.newest(store.read(spark, out)).where("metric = 'n'").collect()}

    # a range is closed on the left
    assert feed(range(20)) == {h: min(h + 1.0, 13.0) for h in range(20)}
    assert feed(range(20, 24)) == {h: min(h + 1.0, 13.0) for h in range(24)}


def test_label_strings(spark):
    one = spark.createDataFrame([("__name__\x02m\x01a\x021\x01b\x022",)], "k string")
    k = F.col("k")
    r = one.select(L.label(k, "a"), L.label(k, "z"), L.keep(k, ["b"]), L.drop(k, ["a", "__name__"]), L.put(k, "aa", F.lit("x")), L.put(k, "a", F.lit("")), L.put(k, "__name__", F.lit("")), L.to_map(k)).first()
    assert tuple(r) == ("1", "", "b\x022", "b\x022", "__name__\x02m\x01a\x021\x01aa\x02x\x01b\x022", "__name__\x02m\x01b\x022", "a\x021\x01b\x022", {"__name__": "m", "a": "1", "b": "2"})
