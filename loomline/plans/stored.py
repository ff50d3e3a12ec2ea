"""Queries of the stored layout, telemetry kinds, rules, streams, the engine's own counters and the vector index."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.engine import Engine
from loomline.functions import labels as L
from loomline.operators import vectors as V
from loomline.operators.rules import RecordingRule, parse_drop_rules, parse_rules, record, run_group
from loomline.plans.catalog import AT, BACK, END, ES, SQL_VIEWS, inst
from loomline.plans.more import BOUNDS, HOUR, INSTANT_GRID, cut, events, sql_cut
from loomline.plans.syntax import QueryError
from loomline.runtime import shared_folder
from loomline.sources import binary, ingest, store
from loomline.sources.monitor import JOB, Stats
from loomline.sources.tables import table
from loomline.sources.views import DAY, event_metrics, millis
from loomline.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def label_columns(df: DataFrame, names: list[str]) -> list:
    return [L.label(F.col("lkey"), x).alias(x) for x in names]


# ------------------------------------------------------------------------------------------------ telemetry


def telemetry_body(kind: str, point, name: str):
    metric = F.struct(F.lit(name).alias("name"), F.struct(F.array(point).alias("dataPoints")).alias(kind))
    return F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("body")


def attribute(k: str, v):
    return F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))


@query("SELECT event_type AS kind, 'hits' AS metric, count(*) AS n, sum(user_id)::DOUBLE AS total, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY ALL")
def i_telemetry_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sums with whole-number points."""
    e = table(spark, sf, "events").select(millis("ts").alias("t"), "event_type", "user_id")
    point = F.struct(F.array(attribute("kind", F.col("event_type"))).alias("attributes"), (F.col("t") * 1_000_000).cast("string").alias("timeUnixNano"), F.col("user_id").cast("string").alias("asInt"))
    s = ingest.telemetry(e.select(telemetry_body("sum", point, "hits")))
    return s.groupBy(L.label(F.col("lkey"), "kind").alias("kind"), "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts_ms").alias("last"))


LE_SQL = "CASE " + " ".join(f"WHEN i = {i + 1} THEN '{b:g}'" for i, b in enumerate(BOUNDS)) + " ELSE '+Inf' END"


@query(f"""WITH h AS (SELECT event_type, date_trunc('day', ts) AS d, sum(value) AS s, count(*) AS n, [{', '.join(f'count(*) FILTER (WHERE value <= {b})' for b in BOUNDS)}, count(*)] AS c FROM events GROUP BY ALL),
b AS (SELECT event_type, unnest(c) AS v, unnest(range(1, {len(BOUNDS) + 2})) AS i FROM h)
SELECT 'lat_bucket' AS metric, event_type AS kind, {LE_SQL} AS le, count(*) AS n, sum(v)::DOUBLE AS total FROM b GROUP BY ALL
UNION ALL SELECT 'lat_sum', event_type, '', count(*), {sql_cut('sum(s)', 2)} FROM h GROUP BY ALL UNION ALL SELECT 'lat_count', event_type, '', count(*), sum(n)::DOUBLE FROM h GROUP BY ALL""")
def i_telemetry_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms, a day of an event type each, as cumulative bucket, sum and count series."""
    e = table(spark, sf, "events")
    counts = [F.count(F.when((F.col("value") <= hi) & (F.col("value") > lo), 1)) for lo, hi in zip([float("-inf"), *BOUNDS], [*BOUNDS, float("inf")])]
    h = e.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.array(*[c.cast("string") for c in counts]).alias("c"), F.sum("value").alias("s"), F.count(F.lit(1)).cast("string").alias("n"))
    nano = (F.unix_date("d").cast("long") * DAY * 1_000_000).cast("string")
    point = F.struct(F.array(attribute("kind", F.col("event_type"))).alias("attributes"), nano.alias("timeUnixNano"), F.col("n").alias("count"), F.col("s").alias("sum"), F.col("c").alias("bucketCounts"), F.array(*[F.lit(b) for b in BOUNDS]).alias("explicitBounds"))
    s = ingest.telemetry(h.select(telemetry_body("histogram", point, "lat")))
    return s.groupBy("metric", *label_columns(s, ["kind", "le"])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("total", F.when(F.col("metric") == "lat_sum", cut(F.col("total"), 2)).otherwise(F.col("total")))


def request_bytes(bodies: pd.Series) -> pd.Series:
    """Write requests given as JSON in their binary form."""
    return bodies.map(lambda b: binary.encoded(json.loads(b)["timeseries"]))


@query("SELECT event_type, (user_id % 4)::VARCHAR AS shard, count(*) AS n, floor(sum(value) * 1e2 + 0.4321) / 1e2 AS total, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY ALL")
def i_remote_write_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Write requests in their binary form, a request per event, and one that is broken."""
    e = table(spark, sf, "events").select(millis("ts").alias("t"), "event_type", F.pmod("user_id", F.lit(4)).cast("string").alias("shard"), "value")
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    labels = F.array(pair("__name__", F.lit("ev")), pair("event_type", F.col("event_type")), pair("shard", F.col("shard")))
    body = F.to_json(F.struct(F.array(F.struct(labels.alias("labels"), F.array(F.struct("value", F.col("t").alias("timestamp"))).alias("samples"))).alias("timeseries")))
    sent = e.select(F.pandas_udf(request_bytes, "binary")(body).alias("body")).union(spark.sql("select cast('broken' as binary) as body"))
    s = binary.remote_write(sent)
    return s.groupBy(*label_columns(s, ES)).agg(F.count(F.lit(1)).alias("n"), cut(F.sum("value"), 2).alias("total"), F.max("ts_ms").alias("last"))


@query("SELECT 'event_type' AS label_name UNION ALL SELECT 'shard' UNION ALL SELECT '__name__'")
def m_label_names_match(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "events_total", "event_value_by_user").label_names(['events_total{shard="1"}'], AT - DAY, AT, max_span_ms=DAY)


# ---------------------------------------------------------------------------------------------------- store


def written(spark: SparkSession, sf: str) -> str:
    """A store with three writes: all of event_value, a day of it corrected, and the day after written in small pieces."""
    path = shared_folder(spark, "store")
    all_ = event_metrics(spark, sf, ("event_value",))
    store.write(all_, path, 1)
    for k in range(2):
        later = all_.where((F.col("ts_ms") >= AT + k * DAY) & (F.col("ts_ms") < AT + (k + 1) * DAY))
        store.write(later.withColumn("value", F.col("value") + 1 + k), path, 2 + k)
    return path


STORE_SQL = f"{SQL_VIEWS['event_value']}, kept AS (SELECT event_type, ts_ms, CASE WHEN ts_ms >= {AT} AND ts_ms < {AT + DAY} THEN value + 1 WHEN ts_ms >= {AT + DAY} AND ts_ms < {AT + 2 * DAY} THEN value + 2 ELSE value END AS value FROM event_value)"


@query(f"WITH {SQL_VIEWS['event_value']} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE ts_ms >= {AT} AND ts_ms < {AT + 2 * DAY}) AS again FROM event_value GROUP BY 1")
def w_days(spark: SparkSession, sf: str) -> DataFrame:
    """Samples by the day partition that they were demoted to, and those written a second time."""
    rows = store.read(spark, written(spark, sf))
    return rows.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count(F.when(F.col("written_at") == 1, 1)).alias("n"), F.count(F.when(F.col("written_at") > 1, 1)).alias("again"))


@query(f"WITH {STORE_SQL} SELECT * FROM kept")
def w_newest(spark: SparkSession, sf: str) -> DataFrame:
    return store.newest(store.read(spark, written(spark, sf))).select(L.label(F.col("lkey"), "event_type").alias("event_type"), "ts_ms", "value")


@query(f"WITH {STORE_SQL} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, event_type, count(*) AS n, {sql_cut('sum(value)', 2)} AS total FROM kept GROUP BY 1, 2")
def w_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The store after its small files were rewritten: every sample once, as corrected."""
    path = written(spark, sf)
    store.compact_small(spark, path)
    rows = store.read(spark, path)
    return rows.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), L.label(F.col("lkey"), "event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), cut(F.sum("value"), 2).alias("total"))


@query(f"WITH {INSTANT_GRID}, {STORE_SQL}, x AS (SELECT event_type, arg_max(value, ts_ms) AS value FROM kept WHERE ts_ms > {AT + DAY - BACK} AND ts_ms <= {AT + DAY} GROUP BY 1) SELECT {sql_cut('sum(value)', 3)} AS value FROM x")
def w_query(spark: SparkSession, sf: str) -> DataFrame:
    """A query over the store: its day condition skips whole partitions."""
    rows = store.newest(store.read(spark, written(spark, sf)))
    e = Engine(spark, rows.select("metric", "lkey", "ts_ms", "value", "date"), lookback_ms=BACK)
    return e.instant("sum(event_value)", AT + DAY).select(cut(F.col("value"), 3).alias("value"))


# ---------------------------------------------------------------------------------------------------- rules

RULES = """
# name|query|interval_ms
shard:total|sum by (shard) (events_total)|60000
twice|shard:total * 2|60000
largest|max(twice or shard:total)|30000
"""
TOTALS = f"{INSTANT_GRID}, {SQL_VIEWS['events_total']}, s AS (SELECT shard, sum(value) AS v FROM ({inst('events_total')}) GROUP BY 1)"


@query(f"WITH {TOTALS} SELECT 'shard:total' AS metric, shard, {AT}::BIGINT AS ts_ms, v AS value FROM s UNION ALL SELECT 'twice', shard, {AT}, 2 * v FROM s UNION ALL SELECT 'largest', '', {AT}, max(2 * v) FROM s")
def r_group(spark: SparkSession, sf: str) -> DataFrame:
    """A group of rules from their text, each over what those before it wrote."""
    made = [event_metrics(spark, sf, ("events_total",))]

    def now() -> DataFrame:
        out = made[0]
        for x in made[1:]:
            out = out.unionByName(x)
        return out

    run_group(parse_rules(RULES), AT, now, made.append, BACK)
    rows = made[1]
    for x in made[2:]:
        rows = rows.unionByName(x)
    return rows.select("metric", *label_columns(rows, ["shard"]), "ts_ms", "value")


@query("SELECT n::INT AS failures, least(pow(2, n), 300)::BIGINT AS wait_s FROM (SELECT unnest(range(1, 13)) AS n)")
def r_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """How long a failing rule waits after each failure."""
    rule, at, rows = RecordingRule("broken", "sum("), 0, []
    source = event_metrics(spark, sf, ("events_total",))
    while rule.failures < 12:
        run_group([rule], at, lambda: source, lambda df: None)
        rows.append((rule.failures, (rule.next_run_ms - at) // 1000))
        at = rule.next_run_ms
    return spark.createDataFrame(rows, "failures int, wait_s bigint")


@query(f"WITH {SQL_VIEWS['events_total']} SELECT event_type, shard, count(*) AS n FROM events_total WHERE NOT (event_type = 'click' OR shard = '3') GROUP BY ALL")
def r_drop_text(spark: SparkSession, sf: str) -> DataFrame:
    rules = parse_drop_rules('events_total{event_type="click"}\nevents_total{shard=~"3"}\n\nshard_*')
    kept = rules.apply(event_metrics(spark, sf, ("events_total", "shard_weight")))
    return kept.groupBy(*label_columns(kept, ES)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_VIEWS['event_value_by_user']}, x AS (SELECT event_type, user_id, count(*) AS n, max(ts_ms) AS t FROM event_value_by_user WHERE ts_ms >= {AT - 5 * DAY} AND ts_ms <= {AT} GROUP BY ALL) SELECT event_type, sum(n)::DOUBLE AS value FROM x WHERE t > {AT - 6 * HOUR} GROUP BY 1")
def r_stale_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Stale series give a rule nothing, though their samples lie in its window."""
    rule = RecordingRule("live", "sum by (event_type) (count_over_time(event_value_by_user[5d]))", stale_ms=6 * HOUR)
    out = record(events(spark, sf, "event_value_by_user"), rule, AT)
    return out.select(*label_columns(out, ["event_type"]), "value")


# -------------------------------------------------------------------------------------------------- streams


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # a pattern: the table may be a file
    return stream.select(F.lit("event_value").alias("metric"), F.col("event_type").alias("lkey"), millis("ts").alias("ts_ms"), "value")


@query(f"SELECT event_type, w AS ts_ms, count(*) AS n, {sql_cut('sum(value)', 2)} AS total FROM (SELECT event_type, value, unnest([t - t % {HOUR}, t - t % {HOUR} - {HOUR}]) AS w FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM events)) GROUP BY ALL")
def t_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding windows of two hours, one an hour; every batch writes the windows that it changed."""
    base = shared_folder(spark, "stream")
    out = live.drained(live.rolled(event_stream(spark, sf), "2 hours", "1 hour", late="60 days"), f"{base}/out", f"{base}/state")
    return out.select(F.col("lkey").alias("event_type"), "ts_ms", "n", cut(F.col("total"), 2).alias("total"))


GAP = 30 * 60_000


@query(f"""WITH e AS (SELECT event_type, epoch_us(ts) // 1000 AS t, value FROM events), s AS (SELECT *, sum(CASE WHEN t - p < {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY t) AS k FROM (SELECT *, lag(t) OVER (PARTITION BY event_type ORDER BY t) AS p FROM e))
SELECT event_type, min(t) AS ts_ms, count(*) AS n, {sql_cut('sum(value)', 2)} AS total, max(t) AS last_ms FROM s GROUP BY event_type, k HAVING max(t) + {GAP} <= (SELECT max(t) FROM e) - {DAY}""")
def t_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that are final: appended once the watermark, a day behind, has passed their end."""
    base = shared_folder(spark, "stream")
    out = live.appended(live.sessions(event_stream(spark, sf), "30 minutes", "1 day"), f"{base}/out", f"{base}/state")
    return out.select(F.col("lkey").alias("event_type"), "ts_ms", "n", cut(F.col("total"), 2).alias("total"), "last_ms")


@query("SELECT event_type, count(*) AS n, min(t) AS first, max(t) AS last FROM (SELECT DISTINCT event_type, epoch_us(ts) // 1000 AS t FROM events) GROUP BY 1")
def t_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """A stream in which every event is delivered twice, without the repetitions."""
    base = shared_folder(spark, "stream")
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = live.appended(live.cleaned(twice, "60 days").drop("event_time"), f"{base}/out", f"{base}/state")
    return out.groupBy(F.col("lkey").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))


# ------------------------------------------------------------------------------------------------- monitor


@query(f"SELECT 'engine_queries_total' AS metric, '{JOB}' AS job, 3.0::DOUBLE AS value UNION ALL SELECT 'engine_query_errors_total', '{JOB}', 1.0 UNION ALL SELECT 'engine_query_duration_seconds_bucket', '{JOB}', 3.0")
def d_self_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's counters after three queries, one of them broken, asked by its own language."""
    stats = Stats()
    e = Engine(spark, event_metrics(spark, sf, ("events_total",)), lookback_ms=BACK, stats=stats)
    for text in ("sum(events_total)", "events_total", "sum("):
        try:
            e.instant(text, AT)
        except QueryError:
            pass
    out = Engine(spark, stats.samples(spark, AT)).instant('{__name__=~"engine_queries_total|engine_query_errors_total|engine_query_duration_seconds_bucket",le=~"|.Inf"}', AT)
    return out.select(L.label(F.col("lkey"), L.NAME).alias("metric"), *label_columns(out, ["job"]), "value")


# --------------------------------------------------------------------------------------------------- index

#: These vectors have hardly any clusters, so most cells have to be looked into for a recall of 0.9; clustered ones need few.
CELLS, PROBES, TOP = 32, 24, 10


@query(f"SELECT count(*) AS n_queries, count(*) * {TOP} AS n_found, TRUE AS enough FROM embeddings WHERE vec_id % 100 = 0")
def v_index(spark: SparkSession, sf: str) -> DataFrame:
    """Search by an index of all vectors, and whether it finds at least nine tenths of what the exact search finds."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centres = V.fit_cells(e, CELLS)
    found = V.index_search(V.indexed(e, centres), q, centres, TOP, PROBES).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = V.search(e, q, TOP).select("query_id", "vec_id", F.lit(1).alias("true"))
    both = exact.join(found, ["query_id", "vec_id"], "full")
    return both.agg(F.count_distinct(F.when(F.col("hit") == 1, F.col("query_id"))).alias("n_queries"), F.count("hit").alias("n_found"), (F.count(F.when(F.col("true").isNotNull() & F.col("hit").isNotNull(), 1)) >= 0.9 * F.count("true")).alias("enough"))
