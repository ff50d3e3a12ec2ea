"""Queries of metadata, stored series, ingestion, rules, sketches, vectors and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.engine import Engine
from loomline.functions import labels as L
from loomline.functions.numeric import whole
from loomline.operators import sketches as K
from loomline.operators import vectors as V
from loomline.operators.rules import DropRules, RecordingRule, backfill, record
from loomline.plans.catalog import AT, BACK, CUT, END, ES, RATE, SQL_VIEWS, STEP, TWO, inst, wq
from loomline.plans.problems import INTERVAL_SQL
from loomline.runtime import shared_folder
from loomline.sources import ingest, store
from loomline.sources.tables import series_dims, table
from loomline.sources.views import DAY, T0, event_metrics, millis, stored_samples
from loomline.streaming import live

HOUR = 3_600_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def cut(c, places: int):
    return whole(F.floor)(c * 10.0**places + CUT) / 10.0**places


def sql_cut(c: str, places: int) -> str:
    return f"floor(({c}) * 1e{places} + {CUT}) / 1e{places}"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def events(spark: SparkSession, sf: str, *views: str) -> Engine:
    return Engine(spark, event_metrics(spark, sf, views), lookback_ms=BACK)


# ---------------------------------------------------------------------------------------------- metadata
TS_SQL = "ts AS (SELECT metric, e.key AS k, CASE WHEN e.key = 'env' THEN lower(e.value) ELSE e.value END AS v, series_id FROM (SELECT metric, series_id, unnest(map_entries(labels)) AS e FROM timeseries) WHERE e.value <> '' AND series_id IN (SELECT series_id FROM samples WHERE value IS NOT NULL))"


@query(f"WITH {TS_SQL} SELECT DISTINCT k AS label_name FROM ts UNION SELECT '__name__'")
def m_label_names(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(spark, stored_samples(spark, sf)).label_names()


@query(f"WITH {TS_SQL} SELECT DISTINCT v AS label_value FROM ts WHERE k = 'env'")
def m_label_values(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(spark, stored_samples(spark, sf)).label_values("env")


@query(f"WITH {TS_SQL} SELECT DISTINCT v AS label_value FROM ts WHERE k = 'service' AND metric = 'queue_depth' AND series_id IN (SELECT series_id FROM ts WHERE k = 'env' AND v = 'prod')")
def m_label_values_match(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(spark, stored_samples(spark, sf)).label_values("service", ['queue_depth{env="prod"}'])


@query("SELECT DISTINCT metric AS label_value FROM timeseries WHERE series_id IN (SELECT series_id FROM samples WHERE value IS NOT NULL)")
def m_metric_names(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(spark, stored_samples(spark, sf)).label_values("__name__")


@query("SELECT DISTINCT 'events_total' AS metric, event_type, (user_id % 4)::VARCHAR AS shard FROM events WHERE event_type <> 'view'")
def m_series(spark: SparkSession, sf: str) -> DataFrame:
    s = events(spark, sf, "events_total", "event_value").series(['events_total{event_type!="view"}'])
    return s.select("metric", *[L.label(F.col("lkey"), x).alias(x) for x in ES])


@query(f"WITH {SQL_VIEWS['events_total']} SELECT 'events_total' AS metric, ts_ms, value FROM events_total WHERE event_type = 'click' AND shard = '2' AND ts_ms BETWEEN {T0} AND {END}")
def m_read(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "events_total").read({"__name__": "events_total", "event_type": "click", "shard": "2"}, T0, END).select("metric", "ts_ms", "value")


@query(f"WITH {SQL_VIEWS['events_total']} SELECT event_type, shard, count(*) AS n FROM events_total WHERE NOT (shard = '2' AND event_type LIKE 'c%') GROUP BY ALL")
def m_delete_series(spark: SparkSession, sf: str) -> DataFrame:
    left = store.without(event_metrics(spark, sf, ("events_total",)), ['events_total{shard="2",event_type=~"c.*"}'])
    return left.groupBy(*[L.label(F.col("lkey"), x).alias(x) for x in ES]).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_VIEWS['event_value']} SELECT event_type, ts_ms, CASE WHEN ts_ms >= {AT} THEN value + 1 ELSE value END AS value FROM event_value")
def m_hot_and_cold(spark: SparkSession, sf: str) -> DataFrame:
    cold = event_metrics(spark, sf, ("event_value",))
    hot = cold.where(F.col("ts_ms") >= AT).withColumn("value", F.col("value") + 1)
    both = store.merged(store.with_day(hot, 2), store.with_day(cold, 1))
    return both.select(L.label(F.col("lkey"), "event_type").alias("event_type"), "ts_ms", "value")


@query(f"WITH {SQL_VIEWS['event_value']} SELECT event_type, count(*) AS n FROM event_value WHERE ts_ms >= {END - 7 * DAY} GROUP BY ALL")
def m_retention(spark: SparkSession, sf: str) -> DataFrame:
    kept = store.retained(store.with_day(event_metrics(spark, sf, ("event_value",)), 1), END, 7 * DAY)
    return kept.groupBy(L.label(F.col("lkey"), "event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {INTERVAL_SQL} SELECT iv.series_id, iv.i AS interval_ms FROM iv")
def m_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return series_dims(table(spark, sf, "timeseries")).select("series_id", "interval_ms")


# ------------------------------------------------------------------------------------------- stored series
STORED_SQL = f"""{INTERVAL_SQL},
lab AS (SELECT series_id, arg_min(metric, reg_id) AS metric, arg_min(labels, reg_id) AS l FROM timeseries GROUP BY 1),
stored AS (SELECT s.series_id, metric, l['service'] AS service, l['zone'] AS zone, ts_ms, value FROM (SELECT series_id, ts_ms, arg_max(value, coalesce(ingested_at, TIMESTAMP '1970-01-01')) AS value FROM samples WHERE value IS NOT NULL GROUP BY 1, 2) s JOIN lab USING (series_id)),
grid AS (SELECT unnest(range((SELECT min(ts_ms) - min(ts_ms) % {HOUR} FROM samples), (SELECT max(ts_ms) + 1 FROM samples), {HOUR}))::BIGINT AS step)"""


def over_samples(spark: SparkSession, sf: str, text: str, by: str, places: int) -> DataFrame:
    first, last = table(spark, sf, "samples").agg(F.min("ts_ms"), F.max("ts_ms")).first()
    e = Engine(spark, stored_samples(spark, sf), lookback_ms=300_000)
    out = e.range(text, first - first % HOUR, last, HOUR)
    return e.columns(out, [by]).withColumn("value", cut(F.col("value"), places))


LAGGED = "(SELECT *, lag(value) OVER w AS prev, lag(ts_ms) OVER w AS prev_ts FROM stored WHERE metric = '{m}' WINDOW w AS (PARTITION BY series_id ORDER BY ts_ms))"


@query(f"WITH {STORED_SQL}, x AS (SELECT series_id, service, step, coalesce(sum(CASE WHEN prev_ts >= step - {HOUR} THEN CASE WHEN value < prev THEN value ELSE value - prev END END), 0) AS v FROM {LAGGED.format(m='http_requests_total')} JOIN grid ON ts_ms BETWEEN step - {HOUR} AND step GROUP BY ALL HAVING count(*) >= 2 AND max(ts_ms) > min(ts_ms)) SELECT coalesce(service, '') AS service, step AS ts_ms, {sql_cut('sum(v)', 3)} AS value FROM x GROUP BY 1, 2")
def s_sum_increase(spark: SparkSession, sf: str) -> DataFrame:
    return over_samples(spark, sf, "sum by (service) (increase(http_requests_total[1h]))", "service", 3)


@query(f"WITH {STORED_SQL}, x AS (SELECT series_id, zone, step, count(*) AS v FROM stored JOIN grid ON ts_ms BETWEEN step - {HOUR} AND step WHERE metric = 'node_temperature_celsius' GROUP BY ALL) SELECT coalesce(zone, '') AS zone, step AS ts_ms, max(v)::DOUBLE AS value FROM x GROUP BY 1, 2")
def s_max_count(spark: SparkSession, sf: str) -> DataFrame:
    return over_samples(spark, sf, "max by (zone) (count_over_time(node_temperature_celsius[1h]))", "zone", 1)


@query(f"WITH {STORED_SQL}, x AS (SELECT series_id, service, step, arg_max(value, ts_ms) AS v FROM stored JOIN grid ON ts_ms > step - 300000 AND ts_ms <= step WHERE metric = 'up' GROUP BY ALL) SELECT coalesce(service, '') AS service, step AS ts_ms, {sql_cut('max(v)', 3)} AS value FROM x WHERE NOT isnan(v) GROUP BY 1, 2")
def s_up(spark: SparkSession, sf: str) -> DataFrame:
    return over_samples(spark, sf, "max by (service) (up == up)", "service", 3)


# ------------------------------------------------------------------------------------------------ ingestion


@query("SELECT event_type, (user_id % 4)::VARCHAR AS shard, count(*) AS n, floor(sum(value) * 1e2 + 0.4321) / 1e2 AS total, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY ALL")
def i_remote_write(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(millis("ts").alias("t"), "event_type", F.pmod("user_id", F.lit(4)).cast("string").alias("shard"), "value")
    labels = F.array(F.struct(F.lit("__name__").alias("name"), F.lit("ev").alias("value")), F.struct(F.lit("event_type").alias("name"), F.col("event_type").alias("value")), F.struct(F.lit("shard").alias("name"), F.col("shard").alias("value")))
    body = e.select(F.to_json(F.struct(F.array(F.struct(labels.alias("labels"), F.array(F.struct("value", F.col("t").alias("timestamp"))).alias("samples"))).alias("timeseries"))).alias("body"))
    s = ingest.remote_write(body)
    return s.groupBy(*[L.label(F.col("lkey"), x).alias(x) for x in ES]).agg(F.count(F.lit(1)).alias("n"), cut(F.sum("value"), 2).alias("total"), F.max("ts_ms").alias("last"))


@query("SELECT event_type AS kind, 'gauge_value' AS metric, count(*) AS n, floor(sum(value) * 1e2 + 0.4321) / 1e2 AS total, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY ALL")
def i_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(millis("ts").alias("t"), "event_type", "value")
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    point = F.struct(F.array(attr("kind", F.col("event_type"))).alias("attributes"), (F.col("t") * 1_000_000).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    metric = F.struct(F.lit("gauge_value").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    scope = F.struct(F.struct(F.array(attr("kind", F.lit("scope"))).alias("attributes")).alias("scope"), F.array(metric).alias("metrics"))
    body = e.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.array(attr("kind", F.lit("resource")))).alias("resource"), F.array(scope).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("body"))
    return ingest.telemetry(body).groupBy(L.label(F.col("lkey"), "kind").alias("kind"), "metric").agg(F.count(F.lit(1)).alias("n"), cut(F.sum("value"), 2).alias("total"), F.max("ts_ms").alias("last"))


@query("SELECT 'orders/day' AS metric, o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, floor(sum(o_totalprice) * 1e1 + 0.4321) / 1e1 AS total FROM orders GROUP BY ALL")
def i_columns(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(millis("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_custkey")
    s = ingest.columns(o, "orders/day")
    return s.groupBy("metric", *[L.label(F.col("lkey"), x).alias(x) for x in ("priority", "status")]).agg(F.count(F.lit(1)).alias("n"), cut(F.sum("value"), 1).alias("total"))


@query(f"WITH {SQL_VIEWS['events_total']} SELECT event_type, shard, ts_ms, value FROM events_total WHERE ts_ms BETWEEN {AT - DAY} AND {AT} AND (shard = '1' OR event_type IN ('view', 'click'))")
def i_remote_read(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf, "events_total", "event_value")
    got = e.matching(['events_total{shard="1"}', 'events_total{event_type=~"view|click"}'], AT - DAY, AT)
    return got.select(*[L.label(F.col("lkey"), x).alias(x) for x in ES], "ts_ms", "value")


@query("SELECT fault, count(*) AS n FROM (SELECT CASE WHEN len(map_keys(labels)) = 0 THEN 'no labels' WHEN len(list_filter(map_values(labels), lambda v: v IS NULL OR v = '')) > 0 THEN 'empty label value' END AS fault FROM timeseries) WHERE fault IS NOT NULL GROUP BY 1")
def i_faults(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "timeseries").select("labels", F.unix_millis(F.col("registered_at").cast("timestamp")).alias("ts_ms"), F.lit(1.0).alias("value"))
    return ingest.faults(t).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------------------------------- streams


@query(f"SELECT event_type, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS ts_ms, count(*) AS n, {sql_cut('sum(value)', 2)} AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def t_stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The events read as a stream and rolled up by hour of event time."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a pattern: the table may be a file
    # events of a series within one ms are different events here, so each is a series of its own
    rows = stream.select(F.lit("event_value").alias("metric"), F.col("event_type").alias("lkey"), millis("ts").alias("ts_ms"), "value")
    base = shared_folder(spark, "stream")
    out = live.drained(live.rolled(rows, "1 hour", late="60 days"), f"{base}/out", f"{base}/state")
    return out.select(F.col("lkey").alias("event_type"), "ts_ms", "n", cut(F.col("total"), 2).alias("total"), "low", "high")


# ---------------------------------------------------------------------------------------------------- rules
INSTANT_GRID = f"grid AS (SELECT {AT}::BIGINT AS step)"
RANGE_GRID = f"grid AS (SELECT unnest(range({T0}, {END + 1}, {STEP}))::BIGINT AS step)"


def out(df: DataFrame, labels: list[str], places: int) -> DataFrame:
    return df.select("metric", *[L.label(F.col("lkey"), x).alias(x) for x in labels], "ts_ms", cut(F.col("value"), places).alias("value"))


@query(f"WITH {INSTANT_GRID}, {SQL_VIEWS['events_total']} SELECT 'shard:events:rate12h' AS metric, shard, ts_ms, {sql_cut('sum(value)', 8)} AS value FROM ({wq('events_total', RATE, TWO)}) GROUP BY ALL")
def r_recording(spark: SparkSession, sf: str) -> DataFrame:
    return out(record(events(spark, sf, "events_total"), RecordingRule("shard:events:rate12h", "sum by (shard) (rate(events_total[12h]))"), AT), ["shard"], 8)


@query(f"WITH {RANGE_GRID}, {SQL_VIEWS['events_total']} SELECT 'events:last' AS metric, shard, '' AS event_type, ts_ms, {sql_cut('value', 3)} AS value FROM ({inst('events_total', "event_type = 'view'")})")
def r_backfill_keep(spark: SparkSession, sf: str) -> DataFrame:
    rule = RecordingRule("events:last", 'events_total{event_type="view"}', keep=["shard"], drop=["shard"])
    return out(backfill(events(spark, sf, "events_total"), rule, T0, END, STEP), ["shard", "event_type"], 3)


@query(f"WITH {INSTANT_GRID}, {SQL_VIEWS['event_value']} SELECT 'v' AS metric, ts_ms, {sql_cut('max(value)', 3)} AS value FROM ({inst('event_value').replace(f'step - {BACK}', f'step - {2 * HOUR}')}) GROUP BY ALL")
def r_stale(spark: SparkSession, sf: str) -> DataFrame:
    return out(record(events(spark, sf, "event_value"), RecordingRule("v", "max(event_value)", stale_ms=2 * HOUR), AT), [], 3)


@query(f"WITH {SQL_VIEWS['events_total']} SELECT event_type, shard, count(*) AS n FROM events_total WHERE NOT (event_type = 'view' AND shard = '0') GROUP BY ALL")
def r_drop(spark: SparkSession, sf: str) -> DataFrame:
    kept = DropRules(['events_total{event_type="view",shard="0"}'], ["shard_"]).apply(event_metrics(spark, sf, ("events_total", "shard_weight")))
    return kept.groupBy(*[L.label(F.col("lkey"), x).alias(x) for x in ES]).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------- sketches
BOUNDS = [10.0, 25.0, 50.0, 100.0, 250.0]
FIXED = "fixed AS (SELECT event_type, CASE WHEN value < 10 THEN 0 WHEN value < 25 THEN 1 WHEN value < 50 THEN 2 WHEN value < 100 THEN 3 WHEN value < 250 THEN 4 ELSE 5 END AS bucket, count(*) AS n, min(value) AS vmin, max(value) AS vmax, sum(value) AS vsum FROM events GROUP BY 1, 2)"
LOGS = "logs AS (SELECT event_type, floor(ln(value) / ln(1.02))::INT AS bucket, count(*) AS n, min(value) AS vmin, max(value) AS vmax FROM events WHERE value > 0 GROUP BY 1, 2)"
RUN = "r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER (PARTITION BY event_type) AS total, min(vmin) OVER (PARTITION BY event_type) AS low, max(vmax) OVER (PARTITION BY event_type) AS high FROM {t})"


def daily_parts(spark: SparkSession, sf: str, make) -> DataFrame:
    """Partial sketches per day, merged: what a table of stored partial results would give."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return K.merge(make(e, ["event_type", "day"]), ["event_type"])


@query(f"WITH {FIXED} SELECT event_type, bucket, n FROM fixed")
def k_fixed_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return daily_parts(spark, sf, lambda e, k: K.fixed_buckets(e, "value", BOUNDS, k)).select("event_type", "bucket", "n")


@query(f"WITH {FIXED}, {RUN.format(t='fixed')}, h AS (SELECT *, total * 0.9 AS target FROM r) SELECT event_type, {sql_cut('CASE WHEN bucket = 0 THEN low ELSE [10, 25, 50, 100, 250][bucket] + (CASE WHEN bucket = 5 THEN high ELSE [10, 25, 50, 100, 250][bucket + 1] END - [10, 25, 50, 100, 250][bucket]) * (target - below) / n END', 4)} AS value FROM h WHERE below + n >= target QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY bucket) = 1")
def k_fixed_quantile(spark: SparkSession, sf: str) -> DataFrame:
    q = K.fixed_quantile(daily_parts(spark, sf, lambda e, k: K.fixed_buckets(e, "value", BOUNDS, k)), 0.9, BOUNDS, ["event_type"])
    return q.withColumn("value", cut(F.col("value"), 4))


@query(f"WITH {LOGS}, {RUN.format(t='logs')}, h AS (SELECT *, floor(0.9 * (total - 1)) AS target FROM r) SELECT event_type, {sql_cut('CASE WHEN total = 1 THEN low ELSE pow(1.02, bucket) * (1 + 0.02 * (target - below) / n) END', 4)} AS value FROM h WHERE below <= target AND below + n > target")
def k_log_quantile(spark: SparkSession, sf: str) -> DataFrame:
    q = K.log_quantile(daily_parts(spark, sf, lambda e, k: K.log_buckets(e, "value", 0.02, k)), 0.9, 0.02, ["event_type"])
    return q.withColumn("value", cut(F.col("value"), 4))


@query("SELECT event_type, count(*) AS count, floor(sum(value) * 1e2 + 0.4321) / 1e2 AS sum, min(value) AS min, max(value) AS max FROM events WHERE value > 0 GROUP BY 1")
def k_summary(spark: SparkSession, sf: str) -> DataFrame:
    return K.summary(daily_parts(spark, sf, lambda e, k: K.log_buckets(e, "value", 0.02, k)), ["event_type"]).withColumn("sum", cut(F.col("sum"), 2))


@query(f"SELECT event_type, list_sort(list(value))[1 + floor(0.9 * (count(*) - 1))::INT] AS value, count(*) AS count, floor(sum(value) * 1e2 + 0.4321) / 1e2 AS sum FROM events WHERE epoch_us(ts) // 1000 > {END - 20 * DAY} AND epoch_us(ts) // 1000 <= {END} GROUP BY 1")
def k_window_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts_ms", millis("ts"))
    return K.window_summary(e, "value", "ts_ms", END, 20 * DAY, 0.9, ["event_type"]).withColumn("sum", cut(F.col("sum"), 2))


# -------------------------------------------------------------------------------------------------- vectors
PAIR_SQL = "p AS (SELECT q.vec_id AS query_id, v.vec_id, v.embedding::DOUBLE[] AS a, q.embedding::DOUBLE[] AS b FROM embeddings v CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"


def top(spark: SparkSession, sf: str, metric: str, threshold: float | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.search(e, q, 10, metric, threshold).select("query_id", "vec_id", cut(F.col("score"), 6).alias("score"))


def top_sql(score: str, where: str = "TRUE") -> str:
    return f"WITH {PAIR_SQL} SELECT query_id, vec_id, {sql_cut('s', 6)} AS score FROM (SELECT query_id, vec_id, {score} AS s FROM p) WHERE {where} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10"


@query(top_sql("list_cosine_similarity(a, b)"))
def v_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return top(spark, sf, "cosine")


@query(top_sql("1 / (1 + list_distance(a, b))", "s >= 0.4"))
def v_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return top(spark, sf, "euclidean", 0.4)


@query(top_sql("list_inner_product(a, b)"))
def v_dot(spark: SparkSession, sf: str) -> DataFrame:
    return top(spark, sf, "dot")


@query("WITH c AS (SELECT vec_id, embedding, (SELECT bit_or(CASE WHEN embedding[i + 1] > 0 THEN (1::UBIGINT << i) ELSE 0::UBIGINT END) FROM (SELECT unnest(range(0, 64)) AS i)) AS code FROM embeddings) SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(c.code, q.code))::INT AS distance FROM c CROSS JOIN (SELECT * FROM c WHERE vec_id % 100 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(c.code, q.code)), c.vec_id) <= 10")
def v_hamming(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf, "embeddings").select("vec_id", V.sign_code(F.col("embedding")).alias("code"))
    q = c.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    d = c.crossJoin(F.broadcast(q)).select("query_id", "vec_id", V.hamming(F.col("code"), F.col("q")).alias("distance"))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("k <= 10").drop("k")


@query(f"SELECT vec_id, i::INT AS chunk, {sql_cut('list_avg(embedding[i * 8 + 1:i * 8 + 8]::DOUBLE[])', 6)} AS mean FROM embeddings CROSS JOIN (SELECT unnest(range(0, 8)) AS i)")
def v_quantized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.quantized(F.col("embedding"))).alias("chunk", "mean")).withColumn("mean", cut(F.col("mean"), 6))


@query("WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS e, [list_avg(embedding[(i // 8) * 8 + 1:(i // 8) * 8 + 8]::DOUBLE[]) for i in range(0, 64)] AS c FROM embeddings) " + f"SELECT query_id, vec_id, {sql_cut('s', 6)} AS score FROM (SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(d.c, q.e) AS s FROM d CROSS JOIN (SELECT * FROM d WHERE vec_id % 100 = 0) q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10")
def v_quantized_search(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    back = e.select("vec_id", V.dequantized(V.quantized(F.col("embedding")), F.size("embedding")).alias("embedding"))
    return V.search(back, q, 10).select("query_id", "vec_id", cut(F.col("score"), 6).alias("score"))


@query(f"SELECT vec_id, len(list_filter(embedding::DOUBLE[], lambda x: abs(x) > 0.1))::INT AS kept, {sql_cut('list_sum(list_filter(embedding::DOUBLE[], lambda x: abs(x) > 0.1))', 5)} AS total FROM embeddings")
def v_pruned(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "embeddings").select("vec_id", V.pruned(F.col("embedding")).alias("p"), F.size("embedding").alias("n"))
    total = F.aggregate(V.restored(F.col("p"), F.col("n")), F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", F.size("p").alias("kept"), cut(total, 5).alias("total"))


@query("SELECT label AS concept, count(*) AS n, min(vec_id) AS first FROM embeddings WHERE label IN (1, 3) GROUP BY 1")
def v_lookup(spark: SparkSession, sf: str) -> DataFrame:
    index = V.inverted(table(spark, sf, "embeddings"), "vec_id", "label")
    return index.where(F.col("concept").isin(1, 3)).groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


# --------------------------------------------------------------------------------------------------- graphs
POINTS_SQL = "points AS (SELECT event_type || '/' || (user_id % 4) AS sid, event_type, user_id % 4 AS shard, (epoch_us(ts) // 86400000000)::BIGINT AS t, sum(value) AS x FROM events GROUP BY ALL)"
CORR_SQL = f"{POINTS_SQL}, ids AS (SELECT DISTINCT sid, event_type, shard FROM points), pairs AS (SELECT a.sid AS src, b.sid AS dst FROM ids a JOIN ids b ON a.event_type = b.event_type AND a.shard + 1 = b.shard UNION ALL SELECT a.sid, b.sid FROM ids a JOIN ids b ON a.shard = b.shard AND b.event_type = CASE a.event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'signup' END), j AS (SELECT src, dst, a.t, a.x AS xa, b.x AS xb FROM pairs JOIN points a ON a.sid = src JOIN points b ON b.sid = dst AND b.t = a.t)"
EDGES_SQL = f"{CORR_SQL}, edges AS (SELECT src, dst, coalesce(corr(xa, xb), 0) AS c FROM j GROUP BY ALL)"


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select("event_type", F.pmod("user_id", F.lit(4)).alias("shard"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("t"), "value")
    points = e.groupBy("event_type", "shard", "t").agg(F.sum("value").alias("x")).withColumn("sid", F.concat_ws("/", "event_type", "shard"))
    ids = points.select("sid", "event_type", "shard").distinct()
    other = ids.select(F.col("sid").alias("dst"), F.col("event_type").alias("e2"), F.col("shard").alias("s2"))
    along = ids.join(other, (F.col("event_type") == F.col("e2")) & (F.col("shard") + 1 == F.col("s2")))
    nxt = F.when(F.col("event_type") == "click", "view").when(F.col("event_type") == "view", "signup")
    across = ids.join(other, (F.col("shard") == F.col("s2")) & (nxt == F.col("e2")))
    return points.select("sid", "t", "x"), along.union(across).select(F.col("sid").alias("src"), "dst")


@query(f"WITH {EDGES_SQL} SELECT src, dst, {sql_cut('c', 6)} AS corr FROM edges")
def g_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return V.correlations(*graph(spark, sf)).withColumn("corr", cut(F.col("corr"), 6))


@query(f"WITH {CORR_SQL}, k AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY xa, t) AS ra, row_number() OVER (PARTITION BY src, dst ORDER BY xb, t) AS rb FROM j) SELECT src, dst, {sql_cut('coalesce(corr(ra, rb), 0)', 6)} AS corr FROM k GROUP BY 1, 2")
def g_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return V.correlations(*graph(spark, sf), rank=True).withColumn("corr", cut(F.col("corr"), 6))


BOTH = "b AS (SELECT src, dst, c FROM edges UNION ALL SELECT dst, src, c FROM edges)"


@query(f"WITH {EDGES_SQL}, {BOTH} SELECT dst, {sql_cut('c', 6)} AS corr FROM b WHERE src = 'view/1'")
def g_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return V.neighbours(V.correlations(*graph(spark, sf)), "view/1").withColumn("corr", cut(F.col("corr"), 6))


@query(f"WITH {EDGES_SQL}, {BOTH} SELECT src, dst, {sql_cut('c', 6)} AS corr FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY abs(c) DESC, dst) <= 2")
def g_strongest(spark: SparkSession, sf: str) -> DataFrame:
    return V.strongest(V.correlations(*graph(spark, sf)), 2).select("src", "dst", cut(F.col("corr"), 6).alias("corr"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, {sql_cut('c', 6)} AS corr FROM edges WHERE abs(c) >= 0.1")
def g_compressed(spark: SparkSession, sf: str) -> DataFrame:
    return V.compressed(V.correlations(*graph(spark, sf)), 0.1).withColumn("corr", cut(F.col("corr"), 6))


@query(f"WITH {EDGES_SQL} SELECT src, dst, {sql_cut("CASE WHEN src LIKE 'click/%' THEN 1 ELSE c END", 6)} AS corr FROM edges WHERE NOT dst LIKE 'view/%'")
def g_edited(spark: SparkSession, sf: str) -> DataFrame:
    edges = V.correlations(*graph(spark, sf))
    more = edges.where("src like 'click/%'").withColumn("corr", F.lit(1.0))
    return V.without_edges(V.with_edges(edges, more), edges.where("dst like 'view/%'")).withColumn("corr", cut(F.col("corr"), 6))


@query(f"WITH {EDGES_SQL}, {BOTH} SELECT src AS node, count(*) AS degree FROM b GROUP BY 1 ORDER BY degree DESC, node LIMIT 5")
def g_influential(spark: SparkSession, sf: str) -> DataFrame:
    return V.influential(V.correlations(*graph(spark, sf)), 5)


@query(f"WITH RECURSIVE {EDGES_SQL}, s AS (SELECT src, dst FROM edges WHERE abs(c) > 0.15 UNION SELECT dst, src FROM edges WHERE abs(c) > 0.15), reach AS (SELECT src AS node, src AS other FROM s UNION SELECT r.node, s.dst FROM reach r JOIN s ON r.other = s.src) SELECT node, min(other) AS community FROM reach GROUP BY 1")
def g_communities(spark: SparkSession, sf: str) -> DataFrame:
    return V.communities(V.correlations(*graph(spark, sf)), 0.15)
