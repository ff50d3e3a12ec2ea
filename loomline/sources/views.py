"""Metrics over the test tables: events and orders as label-identified series.

Every view yields (metric, lkey, ts_ms, value); the SQL texts define the same series for DuckDB with
labels as columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import labels as L
from loomline.sources.tables import series_dims, table

BOUNDS = (10, 25, 50, 100, 250)
SHARD_WEIGHTS = {"0": 1.0, "1": 2.0, "2": 4.0, "3": 8.0}
T0 = 1_704_067_200_000
DAY = 86_400_000


def millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def shaped(df: DataFrame, metric: str, **labels: str) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), L.key_of_columns({k: F.col(v) for k, v in labels.items()}).alias("lkey"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("value").cast("double").alias("value"))


def running(rows: DataFrame, keys: list[str], column: str, name: str = "value") -> DataFrame:
    """Running sum of a column by time, per key: within a day by a window, plus the sum of the key's days before.

    No window ever holds more than a day of a key, so a key with most of all rows is spread over its days.
    """
    day = rows.withColumn("day", F.floor(F.col("ts_ms") / DAY))
    inner = Window.partitionBy(*keys, "day").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    before = day.groupBy(*keys, "day").agg(F.sum(column).alias("in_day")).withColumn("before", F.coalesce(F.sum("in_day").over(earlier), F.lit(0)))
    return day.withColumn("so_far", F.sum(column).over(inner)).join(before.drop("in_day"), [*keys, "day"]).withColumn(name, F.col("before") + F.col("so_far")).drop("day", "so_far", "before")


def event_metrics(spark: SparkSession, sf: str, only: tuple[str, ...] = ()) -> DataFrame:
    """event_value, event_value_by_user, events_total, event_amount_total, event_value_bucket, shard_weight."""
    e = table(spark, sf, "events").select("event_id", millis("ts").alias("ts_ms"), "user_id", "event_type", "value", F.pmod("user_id", F.lit(4)).cast("string").alias("shard"))
    at = lambda *keys: e.groupBy(*keys, "ts_ms").agg(F.max_by("value", "event_id").alias("value"))
    sums = e.groupBy("event_type", "shard", "ts_ms").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), *[F.count(F.when(F.col("value") <= b, 1)).alias(f"b{b}") for b in BOUNDS])
    every = {
        "event_value": lambda: shaped(at("event_type"), "event_value", event_type="event_type"),
        "event_value_by_user": lambda: shaped(at("event_type", "user_id"), "event_value_by_user", event_type="event_type", user_id="user_id"),
        "events_total": lambda: shaped(running(sums, ["event_type", "shard"], "n"), "events_total", event_type="event_type", shard="shard"),
        "event_amount_total": lambda: shaped(running(sums, ["event_type", "shard"], "v"), "event_amount_total", event_type="event_type", shard="shard"),
        "event_value_bucket": lambda: buckets(sums),
        "shard_weight": lambda: weights(spark),
    }
    return reduce(DataFrame.unionByName, [every[k]() for k in (only or every)])


def buckets(sums: DataFrame) -> DataFrame:
    per = sums.groupBy("event_type", "ts_ms").agg(*[F.sum(f"b{b}").alias(str(b)) for b in BOUNDS], F.sum("n").alias("+Inf"))
    names = [str(b) for b in BOUNDS] + ["+Inf"]
    long = per.select("event_type", "ts_ms", F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select("event_type", "ts_ms", "x.le", "x.n")
    return shaped(running(long, ["event_type", "le"], "n"), "event_value_bucket", event_type="event_type", le="le")


def weights(spark: SparkSession) -> DataFrame:
    """One constant per shard, six-hourly over 32 days."""
    every = spark.range(T0, T0 + 32 * DAY, DAY // 4).select(F.col("id").alias("ts_ms"))
    rows = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(v).alias("value")) for k, v in SHARD_WEIGHTS.items()])
    return shaped(every.select("ts_ms", F.explode(rows).alias("x")).select("ts_ms", "x.shard", "x.value"), "shard_weight", shard="shard")


def order_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """order_total: the day's order value per priority and status."""
    o = table(spark, sf, "orders").select(millis("o_orderdate").alias("ts_ms"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return shaped(o.groupBy("o_orderpriority", "o_orderstatus", "ts_ms").agg(F.sum("o_totalprice").alias("value")), "order_total", priority="o_orderpriority", status="o_orderstatus")


def stored_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The samples table as series: counting rows only, labels and metric from timeseries, ``env`` in lower case.

    Samples meet their series before the rows that count are chosen, and are grouped by what a series
    is: a selector's conditions on metric and labels thereby reach below that grouping, so that only the
    selected series are shuffled. The series side is broadcast after its size was checked.
    """
    rows = table(spark, sf, "samples").where("value is not null and series_id is not null")
    dims = series_dims(table(spark, sf, "timeseries"))
    lower = F.transform_values("labels", lambda k, v: F.when(k == "env", F.lower(v)).otherwise(v))
    keyed = dims.select("series_id", "metric", L.key_of_map(lower).alias("lkey"))
    joined = rows.select("series_id", "ts_ms", "value", "ingested_at").join(keyed, "series_id")
    counting = joined.groupBy("series_id", "metric", "lkey", "ts_ms").agg(F.max_by("value", F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("value"))
    return counting.select("metric", "lkey", "ts_ms", "value")


SQL_VIEWS = {
    "event_value": "event_value AS (SELECT event_type, (epoch_us(ts) // 1000) AS ts_ms, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)",
    "event_value_by_user": "event_value_by_user AS (SELECT event_type, user_id::VARCHAR AS user_id, (epoch_us(ts) // 1000) AS ts_ms, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3)",
    "events_total": "events_total AS (SELECT event_type, shard, ts_ms, (sum(n) OVER (PARTITION BY event_type, shard ORDER BY ts_ms))::DOUBLE AS value FROM (SELECT event_type, (user_id % 4)::VARCHAR AS shard, (epoch_us(ts) // 1000) AS ts_ms, count(*) AS n FROM events GROUP BY 1, 2, 3))",
    "event_amount_total": "event_amount_total AS (SELECT event_type, shard, ts_ms, sum(n) OVER (PARTITION BY event_type, shard ORDER BY ts_ms) AS value FROM (SELECT event_type, (user_id % 4)::VARCHAR AS shard, (epoch_us(ts) // 1000) AS ts_ms, sum(value) AS n FROM events GROUP BY 1, 2, 3))",
    "event_value_bucket": "event_value_bucket AS (SELECT event_type, le, ts_ms, (sum(n) OVER (PARTITION BY event_type, le ORDER BY ts_ms))::DOUBLE AS value FROM (SELECT event_type, le, (epoch_us(ts) // 1000) AS ts_ms, sum((value <= bound)::INT) AS n FROM events CROSS JOIN (VALUES " + ", ".join(f"('{b}', {b}::DOUBLE)" for b in BOUNDS) + ", ('+Inf', 'inf'::DOUBLE)) AS b(le, bound) GROUP BY 1, 2, 3))",
    "shard_weight": "shard_weight AS (SELECT shard, ts_ms, value FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in SHARD_WEIGHTS.items()) + f") AS w(shard, value) CROSS JOIN (SELECT unnest(range({T0}, {T0 + 32 * DAY}, {DAY // 4})) AS ts_ms))",
    "order_total": "order_total AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, (epoch_us(o_orderdate) // 1000) AS ts_ms, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3)",
}
VIEW_LABELS = {"event_value": ["event_type"], "event_value_by_user": ["event_type", "user_id"], "events_total": ["event_type", "shard"], "event_amount_total": ["event_type", "shard"], "event_value_bucket": ["event_type", "le"], "shard_weight": ["shard"], "order_total": ["priority", "status"]}
