"""Loaders that turn what other systems send into samples (metric, lkey, ts_ms, value [, fields])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import labels as L

SAMPLE_COLUMNS = ("metric", "lkey", "ts_ms", "value")


def from_labels(df: DataFrame) -> DataFrame:
    """Rows (labels map with ``__name__``, ts_ms, value [, fields]). Rows without labels or value are refused (left out).

    Defined cases: null or empty label values are absent labels; NaN and infinite values stay.
    """
    key = L.key_of_map(F.map_filter("labels", lambda k, v: k != L.NAME))
    name = F.coalesce(F.col("labels")[L.NAME], F.lit(""))
    rows = df.where(F.col("labels").isNotNull() & F.col("ts_ms").isNotNull() & F.col("value").isNotNull() & (F.size("labels") > 0))
    extra = ["fields"] if "fields" in df.columns else []
    return rows.select(name.alias("metric"), key.alias("lkey"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("value").cast("double").alias("value"), *extra)


WRITE_REQUEST = "timeseries array<struct<labels: array<struct<name: string, value: string>>, samples: array<struct<value: double, timestamp: bigint>>>>"


def remote_write(requests: DataFrame, column: str = "body") -> DataFrame:
    """Write requests as JSON (series with labels and samples) to samples. Unreadable requests are left out."""
    body = requests.select(F.from_json(column, WRITE_REQUEST).alias("r")).select(F.explode("r.timeseries").alias("t"))
    named = body.select(F.filter("t.labels", lambda x: x["name"].isNotNull()).alias("ls"), F.explode("t.samples").alias("s"))
    return from_labels(named.select(F.map_from_entries(F.transform("ls", lambda x: F.struct(x["name"], x["value"]))).alias("labels"), F.col("s.timestamp").alias("ts_ms"), F.col("s.value").alias("value")))


ATTRIBUTES = "array<struct<key: string, value: struct<stringValue: string, boolValue: boolean, intValue: string, doubleValue: double>>>"
POINT = f"struct<attributes: {ATTRIBUTES}, timeUnixNano: string, asDouble: double, asInt: string>"
HISTOGRAM = f"struct<attributes: {ATTRIBUTES}, timeUnixNano: string, count: string, sum: double, bucketCounts: array<string>, explicitBounds: array<double>>"
TELEMETRY = f"resourceMetrics array<struct<resource: struct<attributes: {ATTRIBUTES}>, scopeMetrics: array<struct<scope: struct<attributes: {ATTRIBUTES}>, metrics: array<struct<name: string, gauge: struct<dataPoints: array<{POINT}>>, sum: struct<dataPoints: array<{POINT}>>, histogram: struct<dataPoints: array<{HISTOGRAM}>>, exponentialHistogram: struct<dataPoints: array<string>>, summary: struct<dataPoints: array<string>>>>>>>>"


def attributes(c: Column) -> Column:
    text = lambda v: F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"))
    given = F.coalesce(c, F.array().cast(ATTRIBUTES))
    return F.transform(F.filter(given, lambda x: x["key"].isNotNull() & text(x["value"]).isNotNull()), lambda x: F.struct(x["key"].alias("key"), text(x["value"]).alias("value"))).cast("array<struct<key: string, value: string>>")


def telemetry(payloads: DataFrame, column: str = "body") -> DataFrame:
    """OTLP metrics as JSON to samples.

    Point attributes win over resource attributes, and those over scope attributes. Gauges and sums
    take the double or the integer value; a histogram becomes ``_bucket`` (cumulative, with ``le``),
    ``_sum`` and ``_count`` series. Exponential histograms and summaries are refused with an error.
    """
    m = payloads.select(F.from_json(column, TELEMETRY).alias("r")).select(F.explode("r.resourceMetrics").alias("rm"))
    m = m.select(attributes(F.col("rm.resource.attributes")).alias("ra"), F.explode("rm.scopeMetrics").alias("sm"))
    m = m.select("ra", attributes(F.col("sm.scope.attributes")).alias("sa"), F.explode("sm.metrics").alias("m"))
    refuse = F.when(F.col("m.exponentialHistogram").isNotNull() | F.col("m.summary").isNotNull(), F.raise_error(F.concat(F.lit("Unsupported metric type: "), F.col("m.name"))).cast("string")).otherwise(F.col("m.name"))
    m = m.select("ra", "sa", refuse.alias("name"), F.concat(F.coalesce("m.gauge.dataPoints", F.array().cast(f"array<{POINT}>")), F.coalesce("m.sum.dataPoints", F.array().cast(f"array<{POINT}>"))).alias("points"), F.coalesce("m.histogram.dataPoints", F.array().cast(f"array<{HISTOGRAM}>")).alias("hists"))
    empty = F.map_from_entries(F.array().cast("array<struct<key: string, value: string>>"))

    def labelled(own: Column) -> Column:
        # later lists win over earlier ones
        pairs = F.concat(F.col("sa"), F.col("ra"), attributes(own))
        return F.aggregate(pairs, empty, lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != x["key"]), F.map_from_arrays(F.array(x["key"]), F.array(x["value"]))))

    ms = lambda c: (c.cast("decimal(20,0)") / 1_000_000).cast("long")
    p = m.select("ra", "sa", "name", F.explode("points").alias("p"))
    plain = p.select("name", labelled(F.col("p.attributes")).alias("labels"), ms(F.col("p.timeUnixNano")).alias("ts_ms"), F.coalesce("p.asDouble", F.col("p.asInt").cast("double")).alias("value"))
    h = m.select("ra", "sa", "name", F.explode("hists").alias("h")).select("name", labelled(F.col("h.attributes")).alias("labels"), ms(F.col("h.timeUnixNano")).alias("ts_ms"), "h")
    counts = F.transform("h.bucketCounts", lambda x: x.cast("double"))
    les = F.concat(F.transform("h.explicitBounds", lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))), F.array(F.lit("+Inf")))
    running = F.transform(les, lambda le, i: F.struct(le.alias("le"), F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x).alias("n")))
    b = h.select("name", "labels", "ts_ms", F.explode(running).alias("x"))
    with_le = F.map_concat(F.map_filter("labels", lambda k, v: k != "le"), F.map_from_arrays(F.array(F.lit("le")), F.array(F.col("x.le"))))
    parts = [
        plain,
        b.select(F.concat("name", F.lit("_bucket")).alias("name"), with_le.alias("labels"), "ts_ms", F.col("x.n").alias("value")),
        h.select(F.concat("name", F.lit("_sum")).alias("name"), "labels", "ts_ms", F.col("h.sum").alias("value")),
        h.select(F.concat("name", F.lit("_count")).alias("name"), "labels", "ts_ms", F.col("h.count").cast("double").alias("value")),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    named = F.map_concat(F.map_filter("labels", lambda k, v: k != L.NAME), F.map_from_arrays(F.array(F.lit(L.NAME)), F.array("name")))
    return from_labels(rows.select(named.alias("labels"), "ts_ms", "value"))


def columns(df: DataFrame, path: str = "", ts: str = "timestamp", value: str = "value", tags: str = "tags") -> DataFrame:
    """Column batches: time, value and either a ``tags`` map or loose string columns as labels.

    Rows with null time or value are skipped; the metric name defaults to ``path``.
    """
    if tags in df.columns:
        labels = F.coalesce(F.col(tags), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    else:
        names = [f.name for f in df.schema if f.name not in (ts, value) and f.dataType.simpleString() == "string"]
        labels = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])) if names else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    labels = F.map_filter(labels, lambda k, v: v.isNotNull())
    named = F.when(F.map_contains_key(labels, F.lit(L.NAME)), labels).otherwise(F.map_concat(labels, F.map_from_arrays(F.array(F.lit(L.NAME)), F.array(F.lit(path)))))
    return from_labels(df.select(named.alias("labels"), F.col(ts).alias("ts_ms"), F.col(value).alias("value")))


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(labels dict with ``__name__``, ts_ms, value) tuples; for tests and small literal inputs."""
    return from_labels(spark.createDataFrame(rows, "labels map<string,string>, ts_ms bigint, value double"))


#: Names that the label model allows.
LABEL_NAME = r"^[a-zA-Z_][a-zA-Z0-9_.]*$"
METRIC_NAME = r"^[a-zA-Z_:][a-zA-Z0-9_:.]*$"


def faults(df: DataFrame) -> DataFrame:
    """Rows (labels map, ts_ms, value) that break the model, with the first fault found: for reports before a write."""
    names = F.map_keys("labels")
    metric = F.col("labels")[L.NAME]
    fault = (
        F.when(F.col("labels").isNull() | (F.size("labels") == 0), "no labels")
        .when(F.exists(names, lambda n: ~n.rlike(LABEL_NAME)), "label name")
        .when(metric.isNotNull() & ~metric.rlike(METRIC_NAME), "metric name")
        .when(F.exists(F.map_values("labels"), lambda v: v.isNull() | (v == "")), "empty label value")
        .when(F.col("ts_ms").isNull() | (F.col("ts_ms") < 0), "time")
        .when(F.col("value").isNull(), "no value")
    )
    return df.withColumn("fault", fault).where("fault is not null")
