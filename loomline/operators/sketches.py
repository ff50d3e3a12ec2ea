"""Histograms and sketches as grouped counts: buckets add up, so partial results merge by summing.

Groups are bounded by their number of buckets, never by their values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_STATS = ("vmin", "vmax", "vsum", "n")


def fixed_buckets(df: DataFrame, value: str, bounds: list[float], keys: list[str]) -> DataFrame:
    """Counts per bucket: value < bounds[i] picks the first such i, the last bucket is open. Null and NaN are refused (left out)."""
    v = F.col(value)
    edges = sorted(bounds)
    bucket = F.lit(len(edges))
    for i, b in reversed(list(enumerate(edges))):
        bucket = F.when(v < b, i).otherwise(bucket)
    rows = df.where(v.isNotNull() & ~F.isnan(v)).withColumn("bucket", bucket)
    return rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.sum(v).alias("vsum"))


def log_buckets(df: DataFrame, value: str, accuracy: float, keys: list[str]) -> DataFrame:
    """Counts per logarithmic bucket floor(ln v / ln(1 + accuracy)). Values that are not positive are refused (left out)."""
    v = F.col(value)
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (v > 0))
    return rows.withColumn("bucket", F.floor(F.log(v) / math.log1p(accuracy)).cast("int")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.sum(v).alias("vsum"))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum("vsum").alias("vsum"))


def running(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts before each bucket and group totals; a group has as many rows as buckets."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"), F.min("vmin").over(w).alias("low"), F.max("vmax").over(w).alias("high"))


def summary(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("n").alias("count"), F.sum("vsum").alias("sum"), F.min("vmin").alias("min"), F.max("vmax").alias("max"))


def fixed_quantile(parts: DataFrame, q: float, bounds: list[float], keys: list[str]) -> DataFrame:
    """Linear inside the bucket that holds q * n; the first bucket answers the minimum, the top edge is the maximum."""
    edges = sorted(bounds)
    r = running(parts, keys).withColumn("target", F.col("total") * q)
    first = Window.partitionBy(*keys).orderBy("bucket")
    hit = r.where(F.col("before") + F.col("n") >= F.col("target")).withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    low = F.element_at(F.array(*[F.lit(float(b)) for b in edges]), F.greatest(F.col("bucket"), F.lit(1)))
    high = F.when(F.col("bucket") >= len(edges), F.col("high")).otherwise(F.element_at(F.array(*[F.lit(float(b)) for b in edges]), F.least(F.col("bucket") + 1, F.lit(len(edges)))))
    value = F.when(F.col("bucket") == 0, F.col("low")).otherwise(low + (high - low) * (F.col("target") - F.col("before")) / F.col("n"))
    return hit.select(*keys, value.alias("value"))


def log_quantile(parts: DataFrame, q: float, accuracy: float, keys: list[str]) -> DataFrame:
    """Bucket with the rank floor(q (n - 1)), linear inside [(1 + accuracy)**i, (1 + accuracy)**(i + 1)); one value is exact."""
    r = running(parts, keys).withColumn("target", F.floor(F.lit(q) * (F.col("total") - 1)))
    hit = r.where((F.col("before") <= F.col("target")) & (F.col("before") + F.col("n") > F.col("target")))
    g = 1 + accuracy
    low = F.pow(F.lit(g), F.col("bucket"))
    value = F.when(F.col("total") == 1, F.col("low")).otherwise(low + (low * g - low) * (F.col("target") - F.col("before")) / F.col("n"))
    return hit.select(*keys, value.alias("value"))


def window_summary(df: DataFrame, value: str, ts_ms: str, now_ms: int, max_age_ms: int, q: float, keys: list[str]) -> DataFrame:
    """Summary over the last ``max_age_ms``: the value at rank floor(q (n - 1)), count and sum.

    The rank is read from a distributed sort by window over each key's values.
    """
    rows = df.where((F.col(ts_ms) > now_ms - max_age_ms) & (F.col(ts_ms) <= now_ms) & F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    r = counts.select("*", F.coalesce(F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(w).alias("total"), F.sum(F.col(value) * F.col("c")).over(w).alias("vsum"))
    target: Column = F.floor(F.lit(q) * (F.col("total") - 1))
    return r.where((F.col("before") <= target) & (F.col("before") + F.col("c") > target)).select(*keys, F.col(value).alias("value"), F.col("total").alias("count"), F.col("vsum").alias("sum"))
