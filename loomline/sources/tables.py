"""The test tables as DataFrames, and the per-series attributes derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.runtime import ship

DEFAULT_INTERVAL_MS = 60_000

#: Milliseconds of each unit a duration may be spelt with (fixed values).
DURATION_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration such as ``15s``, ``1m0s``, ``0.5m`` or ``60000ms``.

    Null, empty, unreadable and non-positive texts give null.
    """
    t = F.lower(F.trim(text))
    total = F.lit(0.0)
    for unit, ms in DURATION_UNITS.items():
        part = F.regexp_extract(t, rf"(?:^|[a-z])([0-9]+(?:\.[0-9]+)?){unit}(?![a-z])", 1)
        total = total + F.coalesce(part.try_cast("double"), F.lit(0.0)) * ms
    whole = t.rlike(r"^(?:[0-9]+(?:\.[0-9]+)?(?:ms|s|m|h|d|w|y))+$")
    return F.when(whole & (total >= 1), F.round(total).cast("long"))


def series_dims(timeseries: DataFrame) -> DataFrame:
    """One row per series: metric, labels (one registration's map) and nominal interval in ms.

    Registrations of one series differ only in the order of labels; the smallest ``reg_id`` is taken.
    Absent or unreadable intervals become one minute.
    """
    return timeseries.groupBy("series_id").agg(
        F.min_by("metric", "reg_id").alias("metric"),
        F.min_by("labels", "reg_id").alias("labels"),
        F.coalesce(F.max(duration_ms(F.col("labels")["scrape_interval"])), F.lit(DEFAULT_INTERVAL_MS)).alias("interval_ms"),
    )


def unit_bounds(catalog: DataFrame) -> DataFrame:
    """metric, mtype and the physical bounds of its unit; a bound stated by any row of the unit holds for all."""
    units = catalog.groupBy("unit").agg(F.max("lowest").alias("lo"), F.min("highest").alias("hi"))
    return catalog.select("metric", "mtype", "unit").dropDuplicates(["metric"]).join(units, "unit", "left").select("metric", "mtype", "lo", "hi")
