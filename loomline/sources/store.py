"""The stored layout: Parquet by day, sorted by metric, series and time, newest write of a time wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.engine import selector_condition
from loomline.plans.syntax import QueryError, Selector, parse
from loomline.runtime import cut

SCHEMA = "metric string, lkey string, ts_ms bigint, value double, written_at bigint, date date"
#: Rows of a file; a sorted file of this size has row groups narrow enough to be skipped by metric.
FILE_ROWS = 20_000_000


def with_day(samples: DataFrame, written_at: int) -> DataFrame:
    return samples.withColumn("written_at", F.lit(written_at).cast("long")).withColumn("date", F.to_date(F.timestamp_millis("ts_ms")))


def write(samples: DataFrame, path: str, written_at: int, mode: str = "append") -> None:
    """Append samples. One shuffle spreads each day over as many files as its rows need."""
    df = with_day(samples, written_at)
    (
        df.repartition("date", F.pmod(F.xxhash64("metric", "lkey"), F.lit(16)))
        .sortWithinPartitions("date", "metric", "lkey", "ts_ms")
        .write.mode(mode)
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#lkey", "true")
        .option("maxRecordsPerFile", FILE_ROWS)
        .partitionBy("date")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def newest(samples: DataFrame) -> DataFrame:
    """One row per series and time, the one written last (ties: the larger value)."""
    keys = [c for c in ("metric", "lkey", "date") if c in samples.columns]
    return samples.groupBy(*keys, "ts_ms").agg(F.max_by("value", F.struct("written_at", "value")).alias("value"), F.max("written_at").alias("written_at"))


def merged(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Recent and demoted samples as one: overlaps are resolved by ``newest``."""
    return newest(hot.unionByName(cold, allowMissingColumns=True))


def compact(spark: SparkSession, path: str, out: str) -> None:
    """Rewrite small files: per day, deduplicated and sorted again."""
    df = newest(read(spark, path))
    df.repartition("date", F.pmod(F.xxhash64("metric", "lkey"), F.lit(16))).sortWithinPartitions("date", "metric", "lkey", "ts_ms").write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("date").parquet(out)


def compact_small(spark: SparkSession, path: str, least_rows: int = FILE_ROWS // 20) -> list[str]:
    """Rewrite, in place, the days whose files hold fewer than ``least_rows`` rows on average; answers these days.

    Days are counted by file first, so days that are well stored are not read again. What is rewritten is
    kept in the checkpoint folder before a day's files are replaced, so no loss of executors can lose it.
    """
    files = spark.read.schema(SCHEMA).parquet(path).groupBy("date", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    days = files.groupBy("date").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows")).where((F.col("files") > 1) & (F.col("rows") < F.col("files") * least_rows))
    small = [r.date for r in days.select("date").orderBy("date").limit(100_000).collect()]  # one date a day of samples
    if small:
        rows = cut(newest(read(spark, path).where(F.col("date").isin(small))))
        spread = rows.join(F.broadcast(rows.groupBy("date").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("parts"))), "date")
        spread = spread.repartition("date", F.pmod(F.xxhash64("metric", "lkey"), F.col("parts"))).drop("parts").sortWithinPartitions("date", "metric", "lkey", "ts_ms")
        spread.select("metric", "lkey", "ts_ms", "value", "written_at", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(path)
    return [str(d) for d in small]


def without(samples: DataFrame, selectors: list[str]) -> DataFrame:
    """Samples of no series that one of the selectors matches (series deletion)."""
    hit = F.lit(False)
    for s in selectors:
        node = parse(s)
        if not isinstance(node, Selector) or node.range_ms is not None:
            raise QueryError("deletion needs plain selectors")
        hit = hit | selector_condition(node.matchers)
    return samples.where(~hit)


def retained(samples: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    """Samples of the retention period; the day condition drops whole partitions."""
    df = samples.where(F.col("ts_ms") >= now_ms - keep_ms)
    return df.where(F.col("date") >= F.to_date(F.timestamp_millis(F.lit(now_ms - keep_ms)))) if "date" in samples.columns else df
