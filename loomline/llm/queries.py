"""Queries pN_ of the problems tagged llm, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import checks
from loomline.llm.distinct import cluster_overlap, distinct_counts, next_day_overlap
from loomline.llm.frequent import frequent_items
from loomline.llm.leaks import leaks
from loomline.llm.lookalike import look_classes, normalized, same_look_pairs
from loomline.llm.packing import containers
from loomline.llm.quantiles import joined, partials
from loomline.llm.sql import SQL
from loomline.sources.tables import table


def p2_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_counts(table(spark, sf, "label_log"))


def p2_next_day(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and Jaccard of the sets of successive days."""
    return next_day_overlap(table(spark, sf, "label_log"))


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and Jaccard of the sets of successive clusters of a tenant."""
    return cluster_overlap(table(spark, sf, "label_log"))


def daily(log: DataFrame) -> DataFrame:
    return log.select(F.date_format("seen_at", "yyyy-MM-dd").alias("day"), "label_name", "label_value", "series_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_items(daily(table(spark, sf, "label_log")), ["day", "label_name"], "label_value", 1, 100).select("day", "label_name", F.col("item").alias("label_value"))


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values with at least 0.1 % of the rows of their label, over all days."""
    return frequent_items(table(spark, sf, "label_log"), ["label_name"], "label_value", 1, 1000, buckets=8192).drop("coarse_bound")


def p4_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series with at least 0.01 % of a day's rows."""
    return frequent_items(daily(table(spark, sf, "label_log")), ["day"], "series_id", 1, 10_000, buckets=32_768).drop("coarse_bound")


def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return joined(partials(table(spark, sf, "samples"), table(spark, sf, "timeseries")), ["metric", "day", "label_name", "label_value"])


def p5_all_days(spark: SparkSession, sf: str) -> DataFrame:
    """The days' partial results joined: percentiles per metric and label value."""
    return joined(partials(table(spark, sf, "samples"), table(spark, sf, "timeseries")), ["metric", "label_name", "label_value"])


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers(table(spark, sf, "documents"))


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a passage of an item, exact or within the error budget."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).where("edits = 0").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_look_pairs(table(spark, sf, "documents"))


def p9_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return normalized(table(spark, sf, "documents"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's class of texts that look the same."""
    return look_classes(table(spark, sf, "documents"))


QUERIES = {"p2_distinct": p2_distinct, "p2_next_day": p2_next_day, "p2_clusters": p2_clusters, "p4_found": p4_found, "p4_values": p4_values, "p4_series": p4_series, "p5_percentiles": p5_percentiles, "p5_all_days": p5_all_days, "p7_containers": p7_containers, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_texts": p9_texts, "p9_classes": p9_classes, **checks.QUERIES}
SQL = SQL | checks.SQL
