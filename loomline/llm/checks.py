"""Estimates of the llm operators held against exact counts: each row has the exact figure and whether the stated bound holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.distinct import cluster_overlap, distinct_counts
from loomline.llm.packing import CAPACITY, containers, token_counts
from loomline.llm.quantiles import LABELS, PERCENTS, joined, partials
from loomline.sources.tables import series_dims, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


#: An estimate beyond this many standard errors of the exact count breaks its bound; two registers may be shared in tiny sets.
SIGMAS, SLACK = 5.0, 2.0

IDS_SQL = """ids AS (SELECT strftime(seen_at, '%Y-%m-%d') AS day, tenant, cluster, 'series_id' AS kind, series_id::VARCHAR AS id FROM label_log WHERE series_id IS NOT NULL
  UNION ALL SELECT strftime(seen_at, '%Y-%m-%d'), tenant, cluster, 'label:' || label_name, label_value FROM label_log WHERE label_value <> '' AND label_name IS NOT NULL)"""


def identified(log: DataFrame) -> DataFrame:
    day = F.date_format("seen_at", "yyyy-MM-dd").alias("day")
    series = log.where("series_id is not null").select(day, "tenant", "cluster", F.lit("series_id").alias("kind"), F.col("series_id").cast("string").alias("id"))
    values = log.where("label_value <> '' and label_name is not null").select(day, "tenant", "cluster", F.concat(F.lit("label:"), "label_name").alias("kind"), F.col("label_value").alias("id"))
    return series.unionByName(values)


@query(f"""WITH {IDS_SQL} SELECT kind, concat_ws(',', CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(tenant) = 0 THEN 'tenant' END, CASE WHEN grouping(cluster) = 0 THEN 'cluster' END) AS grouping, day, tenant, cluster, count(DISTINCT id) AS n, TRUE AS within
FROM ids GROUP BY GROUPING SETS ((kind, day, tenant, cluster), (kind, day, tenant), (kind, day, cluster), (kind, tenant, cluster), (kind, day), (kind, tenant), (kind, cluster), (kind))""")
def c2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Of problem 2, exact counts per day, tenant, cluster and combination, and that the estimate keeps its error."""
    log = table(spark, sf, "label_log")
    dims = ["day", "tenant", "cluster"]
    named = lambda d: F.when(F.grouping(d) == 0, F.lit(d))
    exact = identified(log).cube("kind", *dims).agg(F.grouping("kind").alias("no_kind"), F.concat_ws(",", *[named(d) for d in dims]).alias("grouping"), F.count_distinct("id").alias("n")).where("no_kind = 0").drop("no_kind")
    a, b = exact.alias("a"), distinct_counts(log).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("kind", "grouping", *dims)], "full")
    within = F.abs(F.col("distinct_estimate") - F.col("n")) <= SIGMAS * F.col("relative_error") * F.col("n") + SLACK
    return both.select("a.kind", "a.grouping", *[f"a.{d}" for d in dims], "a.n", F.coalesce(within, F.lit(False)).alias("within"))


@query(f"""WITH {IDS_SQL}, sets AS (SELECT DISTINCT kind, tenant, cluster, id FROM ids), names AS (SELECT *, lead(cluster) OVER (PARTITION BY kind, tenant ORDER BY cluster NULLS FIRST) AS next_cluster FROM (SELECT DISTINCT kind, tenant, cluster FROM sets)),
l AS (SELECT n.*, id FROM names n JOIN sets s ON s.kind = n.kind AND s.tenant IS NOT DISTINCT FROM n.tenant AND s.cluster IS NOT DISTINCT FROM n.cluster WHERE next_cluster IS NOT NULL),
r AS (SELECT n.*, id FROM names n JOIN sets s ON s.kind = n.kind AND s.tenant IS NOT DISTINCT FROM n.tenant AND s.cluster = n.next_cluster)
SELECT kind, tenant, cluster, next_cluster, count(*) AS n_union, count(*) FILTER (WHERE sides = 2) AS n_both, TRUE AS union_within, TRUE AS both_within, TRUE AS jaccard_within
FROM (SELECT kind, tenant, cluster, next_cluster, id, count(*) AS sides FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY ALL) GROUP BY ALL""")
def c2_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Of problem 2, exact union and intersection of successive clusters, and that the joint estimates keep their errors."""
    log = table(spark, sf, "label_log")
    found = cluster_overlap(log)
    sets = identified(log).select("kind", "tenant", "cluster", "id").distinct().alias("s")
    names = found.select("kind", "tenant", "cluster", "next_cluster").alias("n")
    side = lambda c: sets.join(names, [F.col("s.kind") == F.col("n.kind"), F.col("s.tenant").eqNullSafe(F.col("n.tenant")), F.col("s.cluster").eqNullSafe(F.col(c))]).select("n.*", "id")
    keys = ["kind", "tenant", "cluster", "next_cluster"]
    ids = side("n.cluster").unionByName(side("n.next_cluster")).groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("sides"))
    exact = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_union"), F.count(F.when(F.col("sides") == 2, 1)).alias("n_both")).alias("a")
    both = exact.join(found.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    near = lambda estimate, true, error, slack: F.abs(F.col(estimate) - true) <= SIGMAS * F.col(error) + slack
    return both.select(*[f"a.{k}" for k in keys], "n_union", "n_both", near("union_estimate", F.col("n_union"), "union_error", SLACK).alias("union_within"), near("intersection_estimate", F.col("n_both"), "intersection_error", SLACK).alias("both_within"), near("jaccard_estimate", F.col("n_both") / F.col("n_union"), "jaccard_error", SLACK / F.col("n_union")).alias("jaccard_within"))


SHARES_SQL = ", ".join(f"({q}::DOUBLE)" for q in PERCENTS)
LABELS_SQL = " UNION ALL ".join(f"SELECT metric, day, '{k}' AS label_name, labels['{k}'] AS label_value FROM c WHERE labels['{k}'] IS NOT NULL" for k in LABELS)


@query(f"""WITH t AS (SELECT series_id, arg_min(metric, reg_id) AS metric, arg_min(labels, reg_id) AS labels FROM timeseries GROUP BY 1),
c AS (SELECT metric, labels, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ts_ms ORDER BY ingested_at DESC NULLS LAST) AS rn FROM samples) JOIN t USING (series_id) WHERE rn = 1 AND value IS NOT NULL AND NOT isnan(value)),
g AS (SELECT metric, day, '' AS label_name, '' AS label_value FROM c UNION ALL {LABELS_SQL})
SELECT metric, day, label_name, label_value, share, count(*) AS n, TRUE AS within FROM g CROSS JOIN (VALUES {SHARES_SQL}) AS s(share) GROUP BY ALL""")
def c5_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Of problem 5, the readings of each group, and that each percentile's rank is within the stated rank error."""
    samples, series = table(spark, sf, "samples"), table(spark, sf, "timeseries")
    keys = ["metric", "day", "label_name", "label_value"]
    found = joined(partials(samples, series), keys)
    last = samples.groupBy("series_id", "ts_ms").agg(F.max_by("value", F.struct(F.col("ingested_at").isNotNull(), "ingested_at")).alias("value")).where("value is not null and not isnan(value)")
    groups = F.explode(F.array_compact(F.array(F.struct(F.lit("").alias("label_name"), F.lit("").alias("label_value")), *[F.when(F.col("labels")[k].isNotNull(), F.struct(F.lit(k).alias("label_name"), F.col("labels")[k].alias("label_value"))) for k in LABELS])))
    rows = last.join(series_dims(series), "series_id").select("metric", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day"), groups.alias("g"), F.col("value").alias("x")).select("metric", "day", "g.*", "x")
    # values are counted where they are, once for all percentiles of their group
    counted = rows.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("k"))
    ranked = counted.join(found, keys).groupBy(*keys, "share").agg(F.first("n").alias("stated"), F.first("rank_error").alias("rank_error"), F.sum("k").alias("n"), F.sum(F.when(F.col("x") < F.col("value"), F.col("k")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("k")).otherwise(0)).alias("upto"))
    want = F.greatest(F.ceil(F.col("share") * F.col("n") - 1e-9), F.lit(1))
    off = F.greatest(F.col("below") + 1 - want, want - F.col("upto"), F.lit(0))
    return ranked.select(*keys, "share", "n", ((off <= F.col("rank_error") * F.col("n") + 1) & (F.col("stated") == F.col("n"))).alias("within"))


@query("SELECT doc_id, TRUE AS whole, TRUE AS fits FROM documents WHERE length(text) > 0")
def c7_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Of problem 7, that every token of a document lies in one container, once, split only beyond the capacity, and no container is too full."""
    docs = table(spark, sf, "documents")
    packed = containers(docs)
    fill = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    pieces = packed.join(fill, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.max("token_end").alias("end"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("token_end") - F.col("token_start")).alias("spans"), F.count_distinct("token_start").alias("starts"), F.max("fill").alias("fill"))
    both = token_counts(docs).where("n_tokens > 0").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).join(pieces, "doc_id", "left")
    whole = (F.col("tokens") == F.col("n")) & (F.col("end") == F.col("n")) & (F.col("spans") == F.col("n")) & (F.col("starts") == F.col("pieces")) & ((F.col("pieces") == 1) == (F.col("n") <= CAPACITY))
    return both.select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce(F.col("fill") <= CAPACITY, F.lit(False)).alias("fits"))
