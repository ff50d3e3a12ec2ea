"""Results of the general problems' operators held against exact SQL: each row says what is true, and that the operator has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.problems import INTERVAL_SQL, p1_flags, p3_table, p6_grid

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


KIND_SQL = """kinds AS (SELECT metric, any_value(mtype) AS mtype, any_value(unit) AS unit FROM metric_catalog GROUP BY 1),
bounds AS (SELECT unit, max(lowest) AS lo, min(highest) AS hi FROM metric_catalog GROUP BY 1),
readings AS (SELECT c.series_id, c.ts_ms, c.value, k.mtype, coalesce(isinf(c.value) OR c.value < b.lo OR c.value > b.hi, isinf(c.value)) OR (b.lo IS NOT NULL AND c.value < b.lo) OR (b.hi IS NOT NULL AND c.value > b.hi) AS barred
  FROM counting c LEFT JOIN (SELECT series_id, arg_min(metric, reg_id) AS metric FROM timeseries GROUP BY 1) t USING (series_id) LEFT JOIN kinds k USING (metric) LEFT JOIN bounds b USING (unit) WHERE c.value IS NOT NULL AND NOT isnan(c.value))"""


@query(f"WITH {INTERVAL_SQL}, {KIND_SQL} SELECT series_id, ts_ms FROM readings WHERE barred")
def c1_out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    """Of problem 1, the readings that no source of the unit can have."""
    return p1_flags(spark, sf).where("flag = 'out_of_range'").select("series_id", "ts_ms")


RUNS_SQL = """marked AS (SELECT *, sum(CASE WHEN value = prev THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY ts_ms) AS run FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts_ms) AS prev FROM readings WHERE mtype = 'gauge'{where}))"""


@query(f"""WITH {INTERVAL_SQL}, {KIND_SQL}, {RUNS_SQL.format(where=' AND NOT barred')}, usual AS (SELECT series_id, median(n) AS usual FROM (SELECT series_id, run, count(*) AS n FROM marked GROUP BY 1, 2) GROUP BY 1),
every AS (SELECT *, sum(CASE WHEN value = prev THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY ts_ms) AS run FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts_ms) AS prev FROM readings WHERE mtype = 'gauge'))
SELECT series_id, ts_ms FROM (SELECT *, count(*) OVER (PARTITION BY series_id, run) AS n FROM every) JOIN usual USING (series_id) WHERE n >= 8 AND usual < 4 AND NOT barred""")
def c1_stuck(spark: SparkSession, sf: str) -> DataFrame:
    """Of problem 1, the readings in runs of eight or more equal ones, in sources whose usual run is shorter than four."""
    return p1_flags(spark, sf).where("flag = 'stuck'").select("series_id", "ts_ms")


@query("SELECT DISTINCT file_id, row_no FROM raw_blocks WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'")
def c3_records(spark: SparkSession, sf: str) -> DataFrame:
    """Of problem 3, the records of the one table."""
    return p3_table(spark, sf).select("file_id", "row_no")


@query(f"""WITH {INTERVAL_SQL}, r AS (SELECT c.series_id, c.ts_ms - c.ts_ms % iv.i AS slot, iv.i, count(*) AS n FROM counting c JOIN iv USING (series_id) WHERE c.value IS NOT NULL AND NOT isnan(c.value) GROUP BY ALL),
gaps AS (SELECT *, lead(slot) OVER (PARTITION BY series_id ORDER BY slot) AS nxt FROM r)
SELECT series_id, slot AS slot_ms, n::INT AS n_readings, FALSE AS missing, TRUE AS valued FROM r
UNION ALL SELECT series_id, unnest(range(slot + i, nxt, i)), 0, TRUE, TRUE FROM gaps WHERE nxt - slot > i AND nxt - slot <= 86400000""")
def c6_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Of problem 6, every slot of the grid, how many readings it holds, and that it has a finite value with an uncertainty (before the first finite reading: none)."""
    valued = (F.col("value").isNull() & F.col("sd").isNull()) | (~F.isnan("value") & (F.col("sd") >= 0) & (F.col("sd") < float("inf")))
    return p6_grid(spark, sf).select("series_id", "slot_ms", "n_readings", "missing", valued.alias("valued"))
