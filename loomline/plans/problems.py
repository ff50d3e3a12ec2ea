"""Queries pN_ of the general problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.operators.drift import file_profiles, one_table, schema_changes
from loomline.operators.grid import regular_grid
from loomline.operators.spikes import flag_readings
from loomline.runtime import cut
from loomline.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return flag_readings(table(spark, sf, "samples"), table(spark, sf, "timeseries"), table(spark, sf, "metric_catalog")).select("series_id", "ts_ms")


def p1_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading with its flag and state probabilities."""
    return flag_readings(table(spark, sf, "samples"), table(spark, sf, "timeseries"), table(spark, sf, "metric_catalog"), everything=True)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(table(spark, sf, "raw_blocks")).select("file_id", "change", "field_name", "old_name")


def p3_table(spark: SparkSession, sf: str) -> DataFrame:
    """All readable records in one table, under the names found by the matching."""
    blocks = table(spark, sf, "raw_blocks")
    profiles = file_profiles(blocks)
    return one_table(blocks, cut(schema_changes(blocks, profiles)), profiles)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return regular_grid(table(spark, sf, "samples"), table(spark, sf, "timeseries"), everything=False).select("series_id", "slot_ms")


def p6_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid: smoothed and filled values, their uncertainty, missing flags."""
    return regular_grid(table(spark, sf, "samples"), table(spark, sf, "timeseries"))


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p3_found": p3_found, "p3_table": p3_table, "p6_found": p6_found, "p6_grid": p6_grid}

INTERVAL_SQL = """
iv AS (SELECT series_id, coalesce(max(CASE WHEN si IS NULL THEN NULL ELSE
    coalesce(TRY_CAST(regexp_extract(si, '(?:^|[a-z])([0-9.]+)ms$', 1) AS DOUBLE), 0)
  + coalesce(TRY_CAST(regexp_extract(si, '(?:^|[a-z])([0-9.]+)s$', 1) AS DOUBLE), 0) * 1000
  + coalesce(TRY_CAST(regexp_extract(si, '(?:^|[a-z])([0-9.]+)m(?:[0-9]|$)', 1) AS DOUBLE), 0) * 60000
  + coalesce(TRY_CAST(regexp_extract(si, '(?:^|[a-z])([0-9.]+)h', 1) AS DOUBLE), 0) * 3600000 END), 60000)::BIGINT AS i
  FROM (SELECT series_id, labels['scrape_interval'] AS si FROM timeseries) GROUP BY 1),
counting AS (SELECT series_id, ts_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ts_ms ORDER BY ingested_at DESC NULLS LAST) AS rn FROM samples) WHERE rn = 1)
"""

#: Changes of fields by their definition, with contents compared per series in one spelling.
DRIFT_SQL = r"""WITH readable AS (SELECT file_id, row_no, payload FROM raw_blocks WHERE file_id IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
cells AS (SELECT file_id, row_no, k AS field, json_extract(payload, '$."' || k || '"') AS v FROM (SELECT file_id, row_no, payload, unnest(json_keys(payload)) AS k FROM readable)),
typed AS (SELECT *, v ->> '$' AS s, CASE json_type(v) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'fraction' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind FROM cells WHERE json_type(v) <> 'NULL'),
files AS (SELECT file_id, lag(file_id) OVER (PARTITION BY writer ORDER BY written_at, file_id) AS before FROM (SELECT file_id, min(writer) AS writer, min(written_at) AS written_at FROM raw_blocks WHERE file_id IS NOT NULL GROUP BY 1)),
pairs AS (SELECT * FROM files WHERE before IS NOT NULL),
kinds AS (SELECT file_id, field, CASE WHEN kind = 'integer' AND fractions > 0 THEN 'fraction' ELSE kind END AS kind, sum(n) AS n FROM (SELECT file_id, field, kind, count(*) AS n, sum(count(*) FILTER (WHERE kind = 'fraction')) OVER (PARTITION BY file_id, field) AS fractions FROM typed GROUP BY 1, 2, 3) GROUP BY ALL),
fields AS (SELECT file_id, field, arg_max(kind, (n, -ascii(kind))) AS kind FROM kinds GROUP BY 1, 2),
gone AS (SELECT p.file_id, p.before, f.field, f.kind FROM pairs p JOIN fields f ON f.file_id = p.before WHERE NOT EXISTS (SELECT 1 FROM fields g WHERE g.file_id = p.file_id AND g.field = f.field)),
come AS (SELECT p.file_id, p.before, f.field, f.kind FROM pairs p JOIN fields f ON f.file_id = p.file_id WHERE NOT EXISTS (SELECT 1 FROM fields g WHERE g.file_id = p.before AND g.field = f.field)),
series AS (SELECT file_id, row_no, coalesce(max(s) FILTER (WHERE field = 'series_id'), max(s) FILTER (WHERE field = 'sid'), max(s) FILTER (WHERE field = 'seriesId'), max(s) FILTER (WHERE kind = 'integer' AND TRY_CAST(s AS HUGEINT) > 9007199254740992), '?') AS sid FROM typed GROUP BY 1, 2),
moved AS (SELECT t.* FROM typed t WHERE (file_id, field) IN (SELECT before, field FROM gone UNION ALL SELECT file_id, field FROM come)),
contents AS (SELECT DISTINCT file_id, field, sid, CASE
  WHEN kind = 'object' THEN 'tags:' || array_to_string(list_sort(list_filter(list_transform(json_keys(v), lambda k: k || '=' || (v ->> ('$."' || k || '"'))), lambda x: x IS NOT NULL)), ',')
  WHEN kind = 'array' THEN 'tags:' || array_to_string(list_sort(list_filter(list_transform(v::JSON[], lambda e: CASE json_type(e) WHEN 'VARCHAR' THEN e ->> '$' WHEN 'ARRAY' THEN (e ->> '$[0]') || '=' || (e ->> '$[1]') ELSE coalesce(coalesce(e ->> '$.key', e ->> '$.name', e ->> '$.k', e ->> '$.label') || '=' || coalesce(e ->> '$.value', e ->> '$.v', e ->> '$.val'), json_keys(e)[1] || '=' || (e ->> ('$."' || json_keys(e)[1] || '"'))) END), lambda x: x IS NOT NULL)), ',')
  WHEN regexp_full_match(trim(s), '[^=,]+=[^=,]*(,[^=,]+=[^=,]*)*') THEN 'tags:' || array_to_string(list_sort(string_split(s, ',')), ',')
  WHEN lower(trim(s)) IN ('true', 'false') THEN lower(trim(s))
  WHEN regexp_full_match(trim(s), '0[xX][0-9a-fA-F]{1,8}') THEN (lower(trim(s))::BIGINT)::VARCHAR
  WHEN regexp_full_match(trim(s), '[+-]?[0-9]+') THEN (CASE WHEN trim(s)::HUGEINT BETWEEN -2147483648 AND -1 THEN trim(s)::HUGEINT + 4294967296 ELSE trim(s)::HUGEINT END)::VARCHAR
  WHEN TRY_CAST(trim(s) AS DOUBLE) IS NOT NULL THEN CASE WHEN trim(s)::DOUBLE = floor(trim(s)::DOUBLE) AND abs(trim(s)::DOUBLE) < 1e18 THEN (CASE WHEN trim(s)::DOUBLE BETWEEN -2147483648 AND -1 THEN (trim(s)::DOUBLE)::HUGEINT + 4294967296 ELSE (trim(s)::DOUBLE)::HUGEINT END)::VARCHAR ELSE printf('%.12g', trim(s)::DOUBLE) END
  ELSE 's:' || trim(s) END AS content FROM moved JOIN series USING (file_id, row_no)),
olds AS (SELECT g.file_id, g.field, c.sid, c.content FROM gone g JOIN contents c ON c.file_id = g.before AND c.field = g.field),
news AS (SELECT n.file_id, n.field, c.sid, c.content FROM come n JOIN contents c ON c.file_id = n.file_id AND c.field = n.field),
common AS (SELECT a.file_id, a.field AS a, b.field AS b, count(*) AS n FROM (SELECT DISTINCT file_id, field, sid FROM olds) a JOIN (SELECT DISTINCT file_id, field, sid FROM news) b USING (file_id, sid) GROUP BY ALL),
met AS (SELECT a.file_id, a.field AS a, b.field AS b, count(DISTINCT a.sid) AS met, count(DISTINCT a.content) AS kinds FROM olds a JOIN news b USING (file_id, sid, content) GROUP BY ALL),
renamed AS (SELECT file_id, a, b FROM common JOIN met USING (file_id, a, b) WHERE met >= 0.6 * n AND kinds >= 2 QUALIFY row_number() OVER (PARTITION BY file_id, a ORDER BY met / n DESC, b) = 1 AND row_number() OVER (PARTITION BY file_id, b ORDER BY met / n DESC, a) = 1)
SELECT file_id, 'added' AS change, field AS field_name, '' AS old_name FROM come WHERE (file_id, field) NOT IN (SELECT file_id, b FROM renamed)
UNION ALL SELECT file_id, 'removed', field, '' FROM gone WHERE (file_id, field) NOT IN (SELECT file_id, a FROM renamed)
UNION ALL SELECT file_id, 'renamed', b, a FROM renamed
UNION ALL SELECT p.file_id, 'retyped', n.field, '' FROM pairs p JOIN fields n ON n.file_id = p.file_id JOIN fields o ON o.file_id = p.before AND o.field = n.field WHERE n.kind <> o.kind
UNION ALL SELECT r.file_id, 'retyped', r.b, '' FROM renamed r JOIN come n ON n.file_id = r.file_id AND n.field = r.b JOIN gone g ON g.file_id = r.file_id AND g.field = r.a WHERE n.kind <> g.kind"""

SQL = {
    "p3_found": DRIFT_SQL,
    "p6_found": f"""WITH {INTERVAL_SQL},
slots AS (SELECT DISTINCT c.series_id, c.ts_ms - c.ts_ms % iv.i AS slot, iv.i FROM counting c JOIN iv USING (series_id) WHERE c.value IS NOT NULL AND NOT isnan(c.value)),
gaps AS (SELECT *, lead(slot) OVER (PARTITION BY series_id ORDER BY slot) AS nxt FROM slots)
SELECT series_id, unnest(range(slot + i, nxt, i)) AS slot_ms FROM gaps WHERE nxt - slot > i AND nxt - slot <= 86400000""",
}
