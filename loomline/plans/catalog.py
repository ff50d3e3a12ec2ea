"""One query per operator of the engine, each with DuckDB SQL over the same tables.

Range queries run on the default grid (30 days in steps of 6 h from 2024-01-01, range 12 h, lookback
6 h); results have labels as columns, ``ts_ms`` and ``value`` rounded alike on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.engine import Engine
from loomline.functions.numeric import whole
from loomline.sources.views import DAY, SQL_VIEWS, T0, VIEW_LABELS, event_metrics, order_metrics

STEP, RANGE, BACK, END = DAY // 4, DAY // 2, DAY // 4, T0 + 30 * DAY
AT = T0 + 20 * DAY
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 5
#: Values are cut to decimal places at a point between the halves, where no decimal number lies.
CUT = 0.4321


def metrics_of(query: str) -> tuple[str, ...]:
    return tuple(v for v in SQL_VIEWS if v != "order_total" and re.search(rf"\b{v}\b", query)) or ("event_value",)


def add(name: str, query: str, labels: list[str], sql: str, instant: bool = False, views: tuple[str, ...] | None = None, places: int = PLACES, span: tuple[int, int, int] = (T0, END, STEP)) -> None:
    used = views or metrics_of(query)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        src = order_metrics(spark, sf) if "order_total" in used else event_metrics(spark, sf, used)
        e = Engine(spark, src, lookback_ms=BACK)
        out = e.instant(query, AT) if instant else e.range(query, *span)
        return e.columns(out, labels).withColumn("value", whole(F.floor)(F.col("value") * 10.0**places + CUT) / 10.0**places)

    grid = f"grid AS (SELECT {AT}::BIGINT AS step)" if instant else f"grid AS (SELECT unnest(range({span[0]}, {span[1] + 1}, {span[2]}))::BIGINT AS step)"
    ctes = ", ".join([grid, *[SQL_VIEWS[v] for v in used]])
    cols = "".join(f"{'name' if x == '__name__' else x}, " for x in labels)
    QUERIES[name] = run
    SQL[name] = f"WITH {ctes} {', ' + sql[6:] if sql.startswith('WITH+ ') else 'SELECT ' + cols + f'ts_ms, floor(value * 1e{places} + {CUT}) / 1e{places} AS value FROM (' + sql + ')'}"


def names(view: str) -> str:
    return ", ".join(VIEW_LABELS[view])


def inst(view: str, where: str = "TRUE", off: int = 0, value: str = "arg_max(value, ts_ms)") -> str:
    """Last sample per series and step."""
    return f"SELECT {names(view)}, step AS ts_ms, {value} AS value FROM {view} JOIN grid ON ts_ms > step - {off + BACK} AND ts_ms <= step - {off} WHERE {where} GROUP BY ALL"


def win(view: str, value: str, having: str = "TRUE", r: int = RANGE, where: str = "TRUE", off: int = 0) -> str:
    """A value over each step's closed window; prev and prev_ts are the sample before."""
    lagged = f"(SELECT *, lag(value) OVER w AS prev, lag(ts_ms) OVER w AS prev_ts FROM {view} WHERE {where} WINDOW w AS (PARTITION BY {names(view)} ORDER BY ts_ms))"
    return f"SELECT {names(view)}, step, step AS ts_out, {value.replace('@start', f'(step - {off + r})')} AS value FROM {lagged} JOIN grid ON ts_ms BETWEEN step - {off + r} AND step - {off} GROUP BY ALL HAVING {having}"


def wq(view: str, value: str, having: str = "TRUE", **k) -> str:
    return f"SELECT {names(view)}, ts_out AS ts_ms, value FROM ({win(view, value, having, **k)})"


GAIN = "coalesce(sum(CASE WHEN prev_ts >= @start THEN CASE WHEN value < prev THEN value ELSE value - prev END END), 0)"
SPAN = "((max(ts_ms) - min(ts_ms)) / 1000.0)"
RATE, TWO = f"{GAIN} / {SPAN}", "count(*) >= 2 AND max(ts_ms) > min(ts_ms)"
ET, ES = ["event_type"], ["event_type", "shard"]
R12 = "[12h]"

# ---------------------------------------------------------------------------------- selectors and matchers
add("q_selector_instant", "event_value", ["__name__", *ET], f"SELECT 'event_value' AS name, * FROM ({inst('event_value')})", instant=True)
add("q_selector_range", "event_value", ["__name__", *ET], f"SELECT 'event_value' AS name, * FROM ({inst('event_value')})")
add("q_selector_offset", "event_value offset 1d", ET, inst("event_value", off=DAY))
add("q_selector_at", f"event_value @ {AT / 1000:.0f}", ET, f"SELECT v.event_type, step AS ts_ms, arg_max(v.value, v.ts_ms) AS value FROM event_value v CROSS JOIN grid WHERE v.ts_ms > {AT - BACK} AND v.ts_ms <= {AT} GROUP BY 1, 2")
add("q_selector_at_end", "event_value @ end()", ET, f"SELECT v.event_type, step AS ts_ms, arg_max(v.value, v.ts_ms) AS value FROM event_value v CROSS JOIN grid WHERE v.ts_ms > {END - BACK} AND v.ts_ms <= {END} GROUP BY 1, 2")
add("q_range_selector", "event_value[12h]", ET, f"SELECT event_type, ts_ms, value FROM event_value WHERE ts_ms BETWEEN {AT - RANGE} AND {AT}", instant=True)
add("q_matcher_equal", 'events_total{event_type="click",shard="1"}', ES, inst("events_total", "event_type = 'click' AND shard = '1'"))
add("q_matcher_not_equal", 'events_total{event_type!="click"}', ES, inst("events_total", "event_type <> 'click'"))
add("q_matcher_regex", 'events_total{event_type=~"cl.*|view",shard=~"[12]"}', ES, inst("events_total", "regexp_full_match(event_type, 'cl.*|view') AND shard IN ('1', '2')"))
add("q_matcher_not_regex", 'events_total{event_type!~"c.*",shard!~"0|3"}', ES, inst("events_total", "NOT regexp_full_match(event_type, 'c.*') AND shard NOT IN ('0', '3')"))
add("q_matcher_absent_label", 'event_value{nope=""}', ET, inst("event_value"))
add("q_matcher_name_regex", '{__name__=~"event_val.*",event_type="view"}', ["__name__", *ET], f"SELECT 'event_value' AS name, * FROM ({inst('event_value', "event_type = 'view'")})", views=("event_value",))
add("q_every_series", 'count by (__name__) ({__name__=~".+"})', ["__name__"], f"SELECT 'event_value' AS name, ts_ms, count(*)::DOUBLE AS value FROM ({inst('event_value')}) GROUP BY ALL UNION ALL SELECT 'shard_weight', ts_ms, count(*)::DOUBLE FROM ({inst('shard_weight')}) GROUP BY ALL", views=("event_value", "shard_weight"))
add("q_literal", "1.5e1", [], "SELECT step AS ts_ms, 15.0 AS value FROM grid", views=("event_value",))
# ---------------------------------------------------------------------------------------- range functions
for n, value, having in (
    ("rate", RATE, TWO), ("increase", GAIN, TWO),
    ("sum_over_time", "sum(value)", "TRUE"), ("avg_over_time", "avg(value)", "TRUE"), ("min_over_time", "min(value)", "TRUE"), ("max_over_time", "max(value)", "TRUE"),
    ("count_over_time", "count(*)::DOUBLE", "TRUE"), ("stddev_over_time", "stddev_pop(value)", "TRUE"), ("stdvar_over_time", "var_pop(value)", "TRUE"),
    ("last_over_time", "arg_max(value, ts_ms)", "TRUE"), ("first_over_time", "arg_min(value, ts_ms)", "TRUE"), ("present_over_time", "1.0::DOUBLE", "TRUE"),
    ("changes", "coalesce(sum(CASE WHEN prev_ts >= @start AND value <> prev THEN 1.0 END), 0)", "TRUE"),
    ("resets", "coalesce(sum(CASE WHEN prev_ts >= @start AND value < prev THEN 1.0 END), 0)", "TRUE"),
    ("idelta", "arg_max(value - prev, ts_ms)", "max(prev_ts) >= any_value(@start)"),
    ("irate", "arg_max(CASE WHEN value < prev THEN value ELSE value - prev END / ((ts_ms - prev_ts) / 1000.0), ts_ms)", "max(prev_ts) >= any_value(@start)"),
    ("delta", "arg_max(value, ts_ms) - arg_min(value, ts_ms)", "count(*) >= 2"),
    ("deriv", "regr_slope(value, (ts_ms - step) / 1000.0)", "count(*) >= 2"),
):
    add(f"q_{n}", f"{n}(event_value{R12})", ET, wq("event_value", value, having.replace("@start", f"(step - {RANGE})")), places=7 if n in ("rate", "irate", "deriv") else 4)
add("q_rate_counter", f"rate(events_total{R12})", ES, wq("events_total", RATE, TWO), places=8)
add("q_increase_counter", f"increase(event_amount_total{R12})", ES, wq("event_amount_total", GAIN, TWO), places=3)
add("q_rate_instant", f"rate(events_total{R12})", ES, wq("events_total", RATE, TWO), instant=True, places=8)
add("q_rate_offset", "rate(events_total[12h] offset 1d)", ES, wq("events_total", RATE, TWO, off=DAY), places=8)
add("q_range_longer_than_step", "sum_over_time(event_value[7d])", ET, wq("event_value", "sum(value)", r=7 * DAY), places=2)
add("q_rate_long_range", "rate(events_total[7d])", ES, wq("events_total", RATE, TWO, r=7 * DAY), places=8)
add("q_quantile_over_time", f"quantile_over_time(0.9, event_value{R12})", ET, wq("event_value", "quantile_cont(value, 0.9)"))
add("q_predict_linear", f"predict_linear(event_value{R12}, 3600)", ET, wq("event_value", "regr_intercept(value, (ts_ms - step) / 1000.0) + regr_slope(value, (ts_ms - step) / 1000.0) * ((max(ts_ms) - any_value(step)) / 1000.0 + 3600)", "count(*) >= 2"), places=3)
add("q_holt_winters", f"holt_winters(event_value{R12}, 0.5, 0.1)", ET, f"""SELECT event_type, ts_out AS ts_ms, list_reduce(list_transform(xs[2:], lambda x: struct_pack(s := x, b := 0.0::DOUBLE)), lambda a, x: struct_pack(s := 0.5 * x.s + 0.5 * (a.s + a.b), b := 0.1 * (0.5 * x.s + 0.5 * (a.s + a.b) - a.s) + 0.9 * a.b), struct_pack(s := xs[1], b := xs[2] - xs[1])).s AS value FROM ({win('event_value', 'list(value ORDER BY ts_ms)', 'count(*) >= 2').replace('AS value FROM', 'AS xs FROM', 1)})""")
add("q_absent_over_time", 'absent_over_time(event_value_by_user{user_id="7",event_type="view"}[12h])', [], f"SELECT step AS ts_ms, 1.0 AS value FROM grid WHERE NOT EXISTS (SELECT 1 FROM event_value_by_user WHERE user_id = '7' AND event_type = 'view' AND ts_ms BETWEEN step - {RANGE} AND step)")
add("q_subquery", "max_over_time(sum(rate(events_total[6h]))[1d:6h])", [], f"SELECT g2.step AS ts_ms, max(v) AS value FROM grid g2 JOIN (SELECT step, sum(value) AS v FROM ({win('events_total', RATE, TWO, r=BACK).replace('JOIN grid', 'JOIN (SELECT unnest(range(' + str(T0 - DAY) + ', ' + str(END + 1) + ', ' + str(STEP) + '))::BIGINT AS step) grid')}) GROUP BY 1) i ON i.step BETWEEN g2.step - {DAY} AND g2.step GROUP BY 1", places=8)
add("q_subquery_uneven", "avg_over_time(event_value[12h:4h])", ET, f"WITH p AS (SELECT step, step - {RANGE} + j * 14400000 AS at FROM grid CROSS JOIN (SELECT unnest(range(0, 4)) AS j)), i AS (SELECT p.step, p.at, v.event_type, arg_max(v.value, v.ts_ms) AS value FROM p JOIN event_value v ON v.ts_ms > p.at - {BACK} AND v.ts_ms <= p.at GROUP BY ALL) SELECT event_type, step AS ts_ms, avg(value) AS value FROM i GROUP BY ALL")
add("q_subquery_increase", "increase(event_value[1d:4h])", ET, f"WITH p AS (SELECT step, step - {DAY} + j * 14400000 AS u FROM grid CROSS JOIN (SELECT unnest(range(0, 7)) AS j)), i AS (SELECT p.step, p.u, v.event_type, arg_max(v.value, v.ts_ms) AS value FROM p JOIN event_value v ON v.ts_ms > p.u - {BACK} AND v.ts_ms <= p.u GROUP BY ALL), d AS (SELECT *, lag(value) OVER (PARTITION BY step, event_type ORDER BY u) AS prev FROM i) SELECT event_type, step AS ts_ms, coalesce(sum(CASE WHEN value < prev THEN value ELSE value - prev END), 0) AS value FROM d GROUP BY ALL HAVING count(*) >= 2", places=3)
# ------------------------------------------------------------------------------------ element-wise functions
PLUS, MINUS = inst("event_value"), inst("event_value").replace("arg_max(value, ts_ms)", "arg_max(value, ts_ms) - 150")
for n, value in (
    ("abs", "abs(value)"), ("ceil", "ceil(value)"), ("floor", "floor(value)"), ("round", "round(value)"), ("sgn", "sign(value)"),
):
    add(f"q_{n}", f"{n}(event_value - 150)", ET, f"SELECT event_type, ts_ms, {value} AS value FROM ({MINUS})")
for n, value in (
    ("sqrt", "sqrt(value)"), ("ln", "ln(value)"), ("log2", "log2(value)"), ("log10", "log10(value)"),
    ("sin", "sin(value)"), ("cos", "cos(value)"), ("tan", "tan(value)"), ("atan", "atan(value)"), ("deg", "degrees(value)"), ("rad", "radians(value)"), ("asinh", "asinh(value)"),
    ("year", "year(make_timestamp((value * 1000000)::BIGINT))::DOUBLE"),
):
    add(f"q_{n}", f"{n}(event_value + 1)", ET, f"SELECT event_type, ts_ms, {value} AS value FROM (SELECT event_type, ts_ms, value + 1 AS value FROM ({PLUS}))", places=4 if n == "tan" else 6)
for n in ("exp", "sinh", "cosh", "tanh"):
    add(f"q_{n}", f"{n}(event_value / 100)", ET, f"SELECT event_type, ts_ms, {n}(value / 100) AS value FROM ({PLUS})", places=4)
for n in ("asin", "acos", "atanh"):
    add(f"q_{n}", f"{n}(event_value / 10000)", ET, f"SELECT event_type, ts_ms, {n}(value / 10000) AS value FROM ({PLUS})", places=8)
add("q_acosh", "acosh(event_value + 1)", ET, f"SELECT event_type, ts_ms, acosh(value + 1) AS value FROM ({PLUS})")
for n, value in (("month", "month(t)"), ("day_of_month", "day(t)"), ("day_of_week", "dayofweek(t)"), ("hour", "hour(t)"), ("minute", "minute(t)"), ("days_in_month", "day(last_day(t))"), ("day_of_year", "dayofyear(t)")):
    add(f"q_{n}", f"{n}(timestamp(event_value))", ET, f"SELECT event_type, ts_ms, {value}::DOUBLE AS value FROM (SELECT event_type, ts_ms, make_timestamp((value * 1000)::BIGINT) AS t FROM ({inst('event_value', value='max(ts_ms)')}))")
add("q_round_to", "round(event_value, 5)", ET, f"SELECT event_type, ts_ms, floor(value / 5 + 0.5) * 5 AS value FROM ({PLUS})")
add("q_pi", "vector(pi())", [], "SELECT step AS ts_ms, pi() AS value FROM grid", views=("event_value",))
add("q_time", "vector(time())", [], "SELECT step AS ts_ms, step / 1000.0 AS value FROM grid", views=("event_value",))
add("q_timestamp", "timestamp(event_value)", ET, inst("event_value", value="max(ts_ms) / 1000.0"))
add("q_clamp", "clamp(event_value, 50, 100)", ET, f"SELECT event_type, ts_ms, greatest(50, least(100, value)) AS value FROM ({PLUS})")
add("q_clamp_min", "clamp_min(event_value, 60)", ET, f"SELECT event_type, ts_ms, greatest(60, value) AS value FROM ({PLUS})")
add("q_clamp_max", "clamp_max(event_value, 60)", ET, f"SELECT event_type, ts_ms, least(60, value) AS value FROM ({PLUS})")
for n in ("sort", "sort_desc"):
    add(f"q_{n}", f"{n}(event_value)", ET, PLUS, instant=True)
for n in ("sort_by_label", "sort_by_label_desc"):
    add(f"q_{n}", f'{n}(event_value, "event_type")', ET, PLUS, instant=True)
add("q_scalar", 'vector(scalar(event_value{event_type="view"}) + 1)', [], f"SELECT step AS ts_ms, coalesce(value + 1, 'nan'::DOUBLE) AS value FROM grid LEFT JOIN ({inst('event_value', "event_type = 'view'")}) ON step = ts_ms".replace("step AS ts_ms, arg_max", "step AS ts_ms, arg_max"))
add("q_absent", 'absent(event_value_by_user{user_id="7",event_type="view"})', [], f"SELECT step AS ts_ms, 1.0 AS value FROM grid WHERE NOT EXISTS (SELECT 1 FROM event_value_by_user WHERE user_id = '7' AND event_type = 'view' AND ts_ms > step - {BACK} AND ts_ms <= step)")
add("q_group_call", "group(event_value)", ET, f"SELECT event_type, ts_ms, 1.0 AS value FROM ({PLUS})")
add("q_label_replace", 'label_replace(event_value, "short", "$1-x", "event_type", "(..).*")', ["event_type", "short"], f"SELECT event_type, event_type[1:2] || '-x' AS short, ts_ms, value FROM ({PLUS})")
add("q_label_replace_nested", 'label_replace(event_value, "event_type", "$2$1", "event_type", "(.)(.*)")', ET, f"SELECT event_type[2:] || event_type[1:1] AS event_type, ts_ms, value FROM ({PLUS})")
add("q_label_join", 'label_join(events_total, "joined", "/", "event_type", "shard")', [*ES, "joined"], f"SELECT event_type, shard, event_type || '/' || shard AS joined, ts_ms, value FROM ({inst('events_total')})")
HQ = """SELECT event_type, ts_ms, CASE WHEN total = 0 THEN 'nan'::DOUBLE WHEN hit.b = 'inf'::DOUBLE THEN list_extract(bs, -2).b ELSE lo + (hit.b - lo) * (rank - under) / nullif(hit.n - under, 0) END AS value FROM (
  SELECT *, list_filter(bs, lambda x: x.n >= rank)[1] AS hit, coalesce(list_extract(list_filter(bs, lambda x: x.n < rank), -1).b, 0) AS lo, coalesce(list_extract(list_filter(bs, lambda x: x.n < rank), -1).n, 0) AS under FROM (
    SELECT *, list_extract(bs, -1).n AS total, list_extract(bs, -1).n * {q} AS rank FROM (
      SELECT event_type, ts_ms, list(struct_pack(b := le::DOUBLE, n := value) ORDER BY le::DOUBLE) AS bs FROM ({inner}) GROUP BY ALL)))"""
add("q_histogram_quantile", f"histogram_quantile(0.9, rate(event_value_bucket{R12}))", ET, HQ.format(q=0.9, inner=wq("event_value_bucket", RATE, TWO).replace("le, ts_out", "replace(le, '+Inf', 'inf') AS le, ts_out")))
add("q_histogram_quantile_sum", f"histogram_quantile(0.5, sum by (le) (rate(event_value_bucket{R12})))", [], "SELECT ts_ms, value FROM (" + HQ.format(q=0.5, inner="SELECT '' AS event_type, le, ts_ms, sum(value) AS value FROM (" + wq("event_value_bucket", RATE, TWO).replace("le, ts_out", "replace(le, '+Inf', 'inf') AS le, ts_out") + ") GROUP BY ALL") + ")")
# ------------------------------------------------------------------------------------------- aggregation
BY_USER = inst("event_value_by_user")
for n, value in (("sum", "sum(value)"), ("avg", "avg(value)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "count(*)::DOUBLE"), ("stddev", "stddev_pop(value)"), ("stdvar", "var_pop(value)"), ("quantile", "quantile_cont(value, 0.7)")):
    arg = "0.7, " if n == "quantile" else ""
    add(f"q_agg_{n}", f"{n} by (event_type) ({arg}event_value_by_user)", ET, f"SELECT event_type, ts_ms, {value} AS value FROM ({BY_USER}) GROUP BY ALL", places=3)
add("q_agg_without", "sum without (user_id) (event_value_by_user)", ET, f"SELECT event_type, ts_ms, sum(value) AS value FROM ({BY_USER}) GROUP BY ALL", places=3)
add("q_agg_all", "sum(event_value_by_user)", [], f"SELECT ts_ms, sum(value) AS value FROM ({BY_USER}) GROUP BY ALL", places=3)
add("q_agg_suffix", "avg(event_value_by_user) by (event_type)", ET, f"SELECT event_type, ts_ms, avg(value) AS value FROM ({BY_USER}) GROUP BY ALL", places=3)
add("q_sum_rate", f"sum by (event_type) (rate(events_total{R12}))", ET, f"SELECT event_type, ts_ms, sum(value) AS value FROM ({wq('events_total', RATE, TWO)}) GROUP BY ALL", places=8)
add("q_topk", "topk(3, event_value_by_user)", ["event_type", "user_id"], f"SELECT * FROM ({BY_USER}) QUALIFY row_number() OVER (PARTITION BY ts_ms ORDER BY value DESC, event_type, user_id) <= 3")
add("q_bottomk", "bottomk by (event_type) (2, event_value_by_user)", ["event_type", "user_id"], f"SELECT * FROM ({BY_USER}) QUALIFY row_number() OVER (PARTITION BY ts_ms, event_type ORDER BY value, event_type, user_id) <= 2")
add("q_topk_sum", "topk(2, sum by (event_type) (event_value_by_user))", ET, f"SELECT * FROM (SELECT event_type, ts_ms, sum(value) AS value FROM ({BY_USER}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ts_ms ORDER BY value DESC, event_type) <= 2", places=3)
add("q_count_values", 'count_values("v", round(event_value_by_user / 100))', ["v"], f"SELECT round(value / 100)::BIGINT::VARCHAR AS v, ts_ms, count(*)::DOUBLE AS value FROM ({BY_USER}) GROUP BY ALL")
# ---------------------------------------------------------------------------------------- binary operators
TOTAL, AMOUNT, WEIGHT = inst("events_total"), inst("event_amount_total"), inst("shard_weight")
for n, op, value in (("add", "+", "value + 7"), ("subtract", "-", "value - 7"), ("multiply", "*", "value * 7"), ("divide", "/", "value / 7"), ("modulo", "%", "fmod(value, 7)"), ("power", "^", "pow(value, 2)")):
    add(f"q_{n}", f"event_value {op} {'2' if op == '^' else '7'}", ET, f"SELECT event_type, ts_ms, {value} AS value FROM ({PLUS})", places=4)
for n, op, sql in (("equal", "==", "="), ("not_equal", "!=", "<>"), ("less", "<", "<"), ("greater", ">", ">"), ("less_equal", "<=", "<="), ("greater_equal", ">=", ">=")):
    add(f"q_compare_{n}", f"floor(event_value / 50) {op} 1", ET, f"SELECT event_type, ts_ms, floor(value / 50) AS value FROM ({PLUS}) WHERE floor(value / 50) {sql} 1")
add("q_compare_bool", "event_value > bool 100", ET, f"SELECT event_type, ts_ms, (value > 100)::INT::DOUBLE AS value FROM ({PLUS})")
add("q_scalar_scalar", "vector(2 ^ 3 ^ 0.5 - -1 % 4 + (3 > bool 2))", [], "SELECT step AS ts_ms, pow(2, pow(3, 0.5)) + 1 + 1 AS value FROM grid", views=("event_value",))
add("q_scalar_vector", "1000 - event_value", ET, f"SELECT event_type, ts_ms, 1000 - value AS value FROM ({PLUS})")
add("q_negate", "-event_value", ET, f"SELECT event_type, ts_ms, -value AS value FROM ({PLUS})")
add("q_one_to_one", "event_amount_total / events_total", ES, f"SELECT a.event_type, a.shard, a.ts_ms, a.value / b.value AS value FROM ({AMOUNT}) a JOIN ({TOTAL}) b USING (event_type, shard, ts_ms)", places=4)
add("q_match_on", "sum by (shard) (event_amount_total) / on (shard) shard_weight", ["shard"], f"SELECT shard, ts_ms, a.value / b.value AS value FROM (SELECT shard, ts_ms, sum(value) AS value FROM ({AMOUNT}) GROUP BY ALL) a JOIN ({WEIGHT}) b USING (shard, ts_ms)", places=3)
add("q_match_ignoring", 'events_total{shard="1"} - ignoring (shard) events_total{shard="2"}', ET, f"SELECT event_type, ts_ms, a.value - b.value AS value FROM (SELECT * FROM ({TOTAL}) WHERE shard = '1') a JOIN (SELECT * FROM ({TOTAL}) WHERE shard = '2') b USING (event_type, ts_ms)")
add("q_group_left", "events_total * on (shard) group_left shard_weight", ES, f"SELECT event_type, shard, ts_ms, a.value * b.value AS value FROM ({TOTAL}) a JOIN ({WEIGHT}) b USING (shard, ts_ms)")
add("q_group_left_include", 'events_total * on (shard) group_left (tier) label_replace(shard_weight, "tier", "t$1", "shard", "(.*)")', [*ES, "tier"], f"SELECT event_type, shard, 't' || shard AS tier, ts_ms, a.value * b.value AS value FROM ({TOTAL}) a JOIN ({WEIGHT}) b USING (shard, ts_ms)")
add("q_group_right", "shard_weight * on (shard) group_right events_total", ES, f"SELECT event_type, shard, ts_ms, a.value * b.value AS value FROM ({TOTAL}) a JOIN ({WEIGHT}) b USING (shard, ts_ms)")
add("q_compare_vectors", "event_amount_total > on (event_type, shard) (events_total * 99)", ES, f"SELECT a.event_type, a.shard, a.ts_ms, a.value FROM ({AMOUNT}) a JOIN ({TOTAL}) b USING (event_type, shard, ts_ms) WHERE a.value > b.value * 99", places=3)
add("q_and", 'events_total and on (shard) (shard_weight > 2)', ES, f"SELECT event_type, shard, ts_ms, a.value FROM ({TOTAL}) a SEMI JOIN (SELECT * FROM ({WEIGHT}) WHERE value > 2) b USING (shard, ts_ms)")
add("q_unless", 'events_total unless on (shard) (shard_weight > 2)', ES, f"SELECT event_type, shard, ts_ms, a.value FROM ({TOTAL}) a ANTI JOIN (SELECT * FROM ({WEIGHT}) WHERE value > 2) b USING (shard, ts_ms)")
add("q_or", 'event_value{event_type="view"} or on () event_value{event_type="click"}', ET, f"SELECT * FROM ({inst('event_value', "event_type = 'view'")}) UNION ALL SELECT * FROM ({inst('event_value', "event_type = 'click'")}) c WHERE NOT EXISTS (SELECT 1 FROM ({inst('event_value', "event_type = 'view'")}) v WHERE v.ts_ms = c.ts_ms)")
# ---------------------------------------------------------------------------------------------- other data
add("q_sum_rate_short", "sum(rate(events_total[6h]))", [], f"SELECT ts_ms, sum(value) AS value FROM ({wq('events_total', RATE, TWO, r=BACK)}) GROUP BY ALL", places=8)
add("q_orders_by_status", "sum by (status) (sum_over_time(order_total[7d]))", ["status"], f"SELECT status, ts_ms, sum(value) AS value FROM ({wq('order_total', 'sum(value)', r=7 * DAY)}) GROUP BY ALL", views=("order_total",), places=1, span=(788_918_400_000, 788_918_400_000 + 2400 * DAY, 30 * DAY))
