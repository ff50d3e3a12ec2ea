"""Syntax tree to one DataFrame plan per query.

A vector is a DataFrame (lkey, step, value): ``step`` is the evaluation time in ms and an instant
query is a grid of one step. Every sample is sent to the grid steps whose window holds it (an
equi-grouping on step, never a BETWEEN join); samples that serve the same steps are aggregated before
they are sent out, so the cost follows samples plus series x steps, not samples x range/step.
Neighbouring samples (for rate and the like) are found inside time buckets at least as long as the
range, so no task sorts a whole series.

Decisions where dialects differ: both lookbacks are open on the left; results carry the evaluation
time; functions drop the metric name, selectors, comparisons, sorts and ``last_over_time`` keep it;
rates are not extrapolated and need two samples; a counter reset counts the new value (option
``reset="sum"``: the sum of old and new).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import labels as L
from loomline.functions import numeric as N
from loomline.plans.syntax import COMPARISONS, SET_OPERATORS, Aggregate, Binary, Call, Negate, Number, QueryError, Selector, Subquery, Text

MAX_STEPS = 1_000_000
SUBQUERY_MS = 60_000
BUCKET_MS = 6 * 3_600_000


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... up to end."""

    start: int
    end: int
    step: int

    @property
    def n(self) -> int:
        return (self.end - self.start) // self.step + 1


@dataclass
class Options:
    lookback_ms: int = 300_000
    reset: str = "new"
    stale_ms: int | None = None  # window functions give nothing where the newest sample of the window is older


@dataclass
class Scalar:
    """A number, or one per step: a column of ``step``, or a DataFrame (step, sval)."""

    value: float | None = None
    by_step: Column | None = None
    df: DataFrame | None = None


@dataclass
class Vector:
    df: DataFrame


@dataclass
class Matrix:
    """Samples (lkey, ts_ms, value) with the window of each step: [step - offset - range, step - offset].

    ``name``: the metric name that all have and that ``lkey`` leaves out.
    """

    df: DataFrame
    range_ms: int
    offset_ms: int
    name: str | None = None
    phase: int = 0  # of a subquery: steps between its points, 0 for stored samples
    at: int | None = None


WINDOW_FUNCTIONS = {
    "rate", "increase", "irate", "idelta", "delta", "deriv", "predict_linear", "holt_winters", "changes", "resets",
    "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "count_over_time", "quantile_over_time",
    "stddev_over_time", "stdvar_over_time", "last_over_time", "first_over_time", "present_over_time", "absent_over_time",
}


def ceil_div(a: Column, b: int) -> Column:
    """Ceiling of a / b in whole numbers, also for negative a."""
    up = a + F.lit(b - 1)
    return F.call_function("div", up - F.pmod(up, F.lit(b)), F.lit(b))


def steps_from(ts: Column, ahead: int, g: Grid) -> Column:
    """Number of the first step at or after ts + ahead."""
    return ceil_div(ts + F.lit(ahead - g.start), g.step).cast("long")


class Compiler:
    def __init__(self, spark: SparkSession, samples: DataFrame, options: Options | None = None):
        self.spark, self.samples, self.options = spark, samples, options or Options()
        if "lkey" not in samples.columns:
            self.samples = samples.withColumn("lkey", L.key_of_map(F.col("labels")))

    # ------------------------------------------------------------------------------------------- entry

    def run(self, node, g: Grid):
        if g.step <= 0 or g.start > g.end:
            raise QueryError("step must be positive and start not after end")
        if g.n > MAX_STEPS:
            raise QueryError(f"more than {MAX_STEPS} steps")
        self.query_grid = g
        return self.compile(node, g)

    def compile(self, node, g: Grid):
        if isinstance(node, Number):
            return Scalar(value=node.value)
        if isinstance(node, Text):
            return node.value
        if isinstance(node, Selector):
            return self.matrix(node, g) if node.range_ms is not None else self.pinned(node, g, self.instant)
        if isinstance(node, Subquery):
            return self.subquery(node, g)
        if isinstance(node, Negate):
            v = self.compile(node.inner, g)
            return self.binary_parts("*", Scalar(value=-1.0), v, None, g)
        if isinstance(node, Aggregate):
            return self.aggregate(node, g)
        if isinstance(node, Binary):
            return self.binary(node, g)
        if isinstance(node, Call):
            return self.call(node, g)
        raise QueryError(f"unknown node {node!r}")

    def vector(self, node, g: Grid) -> DataFrame:
        v = self.compile(node, g)
        if not isinstance(v, Vector):
            raise QueryError("expected an instant vector")
        return v.df

    def number(self, node, g: Grid) -> float:
        v = self.compile(node, g)
        if not isinstance(v, Scalar) or v.value is None:
            raise QueryError("expected a number")
        return v.value

    def text(self, node) -> str:
        if not isinstance(node, Text):
            raise QueryError("expected a string")
        return node.value

    def grid_df(self, g: Grid) -> DataFrame:
        return self.spark.range(g.n).select((F.col("id") * g.step + g.start).alias("step"))

    # --------------------------------------------------------------------------------------- selectors

    def scan(self, s: Selector, after: int, until: int) -> DataFrame:
        """Samples of a selector with after <= ts <= until; the metric and time conditions reach the files."""
        df = self.samples.where((F.col("ts_ms") >= after) & (F.col("ts_ms") <= until))
        if "date" in self.samples.columns:
            day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
            df = df.where((F.col("date") >= day(after)) & (F.col("date") <= day(until)))
        for m in s.matchers:
            if m.name == "__name__":
                df = df.where(L.matches(F.col("metric"), m.op, m.value))
            elif m.name in self.promoted:
                df = df.where(L.matches(F.coalesce(F.col(m.name).cast("string"), F.lit("")), m.op, m.value))
            else:
                df = df.where(L.matches(L.label(F.col("lkey"), m.name), m.op, m.value))
        key = F.col("lkey") if self.one_name(s) is not None else L.named(F.col("lkey"), F.col("metric"))
        return df.select(key.alias("lkey"), "ts_ms", "value")

    @staticmethod
    def one_name(s: Selector) -> str | None:
        """The metric name, if the selector allows one only; it is then left out of the keys until the end."""
        return next((m.value for m in s.matchers if m.name == L.NAME and m.op == "=" and m.value), None)

    @staticmethod
    def renamed(df: DataFrame, name: str | None) -> DataFrame:
        return df if name is None else df.withColumn("lkey", L.named(F.col("lkey"), F.lit(name)))

    @property
    def promoted(self) -> set[str]:
        return set(self.samples.columns) - {"metric", "labels", "lkey", "ts_ms", "value", "fields", "date", "series_id"}

    def fixed_time(self, node) -> int | None:
        if node.at is None:
            return None
        return {"start": self.query_grid.start, "end": self.query_grid.end}.get(node.at) if isinstance(node.at, str) else round(node.at * 1000)

    def pinned(self, node, g: Grid, evaluate) -> Vector:
        """``@``: evaluate once at the fixed time and repeat over the grid."""
        t = self.fixed_time(node)
        if t is None:
            return Vector(evaluate(node, g))
        one = evaluate(node, Grid(t, t, 1)).select("lkey", "value")
        return Vector(one.crossJoin(F.broadcast(self.grid_df(g))).select("lkey", "step", "value"))

    def instant(self, s: Selector, g: Grid) -> DataFrame:
        """Last sample in (step - offset - lookback, step - offset]."""
        back, off = self.options.lookback_ms, s.offset_ms
        df = self.scan(s, g.start - off - back + 1, g.end - off)
        df = df.withColumn("lo", F.greatest(steps_from(F.col("ts_ms"), off, g), F.lit(0)))
        # samples with one first step: the latest serves every step the others do
        df = df.groupBy("lkey", "lo").agg(F.max_by("value", "ts_ms").alias("value"), F.max("ts_ms").alias("ts_ms"))
        if g.n == 1 or back <= g.step:
            at = (F.col("lo") * g.step + g.start).alias("step")
            fits = (F.col("lo") < g.n) & (F.col("ts_ms") > F.col("lo") * g.step + g.start - off - back)
            return self.renamed(df.where(fits).select("lkey", at, "value"), self.one_name(s))
        hi = F.least(steps_from(F.col("ts_ms"), off + back, g) - 1, F.lit(g.n - 1))
        df = df.withColumn("hi", hi).where("lo <= hi").select("lkey", F.explode(F.sequence("lo", "hi")).alias("k"), "ts_ms", "value")
        df = df.groupBy("lkey", "k").agg(F.max_by("value", "ts_ms").alias("value")).select("lkey", (F.col("k") * g.step + g.start).alias("step"), "value")
        return self.renamed(df, self.one_name(s))

    def matrix(self, s: Selector, g: Grid) -> Matrix:
        t = self.fixed_time(s)
        a, b = (g.start, g.end) if t is None else (t, t)
        return Matrix(self.scan(s, a - s.offset_ms - s.range_ms, b - s.offset_ms), s.range_ms, s.offset_ms, self.one_name(s), at=t)

    def subquery(self, q: Subquery, g: Grid) -> Matrix:
        """Points step - offset - range + j * resolution of each step; one inner grid holds them all."""
        res = q.resolution_ms or SUBQUERY_MS
        t = self.fixed_time(q)
        a, b = (g.start, g.end) if t is None else (t, t)
        stride = res if a == b else math.gcd(g.step, res)
        first = a - q.offset_ms - q.range_ms
        inner = self.compile(q.inner, Grid(first, first + (b - q.offset_ms - first) // stride * stride, stride))
        if isinstance(inner, Scalar):
            inner = Vector(self.spread_scalar(inner, Grid(first, first + (b - q.offset_ms - first) // stride * stride, stride)))
        if not isinstance(inner, Vector):
            raise QueryError("a subquery needs an instant vector")
        return Matrix(inner.df.select("lkey", F.col("step").alias("ts_ms"), "value"), q.range_ms, q.offset_ms, phase=0 if stride == res else res, at=t)

    # --------------------------------------------------------------------------------- window functions

    def reach(self, m: Matrix, g: Grid) -> tuple[Column, Column]:
        lo = F.greatest(steps_from(F.col("ts_ms"), m.offset_ms, g), F.lit(0))
        hi = F.least(steps_from(F.col("ts_ms"), m.offset_ms + m.range_ms + 1, g) - 1, F.lit(g.n - 1))
        return lo, hi

    def fan(self, m: Matrix, g: Grid, df: DataFrame, *keep: str) -> DataFrame:
        """Rows sent to every step (column k) whose window holds their ts_ms."""
        lo, hi = self.reach(m, g)
        df = df.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").select("lkey", F.explode(F.sequence("lo", "hi")).alias("k"), "ts_ms", *keep)
        return self.in_phase(m, g, df.withColumn("res", F.pmod("ts_ms", F.lit(m.phase)))).drop("res") if m.phase else df

    @staticmethod
    def in_phase(m: Matrix, g: Grid, df: DataFrame) -> DataFrame:
        """Of a subquery's points (res: time modulo its resolution), those that step k asks for."""
        return df.where(F.pmod(F.col("k") * g.step + (g.start - m.offset_ms - m.range_ms), F.lit(m.phase)) == F.col("res")) if m.phase else df

    def neighbours(self, m: Matrix) -> DataFrame:
        """Samples with the one before (prev_ts, prev), as far as one window can hold both."""
        width = max(4 * m.range_ms, BUCKET_MS)  # at most a quarter of the samples is sent twice
        bucket = (F.col("ts_ms") - F.pmod("ts_ms", F.lit(width))) / F.lit(width)
        late = F.pmod("ts_ms", F.lit(width)) >= width - m.range_ms
        to = F.when(late, F.array(F.struct(bucket.cast("long").alias("b"), F.lit(True).alias("home")), F.struct((bucket.cast("long") + 1).alias("b"), F.lit(False).alias("home")))).otherwise(F.array(F.struct(bucket.cast("long").alias("b"), F.lit(True).alias("home"))))
        rows = m.df.select("lkey", "ts_ms", "value", F.explode(to).alias("to")).select("lkey", "ts_ms", "value", "to.b", "to.home")
        # points of a subquery are neighbours only if they belong to the same steps
        rows = rows.withColumn("res", F.pmod("ts_ms", F.lit(m.phase)) if m.phase else F.lit(0).cast("long"))
        w = Window.partitionBy("lkey", "b", "res").orderBy("ts_ms")
        return rows.withColumn("prev_ts", F.lag("ts_ms").over(w)).withColumn("prev", F.lag("value").over(w)).where("home").drop("home")

    def window(self, name: str, m: Matrix, g: Grid, extra: list) -> DataFrame:
        """lkey (with name), step, value of a function over each step's window."""
        if m.at is not None:
            one = self.window(name, Matrix(m.df, m.range_ms, m.offset_ms, m.name, m.phase), Grid(m.at, m.at, 1), extra).select("lkey", "value")
            return one.crossJoin(F.broadcast(self.grid_df(g))).select("lkey", "step", "value")
        if self.options.stale_ms is not None:
            return self.fresh(name, m, g, extra)
        out = self.paired(name, m, g) if name in ("rate", "increase", "changes", "resets", "irate", "idelta") else self.plain(name, m, g, extra)
        return out.select("lkey", (F.col("k") * g.step + g.start).alias("step"), "value")

    def fresh(self, name: str, m: Matrix, g: Grid, extra: list) -> DataFrame:
        """As ``window``, where the newest sample of the window is at most ``stale_ms`` older than the step."""
        plain = Compiler(self.spark, self.samples, replace(self.options, stale_ms=None)).window(name, m, g, extra)
        newest = self.fan(m, g, m.df).groupBy("lkey", "k").agg(F.max("ts_ms").alias("t")).select("lkey", (F.col("k") * g.step + g.start).alias("step"), "t")
        young = newest.where(F.col("t") > F.col("step") - F.lit(m.offset_ms + self.options.stale_ms))
        return plain.join(young.select("lkey", "step"), ["lkey", "step"], "left_semi").select("lkey", "step", "value")

    def paired(self, name: str, m: Matrix, g: Grid) -> DataFrame:
        v, p = F.col("value"), F.col("prev")
        reset = v if self.options.reset == "new" else p + v
        gain = {
            "rate": F.when(v < p, reset).otherwise(v - p),
            "changes": (~(F.isnan(v) & F.isnan(p)) & (N.compare("!=", v, p))).cast("double"),
            "resets": N.compare("<", v, p).cast("double"),
            "irate": F.when(v < p, v).otherwise(v - p),
            "idelta": v - p,
        }["rate" if name == "increase" else name]
        rows = self.neighbours(m).withColumn("gain", gain)
        lo, hi = self.reach(m, g)
        # the pair serves the steps whose window also holds the sample before
        both = F.least(steps_from(F.col("prev_ts"), m.offset_ms + m.range_ms + 1, g) - 1, F.lit(g.n - 1))
        rows = rows.withColumn("lo", lo).withColumn("hi", hi).withColumn("pair_hi", F.when(F.col("prev_ts").isNull(), -1).otherwise(both)).where("lo <= hi")
        if name in ("irate", "idelta"):
            rows = rows.select("lkey", F.explode(F.sequence("lo", "hi")).alias("k"), "ts_ms", "gain", "prev_ts", "pair_hi", "res")
            last = self.in_phase(m, g, rows).groupBy("lkey", "k").agg(F.max_by(F.struct("gain", "prev_ts", "ts_ms", "pair_hi"), "ts_ms").alias("x")).where("x.pair_hi >= k")
            value = F.col("x.gain") if name == "idelta" else F.col("x.gain") / ((F.col("x.ts_ms") - F.col("x.prev_ts")) / 1000.0)
            return last.select("lkey", "k", value.alias("value"))
        same = rows.groupBy("lkey", "b", "res", "lo", "hi", "pair_hi").agg(F.sum("gain").alias("gain"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("z"), F.count(F.lit(1)).alias("n"))
        sent = self.in_phase(m, g, same.select("lkey", F.explode(F.sequence("lo", "hi")).alias("k"), "gain", "pair_hi", "a", "z", "n", "res"))
        w = sent.groupBy("lkey", "k").agg(F.sum(F.when(F.col("pair_hi") >= F.col("k"), F.col("gain"))).alias("gain"), F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n"))
        total = F.coalesce("gain", F.lit(0.0))
        if name in ("changes", "resets"):
            return w.select("lkey", "k", total.alias("value"))
        w = w.where("n >= 2 and z > a")
        return w.select("lkey", "k", (total if name == "increase" else total / ((F.col("z") - F.col("a")) / 1000.0)).alias("value"))

    def plain(self, name: str, m: Matrix, g: Grid, extra: list) -> DataFrame:
        v, ts = F.col("value"), F.col("ts_ms")
        step_s = (F.col("k") * g.step + g.start) / 1000.0
        real = F.when(~F.isnan(v), v)
        decomposed = {
            "sum_over_time": ([F.sum(v).alias("x")], F.sum("x")),
            "count_over_time": ([F.count(F.lit(1)).alias("x")], F.sum("x").cast("double")),
            "avg_over_time": ([F.sum(v).alias("x"), F.count(F.lit(1)).alias("n")], F.sum("x") / F.sum("n")),
            "min_over_time": ([F.min(real).alias("x")], F.coalesce(F.min("x"), N.nan())),
            "max_over_time": ([F.max(real).alias("x")], F.coalesce(F.max("x"), N.nan())),
            "present_over_time": ([F.lit(1.0).alias("x")], F.max("x")),
            "last_over_time": ([F.max_by(v, ts).alias("x"), F.max(ts).alias("t")], F.max_by("x", "t")),
            "first_over_time": ([F.min_by(v, ts).alias("x"), F.min(ts).alias("t")], F.min_by("x", "t")),
        }
        if name in decomposed and not m.phase and g.n > 1 and m.range_ms > 2 * g.step:
            first, then = decomposed[name]
            lo, hi = self.reach(m, g)
            same = m.df.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").groupBy("lkey", "lo", "hi").agg(*first)
            names = [c for c in same.columns if c not in ("lkey", "lo", "hi")]
            sent = same.select("lkey", F.explode(F.sequence("lo", "hi")).alias("k"), *names)
            return sent.groupBy("lkey", "k").agg(then.alias("value"))
        rows = self.fan(m, g, m.df, "value").groupBy("lkey", "k")
        if name in decomposed:
            direct = {"sum_over_time": F.sum(v), "count_over_time": F.count(F.lit(1)).cast("double"), "avg_over_time": F.avg(v), "min_over_time": F.coalesce(F.min(real), N.nan()), "max_over_time": F.coalesce(F.max(real), N.nan()), "present_over_time": F.max(F.lit(1.0)), "last_over_time": F.max_by(v, ts), "first_over_time": F.min_by(v, ts)}
            return rows.agg(direct[name].alias("value"))
        if name == "quantile_over_time":
            q = extra[0]
            return rows.agg(F.percentile(v, min(max(q, 0.0), 1.0)).alias("value"))
        if name in ("stddev_over_time", "stdvar_over_time"):
            return rows.agg((F.stddev_pop(v) if name.startswith("stddev") else F.var_pop(v)).alias("value"))
        if name == "delta":
            return rows.agg((F.max_by(v, ts) - F.min_by(v, ts)).alias("value"), F.count(F.lit(1)).alias("n")).where("n >= 2")
        if name in ("deriv", "predict_linear"):
            x = ts / 1000.0 - step_s
            slope, base = F.regr_slope(v, x), F.regr_intercept(v, x)
            value = slope if name == "deriv" else base + slope * (F.max(ts / 1000.0 - step_s) + extra[0])
            return rows.agg(value.alias("value"), F.count(F.lit(1)).alias("n")).where("n >= 2 and value is not null")
        if name == "holt_winters":
            sf, tf = extra
            in_order = rows.agg(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("xs")).where(F.size("xs") >= 2)
            start = F.struct(F.element_at("xs", 1)["value"].alias("s"), (F.element_at("xs", 2)["value"] - F.element_at("xs", 1)["value"]).alias("b"))

            def advance(acc: Column, x: Column) -> Column:
                s = sf * x["value"] + (1 - sf) * (acc["s"] + acc["b"])
                return F.struct(s.alias("s"), (tf * (s - acc["s"]) + (1 - tf) * acc["b"]).alias("b"))

            return in_order.select("lkey", "k", F.aggregate(F.slice("xs", 2, F.size("xs") - 1), start, advance, lambda acc: acc["s"]).alias("value"))
        raise QueryError(f"unknown function {name}")

    # -------------------------------------------------------------------------------------- aggregation

    def aggregate(self, a: Aggregate, g: Grid) -> Vector:
        df = self.vector(a.inner, g)
        v = F.col("value")
        group = L.drop(F.col("lkey"), [*a.labels, L.NAME]) if a.without else L.keep(F.col("lkey"), a.labels)
        df = df.withColumn("g", group)
        real = F.when(~F.isnan(v), v)
        if a.op in ("topk", "bottomk"):
            k = int(self.number(a.parameter, g)) if self.number(a.parameter, g) >= 1 else 0
            order = F.when(F.isnan(v), 1).otherwise(0), (F.desc("value") if a.op == "topk" else F.asc("value")), F.col("lkey")
            ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("g", "step").orderBy(*order)))
            return Vector(ranked.where(F.col("rank") <= k).select("lkey", "step", "value"))
        if a.op == "count_values":
            name = self.text(a.parameter)
            shown = F.when(F.isnan(v), "NaN").when(v == N.inf(), "+Inf").when(v == -N.inf(), "-Inf").when((v == F.rint(v)) & (F.abs(v) < 2.0**53), F.when(F.abs(v) < 2.0**53, v).cast("long").cast("string")).otherwise(F.format_string("%.6f", v))
            out = df.groupBy("g", "step", shown.alias("shown")).agg(F.count(F.lit(1)).cast("double").alias("value"))
            return Vector(out.select(L.put(F.col("g"), name, F.col("shown")).alias("lkey"), "step", "value"))
        rows = df.groupBy("g", "step")
        if a.op == "quantile":
            q = self.number(a.parameter, g)
            value = F.max(N.nan()) if math.isnan(q) else F.max(-N.inf()) if q < 0 else F.max(N.inf()) if q > 1 else F.percentile(v, q)
        else:
            value = {
                "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "count": lambda: F.count(F.lit(1)).cast("double"),
                "min": lambda: F.coalesce(F.min(real), N.nan()), "max": lambda: F.coalesce(F.max(real), N.nan()),
                "stddev": lambda: F.stddev_pop(v), "stdvar": lambda: F.var_pop(v),
            }[a.op]()
        return Vector(rows.agg(value.alias("value")).select(F.col("g").alias("lkey"), "step", "value"))

    # -------------------------------------------------------------------------------- binary operators

    def spread_scalar(self, s: Scalar, g: Grid) -> DataFrame:
        if s.df is not None:
            return s.df.select(F.lit("").alias("lkey"), "step", F.col("sval").alias("value"))
        c = s.by_step if s.by_step is not None else F.lit(float(s.value))
        return self.grid_df(g).select(F.lit("").alias("lkey"), "step", c.cast("double").alias("value"))

    def with_scalar(self, df: DataFrame, s: Scalar) -> tuple[DataFrame, Column]:
        if s.value is not None:
            return df, F.lit(float(s.value))
        if s.by_step is not None:
            return df, s.by_step
        # one row per step, at most MAX_STEPS
        return df.join(F.broadcast(s.df), "step"), F.col("sval")

    def binary(self, b: Binary, g: Grid):
        left, right = self.compile(b.left, g), self.compile(b.right, g)
        return self.binary_parts(b.op, left, right, b, g)

    def binary_parts(self, op: str, left, right, b: Binary | None, g: Grid):
        boolean = bool(b and b.boolean)
        for side in (left, right):
            if not isinstance(side, (Scalar, Vector)):
                raise QueryError(f"{op} needs numbers or instant vectors")
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if op in SET_OPERATORS:
                raise QueryError(f"{op} needs instant vectors")
            if left.value is not None and right.value is not None:
                return Scalar(value=N.fold(op, left.value, right.value))
            if left.df is None and right.df is None:
                x, y = (F.lit(float(s.value)) if s.value is not None else s.by_step for s in (left, right))
                return Scalar(by_step=N.compare(op, x, y).cast("double") if op in COMPARISONS else N.arithmetic(op, x, y))
            df, x = self.with_scalar(self.grid_df(g), left)
            df = df.withColumn("x", x).drop("sval")
            df, y = self.with_scalar(df, right)
            return Scalar(df=df.select("step", (N.compare(op, F.col("x"), y).cast("double") if op in COMPARISONS else N.arithmetic(op, F.col("x"), y)).alias("sval")))
        if isinstance(left, Vector) and isinstance(right, Vector):
            return Vector(self.match(op, left.df, right.df, b, boolean))
        if op in SET_OPERATORS:
            raise QueryError(f"{op} needs instant vectors")
        flipped = isinstance(left, Scalar)
        df, s = self.with_scalar((right if flipped else left).df, left if flipped else right)
        x, y = (s, F.col("value")) if flipped else (F.col("value"), s)
        if op in COMPARISONS and not boolean:
            return Vector(df.where(N.compare(op, x, y)).select("lkey", "step", "value"))
        value = N.compare(op, x, y).cast("double") if op in COMPARISONS else N.arithmetic(op, x, y)
        return Vector(df.select(L.drop(F.col("lkey"), [L.NAME]).alias("lkey"), "step", value.alias("value")))

    def match(self, op: str, left: DataFrame, right: DataFrame, b: Binary | None, boolean: bool) -> DataFrame:
        how = b.matching
        mkey = L.keep(F.col("lkey"), how.labels) if how.on else L.drop(F.col("lkey"), [*how.labels, L.NAME])
        l, r = left.withColumn("mkey", mkey), right.withColumn("mkey", mkey)
        on = ["mkey", "step"]
        if op in SET_OPERATORS:
            if op == "or":
                return left.unionByName(r.join(l.select(*on).distinct(), on, "left_anti").select("lkey", "step", "value"))
            return l.join(r.select(*on), on, "left_semi" if op == "and" else "left_anti").select("lkey", "step", "value")
        many_right = how.group == "right"
        one, many = (l, r) if many_right else (r, l)
        twice = F.raise_error(F.concat(F.lit("several series on the one side match the labels "), F.regexp_replace("mkey", "[\\x01\\x02]", " ")))
        one = one.groupBy(*on).agg(F.first("lkey").alias("one_key"), F.first("value").alias("one_value"), F.count(F.lit(1)).alias("c"))
        one = one.withColumn("one_value", F.when(F.col("c") > 1, twice.cast("double")).otherwise(F.col("one_value")))
        if not how.group:
            # one to one: the left side may not repeat a match key either; it is grouped as the join needs it anyway
            many = many.groupBy(*on).agg(F.first("lkey").alias("lkey"), F.first("value").alias("value"), F.count(F.lit(1)).alias("c"))
            both = F.raise_error(F.concat(F.lit("several series on the left side match the labels "), F.regexp_replace("mkey", "[\\x01\\x02]", " ")))
            many = many.withColumn("value", F.when(F.col("c") > 1, both.cast("double")).otherwise(F.col("value"))).drop("c")
        j = many.join(one.drop("c"), on)
        x, y = (F.col("one_value"), F.col("value")) if many_right else (F.col("value"), F.col("one_value"))
        key = F.col("lkey")
        result = key
        if not (op in COMPARISONS and not boolean):
            result = L.drop(result, [L.NAME])
        if how.group == "" and how.on and not (op in COMPARISONS and not boolean):
            result = L.keep(key, how.labels) if b.matching.on else result
        elif how.group == "" and how.labels and not (op in COMPARISONS and not boolean):
            result = L.drop(key, [*how.labels, L.NAME])
        for name in how.include:
            result = L.put(result, name, L.label(F.col("one_key"), name))
        if op in COMPARISONS and not boolean:
            # a filter keeps the left side's value
            return j.where(N.compare(op, x, y)).select(result.alias("lkey"), "step", x.alias("value"))
        value = N.compare(op, x, y).cast("double") if op in COMPARISONS else N.arithmetic(op, x, y)
        return j.select(result.alias("lkey"), "step", value.alias("value"))

    # --------------------------------------------------------------------------------------- functions

    def arity(self, c: Call, least: int, most: int | None = None) -> None:
        most = least if most is None else most
        if not least <= len(c.args) <= most:
            raise QueryError(f"{c.name} takes {least if least == most else f'{least} to {most}'} arguments, not {len(c.args)}")

    def call(self, c: Call, g: Grid):
        name, n = c.name, c.name
        bare = L.drop(F.col("lkey"), [L.NAME])
        if n in WINDOW_FUNCTIONS:
            return self.window_call(c, g)
        if n in N.ELEMENTWISE:
            if n in N.DATE_PARTS and not c.args:
                return Vector(self.grid_df(g).select(F.lit("").alias("lkey"), "step", N.ELEMENTWISE[n](F.col("step") / 1000.0).alias("value")))
            self.arity(c, 1, 2 if n == "round" else 1)
            df = self.vector(c.args[0], g)
            f = (lambda x: N.rounded(x, self.number(c.args[1], g))) if len(c.args) == 2 else N.ELEMENTWISE[n]
            return Vector(df.select(bare.alias("lkey"), "step", f(F.col("value")).alias("value")))
        if n in ("clamp", "clamp_min", "clamp_max"):
            self.arity(c, 3 if n == "clamp" else 2)
            df, v = self.vector(c.args[0], g), F.col("value")
            lo = self.number(c.args[1], g) if n != "clamp_max" else -math.inf
            hi = self.number(c.args[-1], g) if n != "clamp_min" else math.inf
            value = F.when(v < lo, lo).otherwise(v) if n == "clamp_min" else F.greatest(F.lit(lo), F.least(F.lit(hi), v))
            if n == "clamp_min":
                value = F.when(F.isnan(v), lo).otherwise(value)
            return Vector(df.select(bare.alias("lkey"), "step", value.cast("double").alias("value")))
        if n in ("sort", "sort_desc"):
            self.arity(c, 1)
            return Vector(self.vector(c.args[0], g).orderBy(F.desc("value") if n == "sort_desc" else F.asc("value"), "lkey"))
        if n in ("sort_by_label", "sort_by_label_desc"):
            self.arity(c, 1, 99)
            names = [self.text(a) for a in c.args[1:]] or [L.NAME]
            cols = [L.label(F.col("lkey"), x) for x in names]
            return Vector(self.vector(c.args[0], g).orderBy(*[x.desc() if n.endswith("desc") else x.asc() for x in cols], "lkey"))
        if n == "group":
            self.arity(c, 1)
            return Vector(self.vector(c.args[0], g).select(bare.alias("lkey"), "step", F.lit(1.0).alias("value")))
        if n == "pi":
            self.arity(c, 0)
            return Scalar(value=math.pi)
        if n == "time":
            self.arity(c, 0)
            return Scalar(by_step=F.col("step") / 1000.0)
        if n == "vector":
            self.arity(c, 1)
            s = self.compile(c.args[0], g)
            if not isinstance(s, Scalar):
                raise QueryError("vector takes a number")
            return Vector(self.spread_scalar(s, g))
        if n == "scalar":
            self.arity(c, 1)
            df = self.vector(c.args[0], g).groupBy("step").agg(F.when(F.count(F.lit(1)) == 1, F.first("value")).otherwise(N.nan()).alias("sval"))
            return Scalar(df=self.grid_df(g).join(df, "step", "left").select("step", F.coalesce("sval", N.nan()).alias("sval")))
        if n == "timestamp":
            self.arity(c, 1)
            s = c.args[0]
            if isinstance(s, Selector) and s.range_ms is None:
                back = Matrix(self.scan(s, g.start - s.offset_ms - self.options.lookback_ms + 1, g.end - s.offset_ms), self.options.lookback_ms - 1, s.offset_ms, self.one_name(s))
                sent = self.fan(back, g, back.df).groupBy("lkey", "k").agg(F.max("ts_ms").alias("t"))
                return Vector(sent.select(bare.alias("lkey"), (F.col("k") * g.step + g.start).alias("step"), (F.col("t") / 1000.0).alias("value")))
            return Vector(self.vector(s, g).select(bare.alias("lkey"), "step", (F.col("step") / 1000.0).alias("value")))
        if n == "absent":
            self.arity(c, 1)
            return Vector(self.missing(self.vector(c.args[0], g), g))
        if n == "label_replace":
            self.arity(c, 5)
            dst, repl, src, pattern = (self.text(a) for a in c.args[1:])
            return Vector(self.label_replace(self.vector(c.args[0], g), dst, repl, src, pattern))
        if n == "label_join":
            if len(c.args) < 4:
                raise QueryError("label_join takes at least 4 arguments")
            dst, sep, *sources = (self.text(a) for a in c.args[1:])
            joined = F.concat_ws(sep, *[L.label(F.col("lkey"), s) for s in sources])
            return Vector(self.vector(c.args[0], g).select(L.put(F.col("lkey"), dst, joined).alias("lkey"), "step", "value"))
        if n == "histogram_quantile":
            self.arity(c, 2)
            return Vector(self.histogram_quantile(self.number(c.args[0], g), self.vector(c.args[1], g)))
        raise QueryError(f"unknown function {name}")

    def window_call(self, c: Call, g: Grid) -> Vector:
        n = c.name
        self.arity(c, {"quantile_over_time": 2, "predict_linear": 2, "holt_winters": 3}.get(n, 1))
        at = 1 if n == "quantile_over_time" else 0
        m = self.compile(c.args[at], g)
        if not isinstance(m, Matrix):
            raise QueryError(f"{n} needs a range vector")
        extra = [self.number(a, g) for i, a in enumerate(c.args) if i != at]
        if n == "absent_over_time":
            return Vector(self.missing(self.window("present_over_time", m, g, []), g))
        out = self.window(n, m, g, extra)
        if n in ("last_over_time", "first_over_time"):
            return Vector(self.renamed(out, m.name))
        return Vector(out if m.name is not None else out.withColumn("lkey", L.drop(F.col("lkey"), [L.NAME])))

    def missing(self, df: DataFrame, g: Grid) -> DataFrame:
        there = df.select("step").distinct()
        return self.grid_df(g).join(there, "step", "left_anti").select(F.lit("").alias("lkey"), "step", F.lit(1.0).alias("value"))

    def label_replace(self, df: DataFrame, dst: str, repl: str, src: str, pattern: str) -> DataFrame:
        import re

        try:
            re.compile(pattern)
        except re.error:
            return df
        key = F.col("lkey")
        value = L.label(key, src)
        whole = f"^(?:{pattern})$"
        java = re.sub(r"\$\{?(\w+)\}?", lambda m: f"${m[1]}" if m[1].isdigit() else "${" + m[1] + "}", repl.replace("\\", "\\\\"))
        out = F.when(value.rlike(whole), L.put(key, dst, F.regexp_replace(value, whole, java))).otherwise(key)
        return df.select(out.alias("lkey"), "step", "value")

    def histogram_quantile(self, q: float, df: DataFrame) -> DataFrame:
        """Linear inside the bucket that holds the rank; in the +Inf bucket the highest finite bound."""
        le = L.label(F.col("lkey"), "le")
        bound = F.when(le.isin("+Inf", "Inf", "inf", "+inf"), N.inf()).otherwise(le.try_cast("double"))
        rows = df.withColumn("le", bound).where("le is not null").withColumn("g", L.drop(F.col("lkey"), ["le", L.NAME]))
        b = rows.groupBy("g", "step", "le").agg(F.sum("value").alias("n")).groupBy("g", "step").agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))
        if math.isnan(q) or not 0 <= q <= 1:
            return b.limit(0).select(F.col("g").alias("lkey"), "step", F.lit(0.0).alias("value"))
        last = F.element_at("b", -1)
        b = b.withColumn("total", F.when(last["le"] == N.inf(), last["n"])).withColumn("rank", F.col("total") * q)
        b = b.withColumn("i", F.size(F.filter("b", lambda x: x["n"] < F.col("rank"))) + 1)
        b = b.withColumn("hit", F.try_element_at("b", F.col("i"))).withColumn("before", F.when(F.col("i") > 1, F.try_element_at("b", F.greatest(F.col("i") - 1, F.lit(1)))))
        low = F.coalesce(F.col("before.le"), F.when(F.col("hit.le") <= 0, F.col("hit.le")).otherwise(F.lit(0.0)))
        under = F.coalesce(F.col("before.n"), F.lit(0.0))
        inside = F.when(F.col("hit.n") > under, low + (F.col("hit.le") - low) * (F.col("rank") - under) / F.when(F.col("hit.n") > under, F.col("hit.n") - under)).otherwise(F.col("hit.le"))
        value = F.when(F.col("total").isNull() | (F.col("total") == 0) | (F.size("b") < 2), N.nan()).when(F.col("hit.le") == N.inf(), F.col("before.le")).otherwise(inside)
        return b.select(F.col("g").alias("lkey"), "step", value.alias("value"))
