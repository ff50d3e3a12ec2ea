"""The query engine: instant and range queries, metadata, JSON results."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import labels as L
from loomline.plans.compiler import Compiler, Grid, Options, Scalar, Vector
from loomline.sources.monitor import STATS, Stats
from loomline.plans.syntax import Matcher, QueryError, Selector, parse


class Engine:
    """Queries over samples (metric, labels or lkey, ts_ms, value [, fields, date, promoted label columns])."""

    def __init__(self, spark: SparkSession, samples: DataFrame, lookback_ms: int = 300_000, reset: str = "new", stale_ms: int | None = None, stats: Stats | None = None):
        self.spark, self.options, self.stats = spark, Options(lookback_ms, reset, stale_ms), stats or STATS
        self.samples = samples if "lkey" in samples.columns else samples.withColumn("lkey", L.key_of_map(F.col("labels")))

    def range(self, query: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        """lkey, step (ms), value at every step with a result."""
        with self.stats.query():
            return self.planned(query, start_ms, end_ms, step_ms)

    def planned(self, query: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        g = Grid(start_ms, end_ms, step_ms)
        c = Compiler(self.spark, self.samples, self.options)
        out = c.run(parse(query), g)
        if isinstance(out, Scalar):
            return c.spread_scalar(out, g)
        if isinstance(out, Vector):
            return out.df.select("lkey", "step", "value")
        raise QueryError("the query's result must be a number or an instant vector")

    def instant(self, query: str, at_ms: int) -> DataFrame:
        """lkey, step (the time), value; a range selector gives its raw samples with their own times."""
        with self.stats.query():
            node = parse(query)
            if isinstance(node, Selector) and node.range_ms is not None:
                c = Compiler(self.spark, self.samples, self.options)
                c.query_grid = Grid(at_ms, at_ms, 1)
                m = c.matrix(node, c.query_grid)
                return c.renamed(m.df, m.name).select("lkey", F.col("ts_ms").alias("step"), "value")
            return self.planned(query, at_ms, at_ms, 1)

    def is_scalar(self, query: str, at_ms: int) -> bool:
        return isinstance(Compiler(self.spark, self.samples, self.options).run(parse(query), Grid(at_ms, at_ms, 1)), Scalar)

    def columns(self, df: DataFrame, names: list[str]) -> DataFrame:
        """A result with labels as columns, '' where absent."""
        return df.select(*[L.label(F.col("lkey"), n).alias("name" if n == L.NAME else n) for n in names], F.col("step").alias("ts_ms"), "value")

    # ---------------------------------------------------------------------------------------- metadata

    def matching(self, selectors: list[str] | None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """Samples of any of the selectors (all, if there are none) in the closed time range."""
        df = self.samples
        if start_ms is not None:
            df = df.where(F.col("ts_ms") >= start_ms)
        if end_ms is not None:
            df = df.where(F.col("ts_ms") <= end_ms)
        if selectors:
            hit = F.lit(False)
            for s in selectors:
                node = parse(s)
                if not isinstance(node, Selector) or node.range_ms is not None:
                    raise QueryError("match needs a plain selector")
                hit = hit | selector_condition(node.matchers)
            df = df.where(hit)
        return df

    def series(self, selectors: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        return self.matching(selectors, start_ms, end_ms).select("metric", "lkey").distinct()

    def label_names(self, selectors: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None, max_span_ms: int | None = None) -> DataFrame:
        """Names of the labels of matching series. ``max_span_ms``: a longer time range is refused, as one without bounds."""
        if max_span_ms is not None and (start_ms is None or end_ms is None or end_ms - start_ms > max_span_ms):
            raise QueryError(f"the time range must not be longer than {max_span_ms} ms")
        keys = self.series(selectors, start_ms, end_ms).select("lkey").distinct()
        names = keys.select(F.explode(F.map_keys(L.to_map(F.col("lkey")))).alias("label_name"))
        named = self.series(selectors, start_ms, end_ms).where("metric <> ''").limit(1).select(F.lit(L.NAME).alias("label_name"))
        return names.union(named).distinct().orderBy("label_name")

    def label_values(self, name: str, selectors: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        value = F.col("metric") if name == L.NAME else L.label(F.col("lkey"), name)
        return self.matching(selectors, start_ms, end_ms).select(value.alias("label_value")).where("label_value <> ''").distinct().orderBy("label_value")

    def read(self, labels: dict[str, str], start_ms: int, end_ms: int) -> DataFrame:
        """Raw samples of exactly one label set (closed range), in time order."""
        if start_ms > end_ms:
            raise QueryError("start is after end")
        rest = {k: v for k, v in labels.items() if k != L.NAME}
        key = L.SEP.join(f"{k}{L.PAIR}{v}" for k, v in sorted(rest.items()) if v)
        df = self.matching(None, start_ms, end_ms).where(F.col("lkey") == key)
        if L.NAME in labels:
            df = df.where(F.col("metric") == labels[L.NAME])
        return df.select("metric", "lkey", "ts_ms", "value").orderBy("ts_ms")

    # -------------------------------------------------------------------------------------------- json

    def to_json(self, query: str, start_ms: int, end_ms: int | None = None, step_ms: int = 1000, limit: int = 100_000) -> str:
        """Query API response. A result is a document for one client: beyond ``limit`` points it is an error."""
        try:
            df = self.instant(query, start_ms) if end_ms is None else self.range(query, start_ms, end_ms, step_ms)
            rows = df.orderBy("lkey", "step").limit(limit + 1).collect()
            if len(rows) > limit:
                raise QueryError(f"the result has more than {limit} points")
        except Exception as e:  # noqa: BLE001 - the API answers with every failure
            return json.dumps({"status": "error", "errorType": "execution", "error": str(e)})
        shown = lambda v: "NaN" if math.isnan(v) else ("+Inf" if v > 0 else "-Inf") if math.isinf(v) else f"{v:.6f}"
        series: dict[str, list] = {}
        for r in rows:
            series.setdefault(r.lkey, []).append([r.step / 1000, shown(r.value)])
        if end_ms is None and self.is_scalar(query, start_ms):
            return json.dumps({"status": "success", "data": {"resultType": "scalar", "result": series[""][-1]}})
        metric = lambda k: dict(p.split(L.PAIR, 1) for p in k.split(L.SEP) if p)
        if end_ms is None:
            result = [{"metric": metric(k), "value": p[-1]} for k, p in series.items()]
        else:
            result = [{"metric": metric(k), "values": p} for k, p in series.items()]
        return json.dumps({"status": "success", "data": {"resultType": "vector" if end_ms is None else "matrix", "result": result}})


def selector_condition(matchers: list[Matcher]):
    """Condition on columns metric and lkey."""
    hit = F.lit(True)
    for m in matchers:
        value = F.col("metric") if m.name == L.NAME else L.label(F.col("lkey"), m.name)
        hit = hit & L.matches(value, m.op, m.value)
    return hit
