"""Recording rules, rule groups and drop rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.engine import Engine, selector_condition
from loomline.functions import labels as L
from loomline.plans.syntax import QueryError, Selector, parse

MAX_BACKOFF_S = 300
STALE_MS = 300_000


@dataclass
class RecordingRule:
    """``keep`` wins over ``drop`` if both are given. ``stale_ms``: results whose samples are older are not written."""

    name: str
    query: str
    interval_ms: int = 60_000
    keep: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    stale_ms: int | None = None
    failures: int = 0
    next_run_ms: int = 0


def shaped(rule: RecordingRule, result: DataFrame) -> DataFrame:
    """A query result as samples of the rule's series."""
    key = L.drop(F.col("lkey"), [L.NAME])
    if rule.keep:
        key = L.keep(key, rule.keep)
    elif rule.drop:
        key = L.drop(key, rule.drop)
    return result.select(F.lit(rule.name).alias("metric"), key.alias("lkey"), F.col("step").alias("ts_ms"), "value")


def record(engine: Engine, rule: RecordingRule, at_ms: int) -> DataFrame:
    """The rule at one time. With ``stale_ms``, from series only that have a sample younger than that."""
    return shaped(rule, watchful(engine, rule).instant(rule.query, at_ms))


def watchful(engine: Engine, rule: RecordingRule) -> Engine:
    """The engine that a rule is evaluated by: series whose newest sample is stale give no result, in windows as in instants."""
    if rule.stale_ms is None:
        return engine
    back = min(rule.stale_ms, engine.options.lookback_ms)
    return Engine(engine.spark, engine.samples, back, engine.options.reset, rule.stale_ms, engine.stats)


def backfill(engine: Engine, rule: RecordingRule, start_ms: int, end_ms: int, step_ms: int = 60_000) -> DataFrame:
    return shaped(rule, watchful(engine, rule).range(rule.query, start_ms, end_ms, step_ms))


def parse_rules(text: str) -> list[RecordingRule]:
    """Rules written ``name|query|interval_ms``, one a line; blank lines and lines that begin with # are left out.

    The name ends at the first bar and the interval begins after the last, so a query may hold bars.
    """
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, bar, rest = line.partition("|")
        query, bar2, interval = rest.rpartition("|")
        if not (bar and bar2 and name.strip() and re.fullmatch(r"\s*\d+\s*", interval) and int(interval) > 0):
            raise QueryError(f"line {number}: expected name|query|interval_ms")
        parse(query.strip())
        out.append(RecordingRule(name.strip(), query.strip(), int(interval)))
    return out


def parse_drop_rules(text: str) -> DropRules:
    """A selector a line; a line ``prefix*`` drops by prefix of the metric name."""
    lines = [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]
    rules = DropRules([x for x in lines if not re.fullmatch(r"[\w:.]+\*", x)], [x[:-1] for x in lines if re.fullmatch(r"[\w:.]+\*", x)])
    for s in rules.selectors:
        if not isinstance(parse(s), Selector):
            raise QueryError("a drop rule is a plain selector")
    return rules


def backoff_s(failures: int) -> int:
    return min(2**failures, MAX_BACKOFF_S)


def run_group(rules: list[RecordingRule], at_ms: int, samples: Callable[[], DataFrame], write: Callable[[DataFrame], None], lookback_ms: int = 300_000) -> dict[str, str | None]:
    """Due rules one after the other, each seeing what those before it wrote; a failure doesn't stop the rest.

    Returns rule name -> error or None. A failing rule waits 2**n seconds, at most five minutes.
    """
    out: dict[str, str | None] = {}
    for r in rules:
        if r.next_run_ms > at_ms:
            continue
        try:
            df = samples()
            write(record(Engine(df.sparkSession, df, lookback_ms), r, at_ms))
            r.failures, r.next_run_ms = 0, at_ms + r.interval_ms
            out[r.name] = None
        except Exception as e:  # noqa: BLE001 - the other rules of the group go on
            r.failures += 1
            r.next_run_ms = at_ms + backoff_s(r.failures) * 1000
            out[r.name] = str(e)
    return out


@dataclass
class DropRules:
    """Selectors (all their matchers must hold) and name prefixes whose samples are not stored."""

    selectors: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)

    def apply(self, samples: DataFrame) -> DataFrame:
        hit = F.lit(False)
        for s in self.selectors:
            node = parse(s)
            if not isinstance(node, Selector) or node.range_ms is not None:
                raise QueryError("a drop rule is a plain selector")
            hit = hit | selector_condition(node.matchers)
        for p in self.prefixes:
            hit = hit | F.col("metric").startswith(p)
        return samples.where(~hit)
