"""Streams: samples in, deduplicated and cleaned; windowed aggregates out; rules on every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.engine import Engine
from loomline.operators.rules import DropRules, RecordingRule, backfill, backoff_s, record
from loomline.plans.syntax import Number, Selector, Subquery, parse
from loomline.sources import store


def cleaned(samples: DataFrame, late: str = "1 hour", rules: DropRules | None = None) -> DataFrame:
    """A stream (metric, lkey, ts_ms, value) without repeated deliveries and dropped series; later than ``late`` is left out."""
    rows = samples.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)
    rows = rows.dropDuplicatesWithinWatermark(["metric", "lkey", "ts_ms"])
    return rules.apply(rows) if rules else rows


def rolled(samples: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum, minimum and maximum per series and event-time window."""
    rows = samples if "event_time" in samples.columns else samples.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)
    return rows.groupBy(F.window("event_time", width, slide), "metric", "lkey").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")).select(F.unix_millis(F.col("window.start")).alias("ts_ms"), "metric", "lkey", "n", "total", "low", "high")


def drained(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("metric", "lkey", "ts_ms"), every: str | None = None) -> DataFrame:
    """Run an aggregating stream over what is there now; its result, kept in ``path``.

    Every batch writes only the windows it changed, under its own number, so the watermark bounds the
    state; readers take a window's row of the highest number. A batch run again writes the same folder.
    """
    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/number={number}")

    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger(every)).start().awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema.add("number", "long")).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "number").alias("x")).select(*keys, "x.*")


def trigger(every: str | None) -> dict:
    """What is there now, or on and on at an interval such as ``30 seconds``."""
    return {"processingTime": every} if every else {"availableNow": True}


def sessions(samples: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Count and sum per series and session: samples with no more than ``gap`` between them. ``ts_ms`` is its first sample's time."""
    rows = samples if "event_time" in samples.columns else samples.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)
    sums = rows.groupBy(F.session_window("event_time", gap), "metric", "lkey").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts_ms").alias("last_ms"))
    return sums.select(F.unix_millis(F.col("session_window.start")).alias("ts_ms"), "metric", "lkey", "n", "total", "last_ms")


def appended(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> DataFrame:
    """Run a stream over what is there now and append what is final: windows that the watermark has passed."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger(every)).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def earliest(node: object, at_ms: int, lookback_ms: int) -> int:
    """Time from which an expression needs samples when it is evaluated at ``at_ms`` or later."""
    if isinstance(node, list):
        return min((earliest(x, at_ms, lookback_ms) for x in node), default=at_ms)
    if isinstance(node, (Selector, Subquery)):
        fixed = node.at.value if isinstance(node.at, Number) else node.at
        base = int(fixed * 1000) if isinstance(fixed, (int, float)) else at_ms
        first = base - node.offset_ms - (lookback_ms if node.range_ms is None else node.range_ms)
        return min(at_ms, first if isinstance(node, Selector) else earliest(node.inner, first - (node.resolution_ms or 0), lookback_ms))
    return min((earliest(x, at_ms, lookback_ms) for x in vars(node).values()), default=at_ms) if hasattr(node, "__dict__") else at_ms


def due(rule: RecordingRule, done_ms: int | None, first_ms: int, last_ms: int) -> tuple[int, int] | None:
    """First and last time of the rule's grid that a batch brings; the grid goes on from the time last done."""
    if done_ms is None:
        return last_ms - (last_ms - first_ms) // rule.interval_ms * rule.interval_ms, last_ms
    n = (last_ms - done_ms) // rule.interval_ms
    return (done_ms + rule.interval_ms, done_ms + n * rule.interval_ms) if n > 0 else None


PROGRESS = "name string, at_ms bigint, number bigint"


def ingest(samples: DataFrame, path: str, checkpoint: str, rules: list[RecordingRule] | None = None, drop: DropRules | None = None, lookback_ms: int = 300_000, every: str | None = None) -> StreamingQuery:
    """Append every batch to the store and run the recording rules on their grids up to the batch's last time.

    A rule is evaluated at every interval since it was last done (kept in ``checkpoint``/rules), in the
    first batch since that batch's first time, over all samples its query reaches back to. A failing rule
    waits and then goes on where it stood. ``every``: a processing-time interval at which batches are
    taken on and on; without it, what is there now is taken and the query ends.

    A batch that is run again writes the same rows with the same ``written_at`` (the batch number), and
    reads resolve repeated rows by ``store.newest``, so replays change nothing.
    """
    progress = f"{checkpoint.rstrip('/')}/rules"

    def run(spark, number: int, first: int, last: int) -> None:
        spark.createDataFrame([], PROGRESS).write.mode("append").parquet(progress)
        done = {r.name: r.at_ms for r in spark.read.schema(PROGRESS).parquet(progress).where(F.col("number") < number).groupBy("name").agg(F.max("at_ms").alias("at_ms")).collect()}
        made = []
        for r in rules:
            times = due(r, done.get(r.name), first, last)
            if times is None or r.failures and r.next_run_ms > last:
                continue
            try:
                since = earliest(parse(r.query), times[0], max(lookback_ms, r.stale_ms or 0))
                read = store.newest(store.read(spark, path)).where((F.col("ts_ms") >= since) & (F.col("ts_ms") <= last)).select("metric", "lkey", "ts_ms", "value")
                engine = Engine(spark, read, lookback_ms)
                if times[0] == times[1]:
                    store.write(record(engine, r, times[1]), path, number)
                else:
                    store.write(backfill(engine, r, *times, r.interval_ms), path, number)
                r.failures, r.next_run_ms = 0, times[1] + r.interval_ms
                made.append((r.name, times[1], number))
            except Exception:  # noqa: BLE001 - the other rules of the group go on
                r.failures += 1
                r.next_run_ms = last + backoff_s(r.failures) * 1000
                if r.name not in done:
                    made.append((r.name, times[0] - r.interval_ms, number))
        if made:
            spark.createDataFrame(made, PROGRESS).coalesce(1).write.mode("append").parquet(progress)

    def batch(df: DataFrame, number: int) -> None:
        kept = (drop.apply(df) if drop else df).select("metric", "lkey", "ts_ms", "value").persist()
        try:
            store.write(kept, path, number)
            first, last = kept.agg(F.min("ts_ms"), F.max("ts_ms")).first()
            if rules and last is not None:
                run(df.sparkSession, number, first, last)
        finally:
            kept.unpersist()

    return samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger(every)).start()
