"""Structured Streaming: capture, deduplicated ingest, recency windows, keyed reinforcement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import params as P
from ..functions.text import command_fact, redact
from ..sources.readers import hook_events


def event_stream(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)


def capture(lines: DataFrame) -> DataFrame:
    """Facts of tool events, secrets redacted.  Stateless: any output mode."""
    e = hook_events(lines).select(command_fact(F.col("command"), F.col("output")).alias("m")).where("m is not null")
    return e.select(redact(F.col("m.fact")).alias("fact"), F.col("m.importance").alias("importance"), F.col("m.type").alias("type"))


def distinct_facts(facts: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first of each fact, case aside, within the watermark."""
    return facts.withWatermark(at, late).withColumn("_key", F.lower("fact")).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def activity(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by time window and type; a window closes once the watermark has passed it."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reinforcement(events: DataFrame, rate: float = P.INITIAL_DECAY_RATE, step: float = P.EXPLICIT_INCREMENT, start: float = 0.4, idle_days: int | None = None) -> DataFrame:
    """(user_id, strength, n, last_ts) after each batch: a key's strength decays with the days between its events and rises with each.

    State is a few numbers a key.  With idle_days, keys without events for so long are forgotten (such a query runs a batch at every trigger).
    """
    import math

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        strength, n, last = state.get if state.exists else (start, 0, None)
        for t in sorted(x for f in frames for x in f["ts"]):
            t = pd.Timestamp(t)
            if last is not None:
                days = max(0.0, (t.value / 1000 - last) / 86_400_000_000)
                strength = min(1.0, max(0.0, strength * math.exp(-rate * days)))
            strength, n, last = min(1.0, strength + step), n + 1, max(last or 0, t.value // 1000)
        state.update((strength, n, last))
        if idle_days:
            state.setTimeoutDuration(idle_days * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "strength": [round(strength, 6)], "n": [n], "last_us": [last]})

    return events.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(update, "user_id long, strength double, n long, last_us long", "strength double, n long, last_us long", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_days else GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "fact"):
    """Appends new facts to a table of facts, each once: a batch is checked against what the table holds, and a batch that runs again adds nothing."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("fact_key", F.sha2(F.lower(key), 256)).dropDuplicates(["fact_key"])
        try:
            held = spark.read.parquet(target).select("fact_key")
            fresh = fresh.join(held, "fact_key", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
