"""Incremental forms of the engine's operators for unbounded input, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import cost


def usage_windows(calls: DataFrame, length: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(start, model, requests, tokens) of each window of calls(ts, model, tokens); rows later than ``late`` go."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", length), "model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "model", "requests", "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """(by, start, end, events) of bursts of events with no longer gap inside."""
    return events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap)).agg(F.count("*").alias("events")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """A stream of calls with the cost by a short, given price table keyed by model."""
    price = prices.select(F.col("model"), F.struct("input", "output", "per_minute").alias("price"))
    joined = calls.join(F.broadcast(price), "model", "left")
    zero = F.lit(0)
    return joined.withColumn("cost", cost(F.col("price"), F.col("prompt_tokens"), F.col("completion_tokens"), zero, zero, zero)).drop("price")


def distinct_calls(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first call of each slot; what is remembered goes with the watermark."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["slot"])
