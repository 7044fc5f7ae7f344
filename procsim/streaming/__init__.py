"""Structured Streaming of event logs: an addition, as comparison itself works on whole corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bigram_counts(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Event types by user and window of a stream of ``user_id, ts, event_type``, each window's steps in order as bigram counts.

    State is bounded by the watermark: a window is emitted and forgotten once no event of it can arrive.
    """
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    steps = kept.groupBy(F.window("ts", length).alias("w"), "user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_type"))).alias("steps"))
    types = F.transform("steps", lambda s: s["event_type"])
    pairs = F.zip_with(F.slice(types, 1, F.size(types) - 1), F.slice(types, 2, F.size(types)), lambda a, b: F.concat_ws(">", a, b))
    return steps.select("user_id", F.col("w.start").alias("window_start"), F.explode(pairs).alias("bigram"))
