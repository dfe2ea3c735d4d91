"""Mentions as a stream: late rows within the watermark, one edge a pair and document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofgraph.operators.graph import EDGE_LIFE_DAYS, orient


def edge_stream(mentions: DataFrame, delay: str = "2 days", life_days: int = EDGE_LIFE_DAYS) -> DataFrame:
    """Oriented edges of a streaming table of resolved mentions, repeated deliveries dropped.

    State is kept for ``delay`` of publication time only, so it doesn't grow with the stream.
    """
    edges = orient(mentions, life_days)
    return edges.withWatermark("publication_datetime", delay).dropDuplicatesWithinWatermark(["supplier_id", "customer_id", "source_document_id"])


def disclosure_counts(mentions: DataFrame, window: str = "7 days", delay: str = "2 days") -> DataFrame:
    """Mentions and resolved mentions by window of publication time, emitted once a window has closed."""
    return mentions.withWatermark("publication_datetime", delay).groupBy(F.window("publication_datetime", window)).agg(
        F.count("*").alias("mentions"), F.count_if(F.col("resolution_status") == "resolved").alias("resolved_mentions")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "mentions", "resolved_mentions")
