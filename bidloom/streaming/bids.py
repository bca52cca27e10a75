"""Marts kept up to date from a stream of bids. An extension: the batch marts are the measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bidders_by_window(bids: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, inn, n_bids, n_wins by event-time window; bids later than the watermark are dropped. bids: ts, inn, is_winner."""
    windows = bids.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "inn")
    return windows.agg(F.count("*").alias("n_bids"), F.count_if("is_winner").alias("n_wins")).select(F.col("w.start").alias("start"), "inn", "n_bids", "n_wins")
