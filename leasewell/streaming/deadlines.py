"""Deadlines of a stream of leases, counted in watermarked windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deadlines(messages: DataFrame, every: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """How many leases end in each window of time, over a stream of lease rows (queue, lease_until)."""
    return messages.withWatermark("lease_until", late).groupBy(F.window("lease_until", every), "queue").agg(F.count("*").alias("n")).select("queue", F.col("window.start").alias("begin"), "n")
