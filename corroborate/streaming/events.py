"""Quality events by time window, on a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, at: str, late: str | None) -> DataFrame:
    return events.withWatermark(at, late) if late else events


def windowed_counts(events: DataFrame, at: str, by: str, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """start, ``by`` and n of each window, a new one every ``slide`` (every width, if none is given); on a stream, events later than ``late`` are not counted and old windows leave the state."""
    counted = _late(events, at, late).groupBy(F.window(at, width, slide).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")


def session_counts(events: DataFrame, at: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    """start, end, ``by`` and n of each session: events of one kind no further than ``gap`` apart; its end is the last event's time and the gap."""
    counted = _late(events, at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to the table below ``path``, each exactly once, until the present input is read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
