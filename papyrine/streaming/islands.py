"""Islands of events that are close in time, as a batch over windows and as a stream with session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """user_id, session, start, stop, n, total: a pause over `minutes` starts a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    pause = at - F.lag(at).over(w)
    new = F.coalesce(pause > minutes * 60_000_000, F.lit(True)).cast("int")
    own = events.withColumn("_new", new).withColumn("session", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return own.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,9)")).cast("double").alias("total"))


def session_stream(events: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: events later than `late` after the watermark are left out, closed sessions are appended."""
    kept = events.withWatermark("ts", late)
    out = kept.groupBy(F.session_window("ts", f"{minutes} minutes").alias("w"), "user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"))
    return out.select("user_id", "start", "stop", "n")
