"""A stream of route requests of which the latest before each pause counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_session(requests: DataFrame) -> DataFrame:
    """session, seq, state: the newest request of each session; a late one of a lower seq changes nothing.

    requests: session, seq, ts, state. Over a stream one row a session is kept for good; debounced() lets go of them.
    """
    return requests.groupBy("session").agg(F.max("seq").alias("seq"), F.max_by("state", "seq").alias("state"))


def debounced(requests: DataFrame, pause: str = "160 milliseconds", watermark: str = "10 minutes") -> DataFrame:
    """session, start, end, seq, state: of each run of a session's requests with no pause between them the one of the highest seq.

    requests is a stream (or a table) of session, seq, ts, state. A run ends when no request follows within the pause; a late
    request of a lower seq joins its run and changes nothing. Over a stream, in append mode, a run comes out once
    the watermark has passed its end and its state is dropped then, so state holds the runs of the watermark's time only.
    """
    timed = requests.withWatermark("ts", watermark) if requests.isStreaming else requests
    runs = timed.groupBy("session", F.session_window("ts", pause).alias("run")).agg(F.max("seq").alias("seq"), F.max_by("state", "seq").alias("state"))
    return runs.select("session", F.col("run.start").alias("start"), F.col("run.end").alias("end"), "seq", "state")
