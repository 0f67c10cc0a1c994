"""Sessions over message events, in batch and as streams, and resumable ingestion."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SESSION_CHUNKS, SESSION_MINUTES, SESSION_TURNS
from ..sources import stores


def sessions(events: DataFrame, minutes: int = SESSION_MINUTES) -> DataFrame:
    """user_id, start, end, n of runs of events with gaps of at most ``minutes`` (a gap of exactly that
    stays in the session)."""
    return (
        events.groupBy("user_id", F.session_window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.count("*").alias("n"), F.max("ts").alias("last"))
        .select("user_id", F.col("w.start").alias("start"), F.col("last").alias("end"), "n")
    )


def stream_sessions(events: DataFrame, minutes: int = SESSION_MINUTES, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: closed sessions, once the watermark has passed them."""
    return sessions(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), minutes)


def closed(stream: DataFrame) -> DataFrame:
    """The rows that a stream over what is there appends in one run, as a table in ``spark.checkpoint.dir``
    (rows and state are written by the tasks; the driver holds none)."""
    spark = stream.sparkSession
    at = f"{stores.shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def with_session(events: DataFrame, minutes: int = SESSION_MINUTES) -> DataFrame:
    """Adds the number of each event's session of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), F.lit(True))
    return events.withColumn("session", F.sum(new.cast("int")).over(w))


def last_turns(messages: DataFrame, turns: int = SESSION_TURNS) -> DataFrame:
    """The last 2 * turns messages of each conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("n", n).where(F.col("n") <= 2 * turns).drop("n")


def chunk_cache(seen: DataFrame, most: int = SESSION_CHUNKS) -> DataFrame:
    """seen(session, id, seq) -> the ``most`` chunks first seen last; seeing one again keeps its slot."""
    first = seen.groupBy("session", "id").agg(F.min("seq").alias("slot"), F.max("seq").alias("last"))
    n = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("slot"), F.desc("id")))
    return first.withColumn("n", n).where(F.col("n") <= most).drop("n")


def carried_filter(turns: DataFrame) -> DataFrame:
    """Adds the filter in force: the last one given so far."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("in_force", F.last("agency_filter", ignorenulls=True).over(w))


def citation_map(seen: DataFrame) -> DataFrame:
    """citation -> id seen last, of each session."""
    return seen.groupBy("session", "citation").agg(F.max_by("id", "seq").alias("id"))


def rewrite_context(messages: DataFrame, n: int = 4, chars: int = 200) -> DataFrame:
    """conv_id, context: its last n messages as "role: text" lines, oldest first."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = messages.withColumn("r", r).where(F.col("r") <= n)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, chars)).alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def stateful_sessions(events: DataFrame, minutes: int = SESSION_MINUTES) -> DataFrame:
    """user_id, session, n after every event batch, with the state dropped after inactivity: the streaming
    form for sinks that want each update (event-time timeout, so it needs the watermark)."""
    import pandas as pd

    gap = pd.Timedelta(minutes=minutes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, session, n = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts in rows.ts:
            if last is None or ts - pd.Timestamp(last) > gap:
                session, n = session + 1, 0
            n, last = n + 1, ts.to_pydatetime()
        state.update((last, session, n))
        state.setTimeoutTimestamp(int(pd.Timestamp(last).timestamp() * 1000) + minutes * 60_000)
        yield pd.DataFrame({"user_id": [key[0]], "session": [session], "n": [n]})

    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", "10 minutes")
        .groupBy("user_id")
        .applyInPandasWithState(step, "user_id long, session int, n int", "last timestamp, session int, n int", "update", "EventTimeTimeout")
    )


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, fmt: str = "parquet"):
    """Resumable ingestion: new files of a folder are appended to ``out`` once; the checkpoint is the manifest."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
