"""Structured Streaming forms of the session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageguard.operators.agent import STATES, Backend, decisions
from pageguard.sources.tables import run_folder
from pageguard.streaming.agents import Decide, agent_loops, latest_stream, rocksdb, run_checks

WATERMARK = "10 minutes"


def debounce(events: DataFrame, key: str, gap: str = "400 milliseconds") -> DataFrame:
    """Trailing debounce of each key: one row per quiet period, with the time at which its timer fires (last event + gap).

    Works on batches and, behind a watermark, on streams. Events exactly one gap apart belong together.
    """
    s = events.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return s.select(key, F.unix_micros("s.start").alias("first_us"), F.unix_micros("s.end").alias("fires_us"), "n_events")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream, with ts as a timestamp and a watermark; events.parquet is one file or a folder of them."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).isDirectory()
    # A stream takes a single file only by a pattern.
    raw = spark.readStream.schema(schema).parquet(path if folder else f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def _finish(stream: DataFrame, at: str | None = None) -> DataFrame:
    """Run a stream over what is there into a table in the shared folder (or that of an earlier run), and read it back."""
    at = at or run_folder(stream.sparkSession)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def debounced_stream(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    return _finish(debounce(event_stream(spark, sf_dir), "user_id", gap))


def checked_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % 12 + 1).cast("int"))
    return run_checks(event_stream(spark, sf_dir).select("user_id", "ts", "event_id", state.alias("state")))


def looped_stream(events: DataFrame, decide: Decide, at: str | None = None) -> DataFrame:
    """agent_loops over what a stream of events holds; at: the folder of an earlier run to go on from."""
    with rocksdb(events.sparkSession):
        return _finish(agent_loops(events, decide), at)


def decided_stream(payloads: DataFrame, elements: DataFrame, task: str, backend: Backend) -> DataFrame:
    """A backend's decisions on a stream of payloads, against a table of the pages' elements."""
    return _finish(decisions(payloads, elements, task, backend))


def latest(events: DataFrame, key: str) -> DataFrame:
    """The last event of each key by time, of several at one time the greatest id."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("last")).select(key, "last.*")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept by a stream over the event files."""
    out = latest_stream(event_stream(spark, sf_dir), "user_id", ["ts", "event_id"], ["ts", "event_id", "event_type", "value"])
    return out.select("user_id", "event_id", "event_type", "value")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event for each key while it is within the watermark: a run that is going on is not started again."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finish(once(event_stream(spark, sf_dir).select("user_id", "ts"), ["user_id"]))
