"""The live path: events validated, resolved, deduplicated and staged window by window."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tallyloom.functions.text import full, is_blank
from tallyloom.streaming.seen import Seen

#: ISO-8601 instants: Z or an offset.
INSTANT = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})"
REQUIRED = ("event_id", "source_system", "event_time")


def kafka_events(spark: SparkSession, servers: str, topic: str = "sales.live") -> DataFrame:
    """The topic's messages as a stream of ``value`` strings."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}).load().select(F.col("value").cast("string"))


def parse(events: DataFrame) -> DataFrame:
    """``value`` strings with ``payload`` (map) and ``error`` (null if valid)."""
    out = events.withColumn("payload", F.from_json("value", "map<string,string>"))
    missing = [F.when(is_blank(F.try_element_at("payload", F.lit(c))), F.lit(f"missing {c}")) for c in REQUIRED]
    time = F.try_element_at("payload", F.lit("event_time"))
    bad_time = F.when(~full(time, INSTANT) | F.try_to_timestamp(time).isNull(), F.lit("event_time is not an instant"))
    return out.withColumn("error", F.coalesce(F.when(F.col("payload").isNull() | (F.size("payload") == 0), F.lit("not a JSON object")), *missing, bad_time))


def resolve_sources(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Valid events with ``source_id``; unknown systems become errors. ``sources(source_id,
    source_systems array)`` is the registry, a small static table."""
    systems = sources.select("source_id", F.explode("source_systems").alias("_system")).dropDuplicates(["_system"])
    out = parsed.withColumn("_system_of", F.try_element_at("payload", F.lit("source_system"))).join(systems, F.col("_system_of") == F.col("_system"), "left")
    unknown = F.when(F.col("error").isNull() & F.col("source_id").isNull(), F.lit("unknown source system"))
    return out.withColumn("error", F.coalesce("error", unknown)).drop("_system_of", "_system")


def valid(resolved: DataFrame) -> DataFrame:
    """Events to stage; the hash is of the message as it came."""
    return resolved.where("error IS NULL").select("source_id", "payload", F.col("value").alias("raw_payload"), F.sha2("value", 256).alias("record_hash"))


def dead_letters(resolved: DataFrame) -> DataFrame:
    return resolved.where("error IS NOT NULL").select("value", "error")


def metrics(resolved: DataFrame, staged: DataFrame) -> DataFrame:
    """One row about a window: events read, staged, repeated, broken and of unknown systems, and how long ago its first came."""
    read = resolved.agg(
        F.count(F.lit(1)).alias("read"), F.count("error").alias("dead"), F.count_if(F.col("error") == "unknown source system").alias("unknown"), F.min(F.when(F.col("error").isNull(), F.try_to_timestamp(F.try_element_at("payload", F.lit("event_time"))))).alias("first_event")
    )
    return read.withColumn("staged", F.lit(staged.count())).select("read", "staged", (F.col("read") - F.col("dead") - F.col("staged")).alias("repeated"), "dead", "unknown", "first_event")


def kafka_dead_letters(servers: str, topic: str = "sales.live.DLT") -> Callable[[DataFrame, int], None]:
    """A sink for ``start``: dead letters go to a topic, why in a header. A window that runs again sends them again."""

    def send(letters: DataFrame, batch_id: int) -> None:
        reason = F.array(F.struct(F.lit("error").alias("key"), F.col("error").cast("binary").alias("value")))
        letters.select("value", reason.alias("headers")).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "includeHeaders": "true"}).save()

    return send


def fresh(events: DataFrame, staged: DataFrame | None) -> DataFrame:
    """Events that neither repeat within the batch nor are staged already, without a time limit."""
    once = events.dropDuplicates(["source_id", "record_hash"])
    return once if staged is None else once.join(staged.select("source_id", "record_hash"), ["source_id", "record_hash"], "left_anti")


def window_counts(events: DataFrame, time: Column, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event-time tumbling windows for batch and stream alike."""
    stamped = events.withColumn("event_ts", time)
    if events.isStreaming:
        stamped = stamped.withWatermark("event_ts", late)
    return stamped.groupBy(F.window("event_ts", size).alias("w"), "source_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "source_id", "n")


class Progress(StreamingQueryListener):
    """What Spark tells about the triggers of the session's streams, the last ``most`` of them: a row for each in ``rows``. Register it with
    ``spark.streams.addListener``."""

    def __init__(self, most: int = 1000):
        self.rows: deque[dict] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append({"query": p.name or str(p.id), "batch": p.batchId, "read": p.numInputRows, "duration_ms": p.durationMs.get("triggerExecution"), "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


METRICS = "read long, staged long, repeated long, dead long, unknown long, first_event timestamp, duration_ms long"
#: Windows between two compactions of the index of seen events.
COMPACT_EVERY = 100


def start(
    events: DataFrame,
    sources: Callable[[], DataFrame],
    staged_path: str,
    dead_path: str,
    checkpoint: str,
    pipeline: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    dead: Callable[[DataFrame, int], None] | None = None,
    metrics_path: str | None = None,
    compact_every: int = COMPACT_EVERY,
):
    """Run the live path: each micro-batch is the window of 30 seconds, staged under its batch id, then
    handed to ``pipeline`` (``plans.pipeline.each_window`` makes one) if it has rows; or leave that to ``windows.start``, which has
    windows for each source. Dead letters are kept under ``dead_path`` and go to ``dead`` too. Repeats are found by an index beside the
    staging table (``seen.Seen``), which is compacted every ``compact_every`` windows. ``metrics_path`` gets a row about each window, counted by
    observation while the window is staged. A batch that is run again after a failure replaces what it had written, so
    the staging table has each event once; the source registry is read anew for every batch."""
    index = Seen(events.sparkSession, f"{staged_path.rstrip('/')}_seen")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, began = batch.sparkSession, time.monotonic()
        resolved = resolve_sources(parse(batch), sources()).persist()
        good, kept, bad = Observation(), Observation(), Observation()
        at = F.try_to_timestamp(F.try_element_at("payload", F.lit("event_time")))
        try:
            found = valid(resolved).observe(good, F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
            rows = index.fresh(found, batch_id).observe(kept, F.count(F.lit(1)).alias("n"))
            rows.withColumn("job_id", F.concat_ws("-", F.lit("stream"), "source_id", F.lit(str(batch_id)))).write.mode("overwrite").parquet(f"{staged_path}/batch={batch_id}")
            letters = dead_letters(resolved).observe(bad, F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") == "unknown source system").alias("unknown"))
            letters.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
            written = spark.read.parquet(f"{staged_path}/batch={batch_id}")
            index.add(written, batch_id)
            if (batch_id + 1) % compact_every == 0:
                index.compact(batch_id)
            if dead is not None:
                dead(dead_letters(resolved), batch_id)
        finally:
            resolved.unpersist()
        if metrics_path is not None:
            of_good, of_kept, of_bad = good.get, kept.get, bad.get
            row = (of_good["n"] + of_bad["n"], of_kept["n"], of_good["n"] - of_kept["n"], of_bad["n"], of_bad["unknown"], of_good["first"], int(1000 * (time.monotonic() - began)))
            spark.createDataFrame([row], METRICS).write.mode("overwrite").parquet(f"{metrics_path}/batch={batch_id}")
        if pipeline is not None and not written.isEmpty():
            pipeline(written, batch_id)

    nothing = events.sparkSession.createDataFrame([], "source_id string, payload map<string,string>, raw_payload string, record_hash string, job_id string")
    nothing.write.mode("ignore").parquet(f"{staged_path}/batch=-1")
    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()
