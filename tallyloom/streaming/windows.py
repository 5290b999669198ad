"""A window for each source of the live path: it opens with the source's first event, and is eligible when it has its age.

Windows are state of a stream over the staging table. Of the staged rows only the source and the staging batch move, and a window
keeps how many there were and which batches; timers of processing time close it, so a source that falls silent needs no event for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECONDS = 30
WINDOW = "source_id string, number long, status string, opened_at timestamp, seen_at timestamp, records long, batches array<long>"
_STATE = "number long, opened long, records long, batches array<long>"


def advance(seconds: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What happens to a source's window on new rows and when its timer fires: PENDING rows while it is open, one ELIGIBLE row at its
    end. The next row after that opens the window with the next number. Rows are counted as they pass, never held."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        number, opened, records, batches = state.get if state.exists else (0, -1, 0, [])
        seen = set(batches)
        if not state.hasTimedOut:
            for frame in frames:
                records += len(frame)
                seen |= set(frame["batch"].tolist())
            if opened < 0:
                opened = now
        if opened < 0:
            return
        left = opened + 1000 * seconds - now
        status = "PENDING" if left > 0 and not state.hasTimedOut else "ELIGIBLE"
        if status == "PENDING":
            state.update((number, opened, records, sorted(seen)))
            state.setTimeoutDuration(max(1, left))
        else:
            state.update((number + 1, -1, 0, []))
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        yield pd.DataFrame({"source_id": [key[0]], "number": [number], "status": [status], "opened_at": [stamp(opened)], "seen_at": [stamp(now)], "records": [records], "batches": [sorted(seen)]})

    return step


def source_windows(staged: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """The windows of a stream of staged rows (source_id, batch), as they open, grow and end."""
    slim = staged.select("source_id", F.col("batch").cast("long").alias("batch"))
    return slim.groupBy("source_id").applyInPandasWithState(advance(seconds), WINDOW, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def rows_of(staged: DataFrame, closed: list) -> DataFrame | None:
    """The staged rows of closed windows (rows of ``source_windows``), each with its window's job. Only their batches' folders are read."""
    out = None
    for w in closed:
        own = staged.where((F.col("source_id") == w["source_id"]) & F.col("batch").isin([int(b) for b in w["batches"]]))
        own = own.withColumn("job_id", F.lit(f"window-{w['source_id']}-{w['number']}"))
        out = own if out is None else out.unionByName(own)
    return out


def start(spark: SparkSession, staged_path: str, checkpoint: str, pipeline: Callable[[DataFrame, int], None], seconds: int = SECONDS, trigger: dict | None = None, states_path: str | None = None):
    """Hand each source's window to ``pipeline`` (``plans.pipeline.each_window`` makes one) when it is eligible. ``staged_path`` is the
    staging table of ``live.start``, which then needs no pipeline of its own. ``states_path`` gets the states as they change. A
    batch that runs again after a failure gets the same windows and the same number."""
    schema = spark.read.parquet(staged_path).schema

    def each(states: DataFrame, batch_id: int) -> None:
        states = states.persist()
        try:
            if states_path is not None:
                states.write.mode("overwrite").parquet(f"{states_path}/batch={batch_id}")
            closed = states.where("status = 'ELIGIBLE'").collect()  # one row for each source at most
        finally:
            states.unpersist()
        if closed:
            pipeline(rows_of(spark.read.schema(schema).parquet(staged_path), closed), batch_id)

    stream = source_windows(spark.readStream.schema(schema).parquet(staged_path), seconds)
    writer = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
