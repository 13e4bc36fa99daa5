"""Structured Streaming forms: resumable scoring, latest records, admission under a quota, run states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resumable_scores(items: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, per_error: str | None = None) -> StreamingQuery:
    """Score a stream of items into ``out``, exactly once per micro-batch: each batch overwrites its own folder.

    A batch that is replayed after a failure writes the same folder again, so no record is doubled or lost. Failed records
    also go to ``per_error`` if it is named. The trigger takes what is there and ends: run again to resume.
    """

    def write(batch: DataFrame, number: int) -> None:
        records = score(batch).persist()
        records.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if per_error:
            records.filter("error is not null").write.mode("overwrite").json(f"{per_error}/batch={number}")
        records.unpersist()

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_records(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key of a stream or table, as an aggregation with update output."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("r")).select(key, "r.*")


def admitted(stream: DataFrame, key: str, value: str, cap: int) -> DataFrame:
    """``key, value, admitted`` of a stream: per value the first ``cap`` keys are admitted, over all micro-batches.

    The state of a value is one counter; nulls are exempt. Within a micro-batch keys are taken in their order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def decide(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        rows = pd.concat(frames).sort_values(key)
        free = group[0] is None
        ok = [free or held + i < cap for i in range(len(rows))]
        state.update((held + len(rows),))
        yield pd.DataFrame({key: rows[key], value: rows[value], "admitted": ok})

    return stream.select(key, value).groupBy(value).applyInPandasWithState(
        decide, f"{key} {kinds[key]}, {value} {kinds[value]}, admitted boolean", "held long", "append", GroupStateTimeout.NoTimeout
    )


def arm_states(events: DataFrame) -> DataFrame:
    """Each arm's latest state from ``arm, state, at``."""
    return events.groupBy("arm").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))


def event_counts(events: DataFrame, at: str, kind: str, window: str, late: str) -> DataFrame:
    """Events per window and kind; what is later than ``late`` behind the newest is dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def drain(query_input: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a memory table and return it."""
    spark: SparkSession = query_input.sparkSession
    query = query_input.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
