"""Streaming forms: idle-gap batches, duplicate windows, incremental study totals and endless runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def idle_batches(events: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """key, start, end, n: batches that a gap without events closes. In batch or, with a watermark, as a stream."""
    source = events.withWatermark(ts, watermark) if watermark else events
    out = source.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drop_repeats(events: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """Events that come at least the interval after the last event of their key that was kept (an event that is dropped does not extend it).

    In batch one pass over rows sorted by key and time, which holds one time. As
    a stream the time is kept as state until the interval has passed; events
    that are late by more than the interval are left out. A null time is dropped.
    """
    until = F.unix_micros(F.col(ts).cast("timestamp") + F.expr(f"interval {within}"))
    names = events.columns
    if events.isStreaming:
        import pandas as pd

        def fresh(_: tuple, batches: Iterator, state) -> Iterator:
            if state.hasTimedOut:
                state.remove()
                return
            open_until = state.get[0] if state.exists else None
            rows = pd.concat(list(batches)).sort_values("_at", kind="stable")
            kept = []
            for at, end in zip(rows["_at"], rows["_until"], strict=True):
                kept.append(open_until is None or at >= open_until)
                if kept[-1]:
                    open_until = int(end)
            state.update((open_until,))
            state.setTimeoutTimestamp(max(-(-open_until // 1000), state.getCurrentWatermarkMs() + 1))
            yield rows.loc[kept, names]

        marked = events.filter(F.col(ts).isNotNull()).withWatermark(ts, within).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_until", until)
        return marked.groupBy(key).applyInPandasWithState(fresh, events.schema, "until long", "append", GroupStateTimeout.EventTimeTimeout)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_until = object(), 0
        for batch in batches:
            keys, at, end = (batch.column(len(names) + i).to_pylist() for i in range(3))
            keep = []
            for k, a, e in zip(keys, at, end, strict=True):
                keep.append(k != held or a >= open_until)
                if keep[-1]:
                    held, open_until = k, e
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    marked = events.filter(F.col(ts).isNotNull()).select(*names, F.col(key).cast("string").alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), until.alias("_until"))
    return marked.repartition("_key").sortWithinPartitions("_key", "_at").mapInArrow(kept, events.schema)


def study_totals(records: DataFrame, ts: str, watermark: str) -> DataFrame:
    """study_uid, n_instances per window of arrival, as a stream with bounded state: repeated SOP instances within the watermark count once."""
    kept = records.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["study_uid", "sop_uid"])
    return kept.groupBy(F.window(ts, watermark).alias("w"), "study_uid").agg(F.count(F.lit(1)).alias("n_instances")).select("study_uid", F.col("w.start").alias("since"), "n_instances")


def start(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """An endless (interval) or drain-and-stop run that hands each micro-batch to process; recovers from its checkpoint."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
