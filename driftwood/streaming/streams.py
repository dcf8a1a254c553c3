"""The stateful operators over Structured Streaming.

``timestamp_ntz`` cannot bear a watermark, so event times are cast to ``timestamp`` with the
session's time zone UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwood.operators import lww
from driftwood.operators.archive import scan_verdict
from driftwood.sources.files import read_pointer, swap_pointer


def upsert_stream(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Newest-wins upserts, continuously: each batch is compacted per key and appended to
    the log at ``target``; reads resolve it. A batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        lww.compacted(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_by_key(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``key, value, time, late`` of a stream ``(key long, value double, time long)``: a row
    for each key and batch with its newest value; ``late`` counts rows so far that came with
    a time not above the newest known and were ignored."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, time, late = state.get if state.exists else (None, None, 0)
        for rows in batches:
            # of equal times the first counts; a time in order that is not known yet is news, all else is late
            first = rows.sort_values("time", kind="stable").drop_duplicates("time")
            fresh = first if time is None else first[first["time"] > time]
            late += len(rows) - len(fresh)
            if len(fresh):
                value, time = float(fresh["value"].iloc[-1]), int(fresh["time"].iloc[-1])
        state.update((value, time, late))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "value": [value], "time": [time], "late": [late]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("key").applyInPandasWithState(step, "key long, value double, time long, late long", "value double, time long, late long", "update", timeout)


def change_feed(stream: DataFrame, ts: str, ident: list[str], overlap: str = "60 seconds") -> DataFrame:
    """Changes once each, although polls overlap: repeats within the overlap are dropped."""
    return stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", overlap).dropDuplicatesWithinWatermark(ident).drop("_at")


def tumbling(stream: DataFrame, ts: str, length: str, by: list[str], size: Column, delay: str = "0 seconds") -> DataFrame:
    """Counts and bytes of closed windows."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    out = timed.groupBy(F.window("_at", length).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "bytes")


def sessions(stream: DataFrame, ts: str, gap: str, by: list[str], delay: str = "0 seconds") -> DataFrame:
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    out = timed.groupBy(F.session_window("_at", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def pairs(refused: DataFrame, keys: DataFrame, within: str = "60 seconds") -> DataFrame:
    """Refusals and keys of one process that come within a bounded time, as they meet."""
    a = refused.select(F.col("process"), F.col("at").cast("timestamp").alias("refused_at"), "user").withWatermark("refused_at", within)
    b = keys.select(F.col("process").alias("_process"), F.col("at").cast("timestamp").alias("key_at"), "print").withWatermark("key_at", within)
    near = (F.col("process") == F.col("_process")) & F.expr(f"key_at >= refused_at - interval {within}") & F.expr(f"key_at <= refused_at + interval {within}")
    return a.join(b, near).select("process", "user", "print", "refused_at", "key_at")


def delayed_writes(stream: DataFrame, target: str, checkpoint: str, delay_seconds: int = 0) -> StreamingQuery:
    """Coalesces writes (path, time, seq, size): of each trigger the last of each path, with
    ``due``, the first write's time and the delay, and how many ``writes`` it stands for."""

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("time", "seq", "size"), F.struct("time", "seq")).alias("l"), F.min("time").alias("first"), F.count(F.lit(1)).alias("writes"))
        due = F.col("first") + F.expr(f"interval {delay_seconds} seconds")
        last.select("path", "l.*", due.alias("due"), "writes").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checked_listing(stream: DataFrame, expected: Callable[[], int], target: str, checkpoint: str) -> StreamingQuery:
    """Takes listings in. One with less than half of what ``expected()`` says fails its
    batch, which the next start tries again; after SCAN_RETRIES failures it is accepted.
    Attempts are kept beside the checkpoint, so they outlive the driver."""

    def put(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{checkpoint}-attempts/batch={number}.json"
        attempts = (read_pointer(spark, at) or {"attempts": 0})["attempts"]
        rows = scan_verdict(batch, expected(), attempts).first()
        if rows.verdict == "retry":
            swap_pointer(spark, at, {"attempts": attempts + 1})
            raise ValueError(f"a listing of {rows.n} rows is less than half of what is known; it is tried again")
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is into Parquet at ``path`` (append), or into folders of
    batches (update)."""
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        query = df.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
