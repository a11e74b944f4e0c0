"""Structured Streaming forms of the stateful parts: counts, deduplication, windows, pacing, caches, merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seekwell import schemas
from seekwell.session import new_folder


def event_stream(spark: SparkSession, folder: str, name: str | None = "events.parquet", files_at_once: int = 100) -> DataFrame:
    """A file source over parquet files; at most `files_at_once` per trigger (back-pressure). `ts` becomes a timestamp,
    as watermarks need one."""
    reader = spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", files_at_once)
    reader = reader.option("pathGlobFilter", name) if name else reader
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Process what is available and stop. Results are parquet in the shared folder; for the modes `complete` and
    `update` each batch overwrites or appends, and for `each` the function writes."""
    spark = stream.sparkSession
    home = new_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{home}/state")
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    if mode == "append":
        writer.format("parquet").option("path", f"{home}/out").start().awaitTermination()
    else:
        save = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{home}/out")
        writer.foreachBatch(save).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def keyword_counts(stream: DataFrame, key: str) -> DataFrame:
    """Running counts per key; use with mode `complete` or `update`."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, keys: list[str], time: str, keep: str) -> DataFrame:
    """The first event of each key; keys are forgotten `keep` after they were last possible."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, keys: list[str], length: str, slide: str | None, late: str, value: str = "value") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; events later than `late` are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = stream.withWatermark("ts", late).groupBy(window.alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key: runs of events with less than `gap` between."""
    grouped = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def paced(stream: DataFrame, host_col: str, delay_seconds: float) -> DataFrame:
    """Each access with the microseconds since the host's last one and whether the delay had passed; the state of a host
    is the time of its last access. Accesses that aren't ready are to be queued again."""
    delay = int(delay_seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for event_id, us in zip(rows["event_id"], rows["us"]):
            gap = None if last is None else int(us) - last
            out.append((int(key[0]), int(event_id), gap, gap is None or gap > delay))
            last = int(us)
        state.update((last,))
        yield pd.DataFrame(out, columns=["host", "event_id", "gap_us", "ready"]).astype({"gap_us": "Int64"})

    rows = stream.select(F.col(host_col).alias("host"), "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("host").applyInPandasWithState(
        step, "host long, event_id long, gap_us long, ready boolean", "last long", "append", GroupStateTimeout.NoTimeout
    )


def cached(stream: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    """Lookups of a cache whose entries live for a time after they were stored: each event with whether its key was
    still there. A miss stores it anew; state that has expired is dropped by the event-time timer."""
    ttl = int(ttl_seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for event_id, us in zip(rows["event_id"], rows["us"]):
            hit = stored is not None and us - stored < ttl
            stored = stored if hit else int(us)
            out.append((int(key[0]), int(event_id), bool(hit)))
        state.update((stored,))
        if state.getCurrentWatermarkMs() < stored // 1000 + ttl // 1000:
            state.setTimeoutTimestamp(stored // 1000 + ttl // 1000)
        yield pd.DataFrame(out, columns=["id", "event_id", "hit"])

    rows = stream.withWatermark("ts", "1 day").select(F.col(key).alias("id"), "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("id").applyInPandasWithState(
        step, "id long, event_id long, hit boolean", "stored long", "append", GroupStateTimeout.EventTimeTimeout
    )


def in_files(table: DataFrame, folder: str, parts: int, time: str = "ts") -> str:
    """Write a table as `parts` files that follow each other in time, one after the other, so a file stream with one
    file per trigger sees as many batches. Returns the folder."""
    ends = table.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bucket = sum((F.when(F.unix_micros(F.col(time).cast("timestamp")) > end, 1).otherwise(0) for end in ends), F.lit(0))
    for i in range(parts):
        table.where(bucket == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


def batch_totals(batch: DataFrame, number: int, folder: str) -> None:
    """Write a batch's rows under its number: a batch that is run again after a failure replaces what it wrote."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def progress(stream: DataFrame, worker: str, target: int, on_reached: Callable[[int], None], folder: str | None = None) -> None:
    """Sum what all workers report; once the sum reaches `target`, tell it and let the batch end. Reports are kept in
    `folder` by batch, so a restarted stream goes on from where it was and no replayed batch counts twice."""
    folder = folder or new_folder(stream.sparkSession, "progress")

    def add(batch: DataFrame, number: int) -> None:
        batch_totals(batch.groupBy(F.col(worker).alias("worker")).count(), number, folder)
        total = batch.sparkSession.read.parquet(folder).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        if total >= target:
            on_reached(total)

    run_to_end(stream, each=add)


def merged_index(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key accumulated over batches: each batch's counts are kept under its number, so a replayed batch
    replaces its own, and the sum over them is the index."""
    spark = stream.sparkSession
    path = new_folder(spark, "index")
    run_to_end(stream, each=lambda batch, number: batch_totals(batch.groupBy(*keys).agg(F.count("*").alias("tf")), number, path))
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("tf").alias("tf"))
