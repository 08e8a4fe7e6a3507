"""Streams over landing folders: incremental merge into bucketed snapshots, event-time windows closed by a watermark."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from postgrain.operators import merge
from postgrain.session import checkpoint_root
from postgrain.sources import snapshots


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landing(spark: SparkSession, path: str, *, files: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a table (one file or a folder) with the table's own schema; at most ``files`` a batch."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return r.option("pathGlobFilter", os.path.basename(local)).parquet(os.path.dirname(local))
    return r.parquet(path)


def commit_stream(stream: DataFrame, *, key: str, outcome: str, target: str, checkpoint: str, seconds: int | None = None):
    """Commits by time or count: a batch holds what ``files`` of its landing allow and starts every ``seconds`` (null: until the input ends).
    Each batch appends its rows without those of keys it has already written, and its counts by outcome. Returns the running query."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        # batches before this one only: a batch that runs again mustn't see its own rows
        done = [f"{target}/rows/b{k}" for k in snapshots.versions(spark, f"{target}/rows", "b") if k < n]
        rows = merge.insert_absent(spark.read.parquet(*done) if done else batch.where("false"), batch, key=[key])
        rows.write.mode("overwrite").parquet(f"{target}/rows/b{n}")
        batch.groupBy(outcome).agg(F.count("*").alias("n")).withColumn("batch", F.lit(n)).coalesce(1).write.mode("overwrite").parquet(f"{target}/counts/b{n}")

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)
    return w.start()


def fold_stream(stream: DataFrame, *, key: list[str], order: str, policies: dict[str, str], target: str, checkpoint: str, buckets: int = 64) -> None:
    """Merges each micro-batch into a snapshot of ``buckets`` parts by key hash. A batch reads and rewrites only the buckets it touches;
    a manifest tells the version of each bucket, so a batch that runs again after a failure overwrites its own files and nothing else."""
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, n: int) -> None:
        batch = batch.withColumn("__bucket", bucket)
        touched = sorted(r[0] for r in batch.select("__bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return
        before = snapshots.manifest(spark, target, below=n)
        old = snapshots.of_buckets(spark, target, {b: v for b, v in before.items() if b in touched})
        cols = [*key, *policies]
        new = merge.fold(batch, key=key, order=order, policies=policies) if old is None else merge.upsert(old, batch, key=key, order=order, policies=policies)
        new.select(*cols).withColumn("__bucket", bucket).write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/v{n}")
        snapshots.publish_manifest(spark, target, n, {**before, **dict.fromkeys(touched, n)})

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest snapshot whose manifest is whole."""
    df = snapshots.of_buckets(spark, target, snapshots.manifest(spark, target))
    if df is None:
        raise ValueError(f"no snapshot in {target}")
    return df


def counts_by_stream(spark: SparkSession, path: str) -> DataFrame:
    """Captures of each posting, counted by a stream that merges batch after batch."""
    target, check = _folder(spark, "snapshot"), _folder(spark, "progress")
    s = landing(spark, path).select("posting_key", F.lit(1).cast("bigint").alias("n"), F.col("capture_id").alias("last_capture"))
    fold_stream(s, key=["posting_key"], order="last_capture", policies={"n": "sum", "last_capture": "max"}, target=target, checkpoint=check)
    return latest(spark, target)


def _hours(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", F.unix_micros("window.start").alias("hour_us"), "n")


def close_hours(events: DataFrame, *, target: str, checkpoint: str, late: str = "2 hours") -> None:
    """Appends each hour once, when the watermark (newest event less ``late``) has passed it; its state goes then, and later rows for it are dropped."""
    q = _hours(events.withWatermark("at", late)).writeStream.format("parquet").outputMode("append")
    q.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly_by_stream(spark: SparkSession, path: str, late: str = "2 hours") -> DataFrame:
    """Events by type and hour of event time: hours closed by the stream, and those after the last closed one as they stand."""
    target, check = _folder(spark, "hours"), _folder(spark, "progress")
    close_hours(landing(spark, path).withColumn("at", F.col("ts").cast("timestamp")), target=target, checkpoint=check, late=late)
    closed = spark.read.schema("event_type string, hour_us bigint, n bigint").parquet(target)
    last = closed.agg(F.coalesce(F.max("hour_us"), F.lit(-(1 << 62))).alias("last")).first()[0]
    events = spark.read.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    return closed.unionByName(_hours(events.where(F.unix_micros(F.date_trunc("hour", "at")) > last)))
