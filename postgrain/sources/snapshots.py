"""Versioned snapshots: a table is a folder of versions; a new one is whole before readers can see it.

A bucketed snapshot keeps ``v{n}/__bucket=b`` folders and manifests ``m{n}`` (bucket, version): a new version holds only changed buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, target: str, letter: str = "v") -> list[int]:
    """Versions whose write ended (they hold the writer's success mark)."""
    p, fs = _fs(spark, target)
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(letter) and fs.exists(_fs(spark, f"{s.getPath()}/_SUCCESS")[0])]
    return sorted(int(d.getName()[1:]) for d in done)


def publish(df: DataFrame, target: str, *, version: int | None = None, partition_by: list[str] | None = None) -> int:
    """Writes the next version (or rewrites the one named) and returns its number."""
    old = versions(df.sparkSession, target)
    n = (old[-1] + 1 if old else 0) if version is None else version
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{target}/v{n}")
    return n


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest whole version."""
    return spark.read.parquet(f"{target}/v{versions(spark, target)[-1]}")


def manifest(spark: SparkSession, target: str, *, below: int | None = None) -> dict[int, int]:
    """Bucket to version of the newest whole manifest (under ``below``)."""
    done = [n for n in versions(spark, target, "m") if below is None or n < below]
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version int").json(f"{target}/m{done[-1]}").collect()} if done else {}


def publish_manifest(spark: SparkSession, target: str, n: int, of: dict[int, int]) -> None:
    """Writes manifest n; files that neither it nor the one before names are deleted."""
    before = manifest(spark, target, below=n)
    spark.createDataFrame(sorted(of.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{target}/m{n}")
    kept = set(of.items()) | set(before.items())
    for old in versions(spark, target, "m")[:-2]:
        for b, v in manifest(spark, target, below=old + 1).items():
            if (b, v) not in kept:
                p, fs = _fs(spark, f"{target}/v{v}/__bucket={b}")
                fs.delete(p, True)
        p, fs = _fs(spark, f"{target}/m{old}")
        fs.delete(p, True)


def of_buckets(spark: SparkSession, target: str, of: dict[int, int]) -> DataFrame | None:
    """The rows of the buckets in their versions; null if there are none."""
    paths = [f"{target}/v{v}/__bucket={b}" for b, v in sorted(of.items())]
    return spark.read.parquet(*paths) if paths else None
