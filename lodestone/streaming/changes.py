"""Streaming upkeep: files that appear, changes that settle, batches that are applied."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.operators.sync import latest_changes, upserted
from lodestone.session import dropped, written

CHANGE = "source string, change string, ts timestamp, content string"
#: Parts of an upkept table; a batch rewrites those with a changed source.
BUCKETS = 256


def read_changes(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """A stream of change events from JSON files that appear in a folder."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def settled_changes(changes: DataFrame, quiet: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """The last change of each source in each burst: a session window closes when the source is quiet for so long."""
    burst = changes.withWatermark("ts", lateness).groupBy("source", F.session_window("ts", quiet).alias("burst"))
    last = burst.agg(F.max_by(F.struct("change", "content"), "ts").alias("last"), F.max("ts").alias("ts"))
    return last.select("source", "last.change", "ts", "last.content")


def apply_batch(spark: SparkSession, changes: DataFrame, table: str, build: Callable[[DataFrame], DataFrame], *, buckets: int = BUCKETS) -> None:
    """Apply a batch to a Parquet table keyed by ``source``: deleted and changed sources go, rebuilt ones come.

    Sources are dealt into ``buckets`` by a hash. Only buckets with a changed source
    are read and written anew, under the next version; then a manifest that names the
    version of each bucket is written, and the batch counts. A driver lost before that
    leaves the old version whole, and applying a batch again gives the same table.
    Folders that neither the new manifest nor the one before names are deleted, so a
    reader has until the batch after next. Of events of one source at the same time
    that with the greatest change and content counts.
    """
    last = written(latest_changes(changes, tie=["change", "content"]), "batch")
    own = F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int")
    touched = {r.b for r in last.select(own.alias("b")).distinct().collect()}  # at most ``buckets``
    if not touched:
        return
    before = current_version(spark, table)
    files, schema = ({}, None) if before is None else _manifest(spark, table, before)
    fresh = build(last.where("change <> 'deleted'"))
    paths = [_bucket(table, files[b], b) for b in sorted(touched & files.keys())]
    if paths:
        kept = spark.read.schema(schema).parquet(*paths).join(last.select("source"), "source", "left_anti")
        fresh = kept.select(*schema.names).unionByName(fresh, allowMissingColumns=True)
    elif schema is not None:
        fresh = spark.createDataFrame([], schema).unionByName(fresh, allowMissingColumns=True)
    version = 0 if before is None else before + 1
    # a rebalance splits a bucket that a hot source makes too large for one task
    out = fresh.withColumn("bucket", own).hint("rebalance", F.col("bucket"))
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{version}")
    made = {int(name.split("=")[1]) for name in _names(spark, f"{table}/v{version}") if name.startswith("bucket=")}
    now = {b: v for b, v in files.items() if b not in touched} | {b: version for b in made}
    rows = [(b, v, None) for b, v in now.items()] + [(-1, version, fresh.schema.json())]
    spark.createDataFrame(rows, "bucket int, version int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{table}/versions/{version}")
    if before:
        older, _ = _manifest(spark, table, before - 1)
        for b, v in older.items():
            if v not in (files.get(b), now.get(b)):
                _delete(spark, _bucket(table, v, b))
        _delete(spark, f"{table}/versions/{before - 1}")
    dropped(last)


def current_version(spark: SparkSession, table: str) -> int | None:
    """The number of the last whole version; None where there is none."""
    whole = [int(n) for n in _names(spark, f"{table}/versions") if "_SUCCESS" in _names(spark, f"{table}/versions/{n}")]
    return max(whole, default=None)


def current_table(spark: SparkSession, table: str) -> DataFrame | None:
    """The table after the batches so far; None before the first."""
    version = current_version(spark, table)
    if version is None:
        return None
    files, schema = _manifest(spark, table, version)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_bucket(table, v, b) for b, v in sorted(files.items())])


def _bucket(table: str, version: int, bucket: int) -> str:
    return f"{table}/v{version}/bucket={bucket}"


def _manifest(spark: SparkSession, table: str, version: int) -> tuple[dict[int, int], StructType]:
    """The version of each bucket, and the table's schema."""
    rows = spark.read.schema("bucket int, version int, schema string").parquet(f"{table}/versions/{version}").collect()
    schema = next(r.schema for r in rows if r.bucket == -1)
    return {r.bucket: r.version for r in rows if r.bucket >= 0}, StructType.fromJson(json.loads(schema))


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    path, fs = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def _delete(spark: SparkSession, path: str) -> None:
    path, fs = _folder(spark, path)
    fs.delete(path, True)


def watch(changes: DataFrame, table: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Apply each micro-batch of a change stream; without ``every`` all that is there, then stop."""
    write = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_batch(df.sparkSession, df, table, build))
    return (write.trigger(processingTime=every) if every else write.trigger(availableNow=True)).start()


__all__ = ["CHANGE", "apply_batch", "current_table", "current_version", "latest_changes", "read_changes", "settled_changes", "upserted", "watch"]
