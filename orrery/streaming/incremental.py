"""Streams of rows merged into a stored entity, batch by batch.

Rows lie in buckets by the hash of their identity.  A batch rewrites only the
buckets that it touches, into a generation of its own number, so a batch that is
replayed after a failure replaces what it had written and merges to the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.upsert import upsert

BUCKETS = 64


def _bucket(identity: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int")


def upsert_stream(stream: DataFrame, path: str, identity: list[str], checkpoint: str, policy: str = "overwrite", buckets: int = BUCKETS) -> StreamingQuery:
    """Start merging a stream into buckets below ``path``; all input that is there is taken, then it stops.

    ``buckets`` is the same for all runs over one path.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, kinds = batch.sparkSession, batch.schema
        batch = batch.withColumn("_bucket", _bucket(identity, buckets))
        touched = {r["_bucket"] for r in batch.select("_bucket").distinct().collect()}  # at most ``buckets``
        if not touched:
            return
        found = {b: p for b, p in _latest(spark, path, number).items() if b in touched}
        old = spark.read.schema(kinds).parquet(*found.values()) if found else batch.drop("_bucket").limit(0)
        merged, _ = upsert(old, batch.drop("_bucket"), identity, policy, stamps=False)
        merged = merged.withColumn("_bucket", _bucket(identity, buckets)).repartition("_bucket")
        merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/generation={number:012d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The folder of the newest generation (older than ``before``) of each bucket."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    out: dict[int, str] = {}
    for name in sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().startswith("generation=")):
        if before is None or int(name.split("=")[1]) < before:
            for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
                if (bucket := s.getPath().getName()).startswith("_bucket="):
                    out[int(bucket.split("=")[1])] = f"{path}/{name}/{bucket}"
    return out


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The entity after the newest generation (older than ``before``), or None."""
    found = _latest(spark, path, before)
    return spark.read.parquet(*found.values()) if found else None


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by key and window; rows later than the watermark are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
