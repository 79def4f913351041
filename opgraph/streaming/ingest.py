"""Incremental ingest: a stream of delivered rows keeps versioned tables up to date by micro-batch upserts.

``foreachBatch`` gives at-least-once batches; the upsert is idempotent (a batch that is seen again changes nothing), so the
tables end the same whatever is repeated. A table lies in buckets of its key; a batch rewrites the buckets that it touches, as new
directories, and a pointer to all directories is switched last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opgraph.plans.keys import bucket_of, latest
from opgraph.sources.readers import bucket_paths, prune_versions, read_version, write_buckets


def merge_latest(current: DataFrame | None, batch: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row per key of the current table and a batch."""
    both = batch if current is None else current.unionByName(batch)
    columns = [c for c in batch.columns if c not in (key, version)]
    kept = latest(both.withColumn("_version", F.col(version)), key, [*columns, version], "_version")
    return kept.select(*batch.columns)


#: Buckets of a table that a stream keeps; its pointer has a line for each.
BUCKETS = 64


def upsert(batch: DataFrame, root: str, key: str, version: str, buckets: int = BUCKETS) -> int:
    """Merge a batch into the table at ``root``; returns how many buckets were rewritten. Null keys form no row.

    The number of buckets is that of the first write; a table that is not in buckets is rewritten once.
    """
    spark = batch.sparkSession
    paths = bucket_paths(spark, root)
    rows = batch.where(F.col(key).isNotNull()).withColumn("_bucket", bucket_of(F.col(key), buckets))
    touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return 0
    if paths is None:
        current, keep = read_version(spark, root), {}
    else:
        mine = [paths[b] for b in touched if b in paths]
        current, keep = (spark.read.parquet(*mine) if mine else None), {b: p for b, p in paths.items() if b not in touched}
    merged = merge_latest(current, batch, key, version).withColumn("_bucket", bucket_of(F.col(key), buckets))
    write_buckets(merged.repartition("_bucket", F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(8))), root, "_bucket", keep)
    prune_versions(spark, root, keep=2)
    return len(touched)


def ingest(source: DataFrame, root: str, key: str, version: str, checkpoint: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Start (or continue) the upsert stream of ``source`` into the table at ``root``."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert(batch, root, key, version, buckets)

    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def hits_per_window(hits: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Hits per project and window of ``asked_at``, with a watermark for late rows; repeated deliveries count once."""
    rows = hits.where(F.col("project_id").isNotNull()).withWatermark("asked_at", late).dropDuplicatesWithinWatermark(["hit_id"])
    return rows.groupBy(F.window("asked_at", width), "project_id").agg(F.count(F.lit(1)).alias("hits"))


def read_stream(spark: SparkSession, folder: str, like: str) -> DataFrame:
    """A file stream of Parquet deliveries with the schema of an existing file."""
    return spark.readStream.schema(spark.read.parquet(like).schema).parquet(folder)
