"""Plan fragments shared by operators: latest version per key, skew-safe ranks and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opgraph.plans.materialize import materialize


def latest(df: DataFrame, key: str, columns: list[str], version: str | None) -> DataFrame:
    """One row per ``key``: that with the greatest ``version``, ties broken by the values themselves.

    One aggregate with map-side combine (a sort aggregate, as rows with texts have no fixed width), so a key that was delivered a
    million times reaches the shuffle once per input task. Null keys form no record and are dropped; a null version is oldest.
    """
    rest = F.struct(*([F.col(version)] if version else []), *[F.col(c) for c in columns])
    picked = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(rest).alias("_r"))
    return picked.select(key, *[F.col("_r").getField(c).alias(c) for c in columns])


#: Repeated keys that are sent to every task at most; beyond it the join is left to the planner.
MOST_REPEATED = 200_000


def latest_wide(df: DataFrame, key: str, columns: list[str], version: str | None) -> DataFrame:
    """:func:`latest` for wide rows (texts, vectors) of which few are delivered twice.

    Only the keys are shuffled to find those with several rows; a checked number of them is broadcast, so that all other
    rows stream from the scan without being moved. Beyond MOST_REPEATED the rows are joined and aggregated by shuffles.
    """
    repeated = materialize(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key), "keys-repeated")
    known = F.broadcast(repeated) if repeated.limit(MOST_REPEATED + 1).count() <= MOST_REPEATED else repeated
    rows = df.where(F.col(key).isNotNull()).select(key, *columns, *([version] if version and version not in columns else []))
    once = rows.join(known, key, "left_anti").select(key, *columns)
    return once.unionByName(latest(rows.join(known, key, "left_semi"), key, columns, version))


def bucket_of(column: Column, buckets: int) -> Column:
    """A stable bucket number 0..buckets-1 from a 64-bit hash."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def buckets_for(rows: int, least: int = 64, per: int = 500_000) -> int:
    """Buckets that leave some ``per`` rows to each if one group holds all rows; grows with the data, never below ``least``."""
    return max(least, -(-rows // per))


def salted_row_number(df: DataFrame, group: list[str], order: str, out: str = "rn", buckets: int = 64) -> DataFrame:
    """Dense 0-based numbers within ``group`` in the order of (hash bucket, ``order``).

    Two aggregations instead of one window over a whole group: exact counts per (group, bucket) give
    every bucket its offset, and rows are numbered within (group, bucket) only. A group that holds a
    third of all rows is so spread over ``buckets`` tasks. ``order`` must be unique within the group;
    rows with a null in ``group`` are dropped.
    """
    spread = df.withColumn("_b", bucket_of(F.col(order), buckets))
    counts = spread.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*group, "_b").orderBy(order)
    numbered = spread.withColumn("_i", F.row_number().over(within) - 1)
    joined = numbered.join(offsets, [*group, "_b"])
    return joined.withColumn(out, F.col("_i") + F.col("_off")).drop("_b", "_i", "_off")


def salted_running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, buckets: int = 256) -> DataFrame:
    """Sum of ``value`` over the rows before each row, in the order (hash bucket, ``order``) of its group.

    Same plan as :func:`salted_row_number`; the order is pseudorandom, which is what shufflers want.
    """
    spread = df.withColumn("_b", bucket_of(F.col(order), buckets))
    sums = spread.groupBy(*group, "_b").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = spread.withColumn("_i", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(offsets, [*group, "_b"]).withColumn(out, F.col("_i") + F.col("_off")).drop("_b", "_i", "_off")
