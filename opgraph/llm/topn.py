"""Problem 2 - top N items within every group, by a hot-cold split.

Exact group counts (one partial aggregate) send a group to one of two plans. Light groups take an ordinary
window. Heavy groups are cut into score ranges; ranges below the ones that already hold N items are dropped,
and the rest is sorted in (group, range, salt) pieces of which each passes on N items to the final
window. A group of any size, and any number of equal scores, is so spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opgraph.plans.keys import bucket_of, latest

#: A group is heavy from this many rows, if it is among the MAX_HEAVY largest (the bound of what is broadcast).
HEAVY_ROWS = 2000
MAX_HEAVY = 2000
RANGES = 64
SALTS = 32


def _cut(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n)


def top_n(
    df: DataFrame, group: str, score: str, item: str, n: int, tie: list[Column] | None = None, version: str | None = None,
    tie_columns: list[str] | None = None, heavy_rows: int = HEAVY_ROWS, ranges: int = RANGES, salts: int = SALTS,
) -> DataFrame:
    """``(group, item, rank)``: the up to ``n`` best items of every group that is not null.

    Order: ``score`` descending, then ``tie`` over ``tie_columns``, then ``item``. With ``version``, only the
    latest row of an item counts (equal versions: the greatest values); without it rows are taken as they
    are. Items whose score is null or NaN, and null groups and items, do not rank; infinite scores rank
    first or last. An empty table gives an empty result; other columns are ignored.
    """
    tie_columns = tie_columns or []
    columns = list(dict.fromkeys([group, score, *tie_columns]))
    rows = latest(df, item, columns, version) if version else df.where(F.col(item).isNotNull()).select(item, *columns)
    rows = rows.select(F.col(item).alias("item"), F.col(group).alias("grp"), F.col(score).cast("double").alias("score"), *[F.col(c).alias(f"t_{c}") for c in tie_columns])
    rows = rows.where(F.col("grp").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    order = [F.desc("score"), *(tie or []), F.asc("item")]
    # counts, and the range of the finite scores, in one aggregate with map-side combine
    finite = F.when(F.abs("score") < float("inf"), F.col("score"))
    stats = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    # the largest groups of heavy_rows or more, at most MAX_HEAVY: any other has at most 1 / MAX_HEAVY of all rows
    heavy = F.broadcast(stats.where(F.col("n") >= heavy_rows).orderBy(F.desc("n"), "grp").limit(MAX_HEAVY).drop("n"))
    light = _cut(rows.join(heavy, "grp", "left_anti"), ["grp"], order, n)

    hot = rows.join(heavy, "grp")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / ranges)
    at = F.when(F.col("score") == float("inf"), ranges).when(F.col("score") == float("-inf"), -1).otherwise(
        F.least(F.lit(ranges - 1), F.greatest(F.lit(0), F.floor((F.col("score") - F.col("lo")) / width).cast("int"))))
    hot = hot.withColumn("rng", F.coalesce(at.cast("int"), F.lit(0))).drop("lo", "hi")
    counts = hot.groupBy("grp", "rng").agg(F.count(F.lit(1)).alias("c"))
    above = F.coalesce(F.sum("c").over(Window.partitionBy("grp").orderBy(F.desc("rng")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = F.broadcast(counts.withColumn("above", above).where(F.col("above") < n).select("grp", "rng"))  # at most n ranges a heavy group
    pieces = hot.join(keep, ["grp", "rng"]).withColumn("salt", bucket_of(F.col("item"), salts))
    hot = _cut(_cut(pieces, ["grp", "rng", "salt"], order, n).drop("_rn"), ["grp"], order, n)
    best = light.select("grp", "item", "_rn").unionByName(hot.select("grp", "item", "_rn"))
    return best.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("_rn").alias("rank"))


def best_hits(df: DataFrame, n: int = 8) -> DataFrame:
    """The N best hits of every project: rrf, then vector_rank with nulls last, then hit_id."""
    return top_n(df, "project_id", "rrf", "hit_id", n, [F.asc_nulls_last("t_vector_rank")], "loaded_at", ["vector_rank"])
