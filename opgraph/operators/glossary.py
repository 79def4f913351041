"""Abbreviation lists: pairs from the lines of a text and from two-column tables, in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opgraph.functions.text import LEADER, collapse, plausible_pair, split_acronym

# ---- fixed values ---------------------------------------------------------------------------------
LIST_START = r"(?i)ABBREVIATIONS\s+AND\s+ACRONYMS|ACRONYMS\s+AND\s+ABBREVIATIONS|ABBREVIATIONS"
LIST_END = r"(?i)^TABLE OF CONTENTS|^CONTENTS$"
# ---------------------------------------------------------------------------------------------------


def list_lines(df: DataFrame, id_col: str, text_col: str = "text", needs_start: bool = True) -> DataFrame:
    """``(id, at, line)``: the lines of every list, from below its heading to a dot leader or the contents."""
    lines = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.posexplode(F.split(text_col, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line"))
    every = Window.partitionBy("id")
    begun = lines.withColumn("start", F.min(F.when(F.rlike("line", F.lit(LIST_START)), F.col("at"))).over(every))
    begun = begun.where(F.col("at") > F.col("start")) if needs_start else begun.where(F.col("at") > F.coalesce("start", F.lit(-1)))
    over = F.rlike("line", F.lit(LEADER)) | F.rlike("line", F.lit(LIST_END))
    ended = begun.withColumn("stop", F.min(F.when(over, F.col("at"))).over(every))
    return ended.where((F.col("stop").isNull() | (F.col("at") < F.col("stop"))) & (F.col("line") != "")).select("id", "at", "line")


def from_text(df: DataFrame, id_col: str, text_col: str = "text", needs_start: bool = True) -> DataFrame:
    """``(id, source, at, acronym, expansion)`` of every list; source 1 ranks after tables. Null texts have none.

    A line that holds both halves is a pair. Halves on lines of their own meet the other half next to them. Between full pairs
    the halves form groups of one kind; the first line of a group meets the last of the group before it, unless that one was
    used: a group of one line whose line met its neighbour leaves nothing, all others leave their last line. So what a group finds
    follows from the number of single-line groups since the last longer one, which windows count.
    """
    halves = list_lines(df, id_col, text_col, needs_start).select("id", "at", split_acronym(F.col("line")).alias("h")).select("id", "at", "h.acronym", "h.expansion")
    full = halves.where("acronym IS NOT NULL AND expansion IS NOT NULL").select("id", "at", "acronym", "expansion")
    order = Window.partitionBy("id").orderBy("at")
    runs = halves.withColumn("run", F.count_if(F.col("acronym").isNotNull() & F.col("expansion").isNotNull()).over(order)).where("acronym IS NULL OR expansion IS NULL")
    within = Window.partitionBy("id", "run").orderBy("at")
    kind = F.col("acronym").isNotNull()
    turns = runs.withColumn("turn", F.when(F.lag(kind).over(within) == kind, 0).otherwise(1)).withColumn("grp", F.sum("turn").over(within))
    groups = turns.groupBy("id", "run", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.min_by(F.struct("acronym", "expansion"), "at").alias("first"), F.max_by(F.struct("acronym", "expansion"), "at").alias("last"))
    by = Window.partitionBy("id", "run").orderBy("grp")
    # a group of several lines always leaves one; of the single-line groups after it every second does, and without it the first does
    anchor = F.last(F.when(F.col("n") > 1, F.col("grp")), ignorenulls=True).over(by)
    leaves = F.when(anchor.isNull(), F.col("grp") % 2 == 1).otherwise((F.col("grp") - anchor) % 2 == 0)
    linked = groups.withColumn("leaves", leaves).withColumn("waiting", F.when(F.lag("leaves").over(by), F.lag("last").over(by)))
    met = linked.where(F.col("waiting").isNotNull()).select("id", "at", F.coalesce("first.acronym", "waiting.acronym").alias("acronym"), F.coalesce("first.expansion", "waiting.expansion").alias("expansion"))
    return full.unionByName(met).select("id", F.lit(1).alias("source"), "at", "acronym", "expansion")


def from_tables(df: DataFrame, id_col: str, rows_col: str = "rows") -> DataFrame:
    """The same from rows of exactly two full cells: a short first one, and a longer second one."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.posexplode(rows_col).alias("at", "row"))
    cells = rows.select("id", "at", F.filter(F.transform("row", F.trim), lambda x: x.isNotNull() & (x != "")).alias("c")).where(F.size("c") == 2)
    a, e = F.get("c", 0), F.get("c", 1)
    return cells.where((F.length(a) <= 15) & (F.size(F.split(a, r"\s+")) <= 2) & (F.length(e) > F.length(a))).select("id", F.lit(0).alias("source"), "at", a.alias("acronym"), e.alias("expansion"))


def merge(pairs: DataFrame) -> DataFrame:
    """``(id, acronym, expansion)``: plausible pairs, the first definition of an acronym wins, tables first."""
    tidy = pairs.withColumn("acronym", collapse(F.col("acronym"))).withColumn("expansion", collapse(F.col("expansion")))
    first = Window.partitionBy("id", "acronym").orderBy("source", "at")
    return tidy.where(plausible_pair(F.col("acronym"), F.col("expansion"))).withColumn("rn", F.row_number().over(first)).where("rn = 1").select("id", "acronym", "expansion")
