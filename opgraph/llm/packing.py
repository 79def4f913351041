"""Problem 6 - filling containers of fixed capacity with whole documents, by harmonic packing.

Sizes are whole tokens, so the reciprocal-capacity classes of harmonic packing can be refined down to single
sizes: the histogram of sizes has at most ``capacity`` entries whatever the data holds. From that histogram a
plan of bin patterns is made (each takes a fixed count of documents from each of its classes, largest first, until no class
fits), and workers fill the bins of every class independently: a document finds its bin from its rank in its class.
``strategy="harmonic"`` keeps the plain classes ``(capacity/(j+1), capacity/j]`` of j documents each; it fills
less (see README).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opgraph.llm.textunits import TOKEN_RE
from opgraph.plans.keys import buckets_for, salted_row_number
from opgraph.plans.materialize import materialize

CAPACITY = 2048
#: Sizes below capacity / CLASSES share the last class of plain harmonic packing.
CLASSES = 64


_CUT = pa.struct([("size", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64())])


def _pieces(capacity: int):
    """Per text its tokens, a digest, and its cuts: whole, or pieces of exactly ``capacity`` tokens (the last one smaller)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, digests, cuts = [], [], []
            for text in batch.column(1).to_pylist():
                starts = [m.start() for m in TOKEN_RE.finditer(text)]
                n = len(starts)
                totals.append(n)
                digests.append(hashlib.md5(text.encode(errors="replace")).hexdigest())
                ends = [min(n, a + capacity) for a in range(0, n, capacity)]
                cuts.append([{"size": b - a, "char_start": 0 if a == 0 else starts[a], "char_end": len(text) if b == n else starts[b]} for a, b in zip(range(0, n, capacity), ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(digests, pa.string()), pa.array(cuts, pa.list_(_CUT))], ["doc_id", "total", "digest", "cuts"])

    return run


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(size, documents of it in each bin), ...]) runs that use up the histogram.

    Each bin starts with the largest size left and takes on, again and again, the largest size that still fits;
    equal bins form one run, which ends when one of its sizes is used up. There are at most as
    many runs as distinct sizes, plus one for each size whose last bins are filled partly.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left, reverse=True)
    runs = []
    while left:
        sizes = [s for s in sizes if s in left]
        pattern: dict[int, int] = {}
        room = capacity
        for s in sizes:
            if room < sizes[-1]:
                break
            take = min(room // s, left[s]) if s <= room else 0
            if take:
                pattern[s] = take
                room -= take * s
        bins = max(1, min(left[s] // n for s, n in pattern.items()))
        for s, n in pattern.items():
            left[s] -= bins * n
            if not left[s]:
                del left[s]
        runs.append((bins, sorted(pattern.items(), reverse=True)))
    return runs


def _intervals(runs: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank + 1, first bin, documents per bin) of every run and size."""
    rank: dict[int, int] = {}
    out, first_bin = [], 0
    for bins, pattern in runs:
        for size, per in pattern:
            begin = rank.get(size, 0)
            rank[size] = begin + bins * per
            out.append((size, begin, rank[size], first_bin, per))
        first_bin += bins
    return out


def _plain(histogram: dict[int, int], capacity: int, classes: int) -> list[tuple[int, int, int, int, int]]:
    """The same intervals for plain harmonic classes: class j is keyed by -j, with j documents a bin."""
    out, first_bin = [], 0
    per_class: dict[int, int] = {}
    for size, n in histogram.items():
        j = min(classes, capacity // size)
        per_class[j] = per_class.get(j, 0) + n
    for j, n in sorted(per_class.items()):
        out.append((-j, 0, n, first_bin, j))
        first_bin += -(-n // j)
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, strategy: str = "patterns", classes: int = CLASSES) -> DataFrame:
    """``(doc_id, piece, pieces, size, char_start, char_end, container)`` of every document with text.

    A document is whole unless it alone exceeds ``capacity``; then it comes in pieces of ``capacity`` tokens and a
    rest. Null ids, null and empty texts, and texts without a token take no room and are left out. A repeated
    row counts once; an id with several texts keeps that of most tokens. Containers are numbered from 0; the numbering is the same for
    the same input. An empty table gives an empty result; other columns are ignored.
    """
    rows = df.where(F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # texts are measured where they are read; only sizes and offsets are shuffled to count a repeated id once
    sized = rows.mapInArrow(_pieces(capacity), "doc_id long, total long, digest string, cuts array<struct<size:long,char_start:long,char_end:long>>")
    best = sized.groupBy("doc_id").agg(F.max(F.struct("total", "digest", "cuts")).alias("b")).select("doc_id", F.size("b.cuts").cast("long").alias("pieces"), F.posexplode("b.cuts").alias("piece", "c"))
    pieces = best.select("doc_id", F.col("piece").cast("long").alias("piece"), "pieces", "c.size", "c.char_start", "c.char_end")
    pieces = materialize(pieces.withColumn("key", F.concat_ws(":", "doc_id", "piece")), "pack-pieces")
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    if strategy == "harmonic":
        steps, cls = _plain(histogram, capacity, classes), -F.least(F.lit(classes), F.floor(F.lit(capacity) / F.col("size"))).cast("long")
    else:
        steps, cls = _intervals(plan_patterns(histogram, capacity)), F.col("size")
    numbered = salted_row_number(pieces.withColumn("cls", cls), ["cls"], "key", "rank", buckets_for(sum(histogram.values())))
    table = pd.DataFrame(steps, columns=["cls", "begin", "end", "bin", "per"]).sort_values(["cls", "begin"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {c: g for c, g in table.groupby("cls")}
        for pdf in batches:
            containers = pd.Series(0, index=pdf.index, dtype="int64")
            for c, part in pdf.groupby("cls"):
                g = by[c]
                at = g["begin"].searchsorted(part["rank"], side="right") - 1
                containers[part.index] = g["bin"].to_numpy()[at] + (part["rank"].to_numpy() - g["begin"].to_numpy()[at]) // g["per"].to_numpy()[at]
            yield pdf.drop(columns=["cls", "rank", "key"]).assign(container=containers)

    return numbered.select("doc_id", "piece", "pieces", "size", "char_start", "char_end", "cls", "rank", "key").mapInPandas(place, "doc_id long, piece long, pieces long, size long, char_start long, char_end long, container long")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of room used (null without any)."""
    filled = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    total = filled.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("bound"), F.round(F.try_divide("tokens", F.col("containers") * capacity), 6).alias("used_share"))
