"""Problem 7 - mixing sources to target weights.

Each source's documents, in pseudorandom order, form one string of tokens that is cut into blocks of fixed length. The
mixture is a row of slots, one block each, cut into output shards. How many slots a source gets follows from its target,
capped by ``max_repeats`` times its blocks; what a capped source cannot take goes to the others in
proportion. Slots are dealt to shards by one pseudorandom permutation, which gives every shard the
counts of a multinomial draw conditioned on the exact totals (plain multinomial draws would break the caps). A
source's n-th slot reads the block that a permutation of its own, one per pass, puts at n. Slots are
computed, not stored, and meet the blocks in an equi-join on (source, block).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opgraph.llm.textunits import count_tokens
from opgraph.plans.keys import buckets_for, salted_running_sum
from opgraph.plans.materialize import materialize

BLOCK = 512
SHARD = 256


def clean_source(source: Column) -> Column:
    """Lower case, runs of blanks and separators as one underscore; empty becomes null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(source), r"(?U)[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), F.lit(""))


def allocate(targets: dict[str, float], blocks: dict[str, int], repeats: dict[str, int], slots: int) -> dict[str, int]:
    """Slots of every source: its share of ``slots``, at most its blocks times its repeats; the rest goes on in proportion."""
    caps = {s: blocks.get(s, 0) * max(0, repeats[s]) for s in targets}
    open_, given, left = {s for s in targets if targets[s] > 0 and caps[s] > 0}, dict.fromkeys(targets, 0), min(slots, sum(caps[s] for s in targets if targets[s] > 0))
    while open_ and left > 0:
        weight = sum(targets[s] for s in open_)
        full = {s for s in open_ if left * targets[s] / weight >= caps[s]}
        if not full:
            exact = {s: left * targets[s] / weight for s in open_}
            given.update({s: math.floor(x) for s, x in exact.items()})
            # largest remainders, names in order, get what rounding left
            for s in sorted(open_, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: left - sum(given[s] for s in open_)]:
                given[s] += 1
            break
        for s in sorted(full):
            given[s] = caps[s]
            left -= caps[s]
            open_.discard(s)
    return given


def permute(index: np.ndarray, size: int, seed: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom bijection of 0..size-1: a Feistel network on the next even number of bits, walked into range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(rounds):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            with np.errstate(over="ignore"):
                h = (right ^ key) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(31)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo[todo] = out[todo] >= size
    return out.astype(np.int64)


def _slots(names: list[str], given: dict[str, int], blocks: dict[str, int], slots: int, seed: int):
    """The source, pass and block of every slot of a batch."""
    lows = np.cumsum([0, *(given[s] for s in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slot = pdf["id"].to_numpy()
            p = permute(slot, slots, seed)
            which = np.searchsorted(lows, p, side="right") - 1
            turn, block = np.zeros(len(slot), dtype=np.int32), np.zeros(len(slot), dtype=np.int64)
            for i, s in enumerate(names):
                mine = which == i
                nth = p[mine] - lows[i]
                turn[mine] = nth // blocks[s]
                for t in np.unique(turn[mine]):
                    now = mine & (turn == t)
                    block[now] = permute((p[now] - lows[i]) % blocks[s], blocks[s], zlib.crc32(f"{seed}:{s}:{t}".encode()))
            yield pd.DataFrame({"slot": slot, "source": np.array(names, dtype=object)[which], "pass": turn, "block": block})

    return run


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    Mixture: ``(shard, slot, source, pass, block, doc_id, doc_from, doc_to)``, one row per part of a document in a
    slot, with token offsets in the document. Shares: per target source its target, what it holds, what
    it gives, its reached share, its passes and whether the target was reached to within 0.01.

    The mixture has ``total_tokens`` (default: all tokens of the targeted sources), in whole blocks. Sources
    are compared cleaned. The last tokens of a source that fill no block are used only if the source has no whole
    block; then it forms one short block. Null and empty texts, null ids, and documents without or of an
    untargeted source are left out; a repeated row counts once. Targets of 0, repeats of 0 and sources
    without documents give 0 slots. Empty tables give empty results. ``mix_targets`` is small by contract (one row
    a source) and read on the driver.
    """
    spark = documents.sparkSession
    goal = {r.s: (r.target_share or 0.0, r.max_repeats or 0) for r in targets.select(clean_source(F.col("source")).alias("s"), "target_share", "max_repeats").where("s IS NOT NULL").collect()}
    docs = documents.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").cast("long").alias("doc_id"), clean_source(F.col("source")).alias("source"), "text")
    docs = docs.where(F.col("source").isin(list(goal))) if goal else docs.where("false")
    docs = docs.select("doc_id", "source", count_tokens(F.col("text")).cast("long").alias("size")).where("size > 0")
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("source", "size")).alias("d")).select("doc_id", "d.source", "d.size")
    docs = materialize(docs, "mix-sizes")  # the sums below read it twice; texts are counted once
    docs = materialize(salted_running_sum(docs, ["source"], "doc_id", "size", "at", buckets_for(docs.count(), 256)), "mix-docs")
    have = {r.source: (r.tokens, r.docs) for r in docs.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}  # one row a source
    blocks = {s: max(1, have[s][0] // block) if s in have else 0 for s in goal}
    total = total_tokens if total_tokens is not None else sum(t for t, _ in have.values())
    given = allocate({s: g[0] for s, g in goal.items()}, blocks, {s: g[1] for s, g in goal.items()}, total // block)
    slots = sum(given.values())

    # slot -> position in the row of all sources -> source, pass and block
    names = sorted(s for s in given if given[s])
    rows = spark.range(slots).mapInPandas(_slots(names, given, blocks, slots, seed), "slot long, source string, pass int, block long")

    # the parts of documents that make up each block
    whole = F.lit(None)
    for s in blocks:
        whole = F.when(F.col("source") == s, F.lit(blocks[s])).otherwise(whole)
    end = F.col("at") + F.col("size")
    parts = docs.select("doc_id", "source", "at", "size", whole.cast("long").alias("blocks")).where("blocks IS NOT NULL")
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block)))).where(F.col("block") < F.col("blocks"))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    finish = F.least(end, (F.col("block") + 1) * block)
    parts = parts.select("source", "block", "doc_id", (begin - F.col("at")).alias("doc_from"), (finish - F.col("at")).alias("doc_to"))
    mixture = rows.join(parts, ["source", "block"]).select(F.floor(F.col("slot") / shard).alias("shard"), "slot", "source", "pass", "block", "doc_id", "doc_from", "doc_to")

    sizes = {s: given[s] * (block if have.get(s, (0, 0))[0] >= block else have.get(s, (0, 0))[0]) for s in goal}
    tokens = max(1, sum(sizes.values()))
    report = [
        (s, float(goal[s][0]), int(goal[s][1]), *map(int, have.get(s, (0, 0))), blocks[s], given[s], int(sizes[s]), round(sizes[s] / tokens, 6), math.ceil(given[s] / blocks[s]) if blocks[s] else 0, abs(sizes[s] / tokens - goal[s][0]) <= 0.01)
        for s in sorted(goal)
    ]
    shares = spark.createDataFrame(report, "source string, target_share double, max_repeats int, tokens long, docs long, blocks long, slots long, mixed_tokens long, reached_share double, passes int, reached boolean")
    return mixture, shares


def mixed_shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Per source the share of tokens counted in the mixture itself, beside its target."""
    mixture, shares = mix(documents, targets, **options)
    parts = mixture.groupBy("source", "doc_id").agg(F.sum(F.col("doc_to") - F.col("doc_from")).alias("t"), F.count_distinct("pass").alias("uses"))
    counted = parts.groupBy("source").agg(F.sum("t").alias("counted_tokens"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("docs_used"))
    return shares.join(counted, "source", "left")
