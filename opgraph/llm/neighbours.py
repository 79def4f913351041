"""Problem 1 - most similar vectors for every vector, by multi-index hashing.

1. Usable vectors (exact length, finite, not all zero) are grouped by equality; a group of copies is
   searched once and only its first k+1 ids travel (no more can appear in anyone's answer).
2. A mean and iterative-quantisation rotations, fitted on a bounded sample, give each distinct vector a 128-bit
   code. Every vector of the table is indexed; one that lies near the mean, as in a table that one dense cluster rules, is
   also indexed without centring, so that its chance to be found depends on its similarities alone.
3. The code is cut into ``width``-bit substrings, each an index table. Two codes that differ in fewer bits
   than one cut has substrings agree on a substring (pigeonhole). Further cuts of the permuted code replace the probing of
   neighbouring keys: at the radius that a cosine of 0.90 needs, probing every key within it reads a large share of all
   buckets (README). Equal substrings are joined, the Hamming distance of the whole codes is tested inside the join, and
   the survivors are reranked on floats.
4. A bucket of more than ``hot`` vectors (near copies of one text) is not joined: all its members are searched
   exactly against the bucket in blocks, keeping k per vector and block, so that no task meets the whole
   bucket and no list of all its pairs is ever written. Where hot buckets overlap so much that it is less work, the
   vectors of all of them are searched against each other once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opgraph.plans.keys import latest_wide
from opgraph.plans.materialize import materialize

BITS = 128
#: Rows that the rotations are fitted on, at most.
SAMPLE = 8192
ROUND = 6
#: Centred squared norm below which a unit vector lies so near the mean that centring widens its angles too much.
NEAR = 0.55
#: Similarity that the index is laid out for where every vector shall get k neighbours.
FLOOR = 0.9


def usable(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers, not all zero; a null array or element is not usable."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cosine(a: str, b: str, na: str, nb: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.round(dot / (F.col(na) * F.col(nb)), ROUND)


def learn_rotations(sample: np.ndarray, rounds: int = 25, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Mean (dim,) and projection (dim, BITS): rotations by iterative quantisation, as many as BITS need."""
    dim = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    blocks = []
    for n in range(math.ceil(BITS / dim)):
        rotation = np.linalg.qr(np.random.default_rng(seed + n).normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(centred.T @ np.where(centred @ rotation >= 0, 1.0, -1.0))
            rotation = left @ right
        blocks.append(rotation)
    return mean, np.hstack(blocks)[:, :BITS]


def substring_bits(width: int, tables: int, seed: int = 29) -> np.ndarray:
    """(tables, width) bit positions: whole cuts of the code into disjoint substrings, the first unpermuted."""
    rows: list[np.ndarray] = []
    order = np.arange(BITS)
    rng = np.random.default_rng(seed)
    while len(rows) < tables:
        rows += [order[i * width : (i + 1) * width] for i in range(BITS // width)]
        order = rng.permutation(BITS)
    return np.array(rows[:tables])


def _differ(floor: float, spread: float) -> float:
    """The chance that one bit differs for two vectors at cosine ``floor`` whose centred squared norm is ``spread``."""
    return math.acos(max(-1.0, min(1.0, 1 - (1 - floor) / max(spread, 1e-6)))) / math.pi


def hamming_radius(floor: float, spread: float) -> int:
    """Radius that codes of two such vectors keep, but for about one pair in a thousand right at the floor."""
    p = _differ(floor, spread)
    return min(BITS, math.ceil(BITS * p + 3 * math.sqrt(BITS * p * (1 - p))))


def tables_for(floor: float, spread: float, width: int, recall: float) -> int:
    """Substrings of ``width`` bits of which, with chance ``recall``, one agrees for a pair at the floor; more similar pairs are surer."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - _differ(floor, spread)) ** width)))


def _encode(mean: np.ndarray, projection: np.ndarray, bits: np.ndarray, floor: float):
    """Code and keys of every vector; those near the mean get a second row, coded as they stand, under keys of their own."""
    width = bits.shape[1]
    powers = 1 << np.arange(width, dtype=np.int64)
    offsets = np.arange(len(bits), dtype=np.int64) << width

    # the radius that belongs to a centred squared norm, in steps of 0.05
    radii = np.array([hamming_radius(floor, max(NEAR, i * 0.05)) for i in range(82)], dtype=np.int32)

    def coded(vid: np.ndarray, x: np.ndarray, shift: int) -> pa.RecordBatch:
        code = x @ projection >= 0
        words = np.packbits(code, axis=1).view(">i8").astype(np.int64)
        keys = code[:, bits].astype(np.int64) @ powers + offsets + (shift * len(bits) << width)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())
        radius = radii[np.floor(np.sum(x**2, axis=1) / 0.05).astype(int)]
        return pa.RecordBatch.from_arrays([pa.array(vid), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(radius), lists], ["vid", "c0", "c1", "radius", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vid = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            centred = x - mean
            yield coded(vid, centred, 0)
            near = np.sum(centred**2, axis=1) < NEAR
            if near.any():
                yield coded(vid[near], x[near], 1)

    return run


def _block_best(k: int, floor: float | None, scored: bool = False):
    """For the cells of hot buckets: the k best candidates of every query of the cell."""

    lowest = floor if floor is not None else -1.5

    def run(pdf):
        import pandas as pd

        queries, cands = pdf[pdf.q], pdf[~pdf.q].sort_values("vid")
        out = []
        if len(queries) and len(cands):
            c = np.stack(cands.vec.to_numpy()).astype(np.float64)
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            ids = cands.vid.to_numpy()
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                x = np.stack(part.vec.to_numpy()).astype(np.float64)
                s = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ c.T, ROUND)
                s[part.vid.to_numpy()[:, None] == ids[None, :]] = -2
                # those above the k-th best, and of those equal to it the first
                least = np.partition(s, -k, axis=1)[:, [-k]] if s.shape[1] > k else np.full((len(s), 1), -2.0)
                row, col = np.nonzero(s >= np.maximum(least, lowest))
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[kept], col[kept]
                out.append(pd.DataFrame({"a": part.vid.to_numpy()[row], "b": ids[col], "s": s[row, col]}))
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "s": []})
        found = pd.DataFrame({"a": found.a.astype("int64"), "b": found.b.astype("int64"), "s": found.s.astype("float64")})
        return found if scored else found[["a", "b"]]

    return run


def most_similar(
    df: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", version_col: str | None = "loaded_at",
    k: int = 5, dim: int = 64, floor: float | None = 0.9, recall: float = 0.95, hot: int = 512, block: int = 2048,
) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: up to ``k`` most similar other ids of every id.

    Similarity is the cosine rounded to 6 digits; ties go to the smaller neighbour. Only neighbours of at
    least ``floor`` are returned: the index is laid out for that angle (a pair at the floor is found with chance
    ``recall``, a closer one more surely), and k neighbours above it are the k most similar of all. With ``floor=None``
    every vector gets k neighbours at whatever similarity: those that the index answers in full (at FLOOR) are done, the
    others are searched exactly in blocks against all vectors. Only the latest row of an id counts; null ids and unusable
    vectors (null, other length, not finite, all zero) neither ask nor answer; equal vectors are neighbours
    at 1.0; an empty table gives an empty result. Other columns of ``df`` are ignored.
    """
    lowest = FLOOR if floor is None else floor
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), F.col(version_col).alias("ver") if version_col else F.lit(0).alias("ver"))
    base = latest_wide(base, "id", ["vec"], "ver").where(usable(F.col("vec"), dim))
    keyed = base.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(7), "vec"))
    keyed = materialize(keyed, "knn-base")
    # groups of equal vectors: the first k+1 ids; the rank filter is applied before the shuffle
    first = Window.partitionBy("h1", "h2").orderBy("id")
    heads = keyed.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    reps = heads.groupBy("h1", "h2").agg(F.min_by("vec", "rn").alias("vec"), F.min("id").alias("id0"), F.sort_array(F.collect_list("id")).alias("members"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # numbers in the order of the first ids, so that ties go to the smaller: ids alone are sorted, vectors stay where the grouping put them
    order = materialize(keyed.groupBy("h1", "h2").agg(F.min("id").alias("id0")).orderBy("id0").select("h1", "h2", F.monotonically_increasing_id().alias("vid")), "knn-order")
    reps = materialize(reps.withColumn("norm", norm).join(order, ["h1", "h2"]), "knn-reps")

    n = reps.count()
    drawn = reps.select("vec", F.xxhash64("h1", "h2").alias("_o")).orderBy("_o").limit(SAMPLE).select("vec").toArrow()
    sample = np.asarray(drawn.column(0).combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim) if n else np.ones((1, dim))
    mean, projection = learn_rotations(sample)
    spread = float(np.mean(np.sum((sample / np.linalg.norm(sample, axis=1, keepdims=True) - mean) ** 2, axis=1)))
    # buckets of some 16 vectors at every size of the table, and as many tables as the floor then needs
    width = int(min(32, max(8, math.ceil(math.log2(max(n, 2))) - 4)))
    bits = substring_bits(width, tables_for(lowest, max(spread, NEAR), width, recall))

    codes = materialize(reps.select("vid", "vec").mapInArrow(_encode(mean, projection, bits, lowest), "vid long, c0 long, c1 long, radius int, keys array<long>"), "knn-codes")
    index = codes.select("vid", "c0", "c1", "radius", F.explode("keys").alias("key"))
    # members of every bucket, counted where they are read; a bucket of any size reaches one task as one number a task
    crowded = materialize(codes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "knn-hot")
    cold = index.join(crowded.select("key"), "key", "left_anti")
    a, b = cold.alias("a"), cold.alias("b")
    distance = F.bit_count(F.col("a.c0").bitwiseXOR(F.col("b.c0"))) + F.bit_count(F.col("a.c1").bitwiseXOR(F.col("b.c1")))
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.vid") < F.col("b.vid")) & (distance <= F.greatest("a.radius", "b.radius")))
    pairs = near.select(F.col("a.vid").alias("a"), F.col("b.vid").alias("b"))
    pairs = materialize(pairs.unionByName(_hot_pairs(index.select("vid", "key").join(crowded, "key"), reps, k, lowest, hot, block)).distinct(), "knn-pairs")

    left = reps.select(F.col("vid").alias("a"), F.col("vec").alias("va"), F.col("norm").alias("na"))
    right = reps.select(F.col("vid").alias("b"), F.col("vec").alias("vb"), F.col("norm").alias("nb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", _cosine("va", "vb", "na", "nb").alias("s")).where(F.col("s") >= lowest)
    both = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    # k groups of equal vectors hold the k best ids: cut before the ids are attached
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    both = both.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")
    if floor is None:
        both = _with_rest(materialize(both, "knn-near"), reps, k, dim, block)
    ids = reps.select(F.col("vid").alias("b"), F.explode("members").alias("neighbour"))
    others = both.join(ids, "b").select("a", "neighbour", "s")
    own = reps.select(F.col("vid").alias("a"), F.explode("members").alias("neighbour"), F.lit(1.0).alias("s")).join(
        reps.where(F.size("members") > 1).select(F.col("vid").alias("a")), "a", "left_semi")
    # up to k+1 ids answer for a group: one of them may be the asking id itself
    order = Window.partitionBy("a").orderBy(F.desc("s"), "neighbour")
    answers = others.unionByName(own).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    answers = answers.groupBy("a").agg(F.collect_list(F.struct("neighbour", "s")).alias("found"))
    asking = reps.select(F.col("vid").alias("a"), "h1", "h2", F.size("members").alias("copies"), "members").join(answers, "a")
    inside = asking.select(F.explode("members").alias("id"), "found")
    # ids of large groups beyond the first k+1: the join key is salted, as one group may hold a third of the rows
    large = asking.where(F.col("copies") > k).select("h1", "h2", "members", "found", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    rest = keyed.select("id", "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(32)).cast("int").alias("salt"))
    outside = rest.join(large, ["h1", "h2", "salt"]).where(~F.array_contains("members", F.col("id"))).select("id", "found")
    every = inside.unionByName(outside).select("id", F.explode("found").alias("f")).select("id", "f.neighbour", F.col("f.s").alias("similarity")).where(F.col("id") != F.col("neighbour"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def _with_rest(near: DataFrame, reps: DataFrame, k: int, dim: int, block: int) -> DataFrame:
    """``near`` with the k best of every vector for which the index holds fewer, found in blocks against all vectors."""
    full = near.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select("a")
    short = reps.join(full, reps["vid"] == full["a"], "left_anti")
    exact = exact_neighbours(short.select("vid", "vec"), reps.select("vid", "vec"), "vid", "vec", k, dim, 8 * block)
    rest = exact.select(F.col("id").alias("a"), F.col("neighbour").alias("b"), F.col("similarity").alias("s"))
    return near.join(full, "a", "left_semi").unionByName(rest)


def _hot_pairs(index: DataFrame, reps: DataFrame, k: int, floor: float, hot: int, block: int) -> DataFrame:
    """Exact search inside hot buckets: a vector asks and answers in all of its hot buckets; its k best are kept."""
    member = index.select("vid", "key", "n")
    work = member.agg(F.sum(F.col("n").cast("double")).alias("pairs"), F.count_distinct("vid").alias("vids")).first()
    if work.vids and work.vids**2 < work.pairs:
        # any two vectors of a hot bucket are among these
        member = member.select("vid").distinct().select("vid", F.lit(0).cast("long").alias("key"), F.lit(work.vids).cast("long").alias("n"))
    member = member.withColumn("cells", F.ceil(F.col("n") / block).cast("int")).withColumn("at", F.pmod(F.xxhash64("vid"), F.col("cells")).cast("int"))
    member = member.join(reps.select("vid", "vec"), "vid")
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    ask = member.select("key", F.col("at").alias("qb"), other.alias("cb"), "vid", "vec", F.lit(True).alias("q"))
    answer = member.select("key", other.alias("qb"), F.col("at").alias("cb"), "vid", "vec", F.lit(False).alias("q"))
    cells = ask.unionByName(answer)
    found = cells.groupBy("key", "qb", "cb").applyInPandas(_block_best(k, floor, scored=True), "a long, b long, s double").groupBy("a", "b").agg(F.max("s").alias("s"))
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("rn") <= k)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_pairs(df: DataFrame, k: int = 5, floor: float = 0.9, **options) -> DataFrame:
    """``(chunk_id_a, chunk_id_b)``, a < b: one is among the k most similar of the other, at ``floor`` or above."""
    found = most_similar(df, k=k, floor=floor, **options)
    return found.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def exact_neighbours(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, block: int = 4096) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: the k most similar rows of ``base`` for a stated query set, in blocks.

    Every block of queries meets every block of the base in one task that keeps k per query, so the work is
    queries times rows but the rows moved are k per query and block. Ids are whole numbers; the query itself is no neighbour.
    Unusable vectors and null ids neither ask nor answer; a repeated id counts with its greatest vector.
    """
    def prepared(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).cast("array<float>").alias("vec"))
        return rows.where(usable(F.col("vec"), dim)).groupBy("vid").agg(F.max("vec").alias("vec"))

    ask, answer = prepared(queries), prepared(base)
    nq, nb = (max(1, math.ceil(df.count() / block)) for df in (ask, answer))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vid"), F.lit(n)).cast("int")
    cells = ask.select(F.lit(0).cast("long").alias("key"), own(nq).alias("qb"), spread(nb).alias("cb"), "vid", "vec", F.lit(True).alias("q")).unionByName(
        answer.select(F.lit(0).cast("long").alias("key"), spread(nq).alias("qb"), own(nb).alias("cb"), "vid", "vec", F.lit(False).alias("q")))
    found = cells.groupBy("qb", "cb").applyInPandas(_block_best(k, None, scored=True), "a long, b long, s double")
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), F.col("s").alias("similarity"), "rank")
