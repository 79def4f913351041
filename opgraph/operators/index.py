"""Full-text and vector ranking: postings, BM25, cosine, embedding with a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opgraph.functions.text import cosine
from opgraph.plans.materialize import materialize

# ---- fixed values: ranking constants, words that carry no content in a question ------------------
K1, B = 1.2, 0.75
RRF_K = 60
PER_METHOD = 20
STOPWORDS = frozenset("""a about above after again all also an and any are as at be been before being below between both but by can
could did do does doing down during each few for from further had has have having how i if in into is it its itself just
me more most my no nor not now of off on once only or other our out over own same should so some such than that the their
them then there these they this those through to too under until up very was we were what when where which while who whom
why will with would you your""".split())
# ---------------------------------------------------------------------------------------------------


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(term, id, tf, len)``: one row per term and document, counted with map-side combine."""
    tokens = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    exploded = tokens.select("id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return exploded.groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))


def counted(text: Column, terms: list[str]) -> Column:
    """struct(len, tf): words of a text and, per term, how often it stands there; a term of several words counts as a phrase."""
    w = words(F.coalesce(text, F.lit("")))
    padded = F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))  # two blanks between words, so that neighbours do not share one
    one = lambda t: F.size(F.filter(w, lambda x: x == F.lit(t)))
    phrase = lambda t: (F.length(padded) - F.length(F.replace(padded, F.lit(f" {'  '.join(t.split())} "), F.lit("")))) / (len("  ".join(t.split())) + 2)
    tf = [(phrase(t) if " " in t else one(t)).cast("int") for t in dict.fromkeys(terms)]
    return F.struct(F.size(w).alias("len"), F.array(*tf).cast("array<int>").alias("tf"))


def weighed(rows: DataFrame, n: int) -> DataFrame:
    """``(id, group, score)`` of rows ``(id, group, len, tf)`` that hold one of ``n`` terms: BM25 with the statistics of each group, rounded to 6 digits.

    The statistics are one row a group; null is a group of its own.
    """
    df = [F.coalesce(F.sum((F.get("tf", i) > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(n)]
    stats = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *df).withColumnRenamed("group", "_g")
    score = F.lit(0.0)
    for i in range(n):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        f = F.get("tf", i)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    hits = rows.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats), F.col("group").eqNullSafe(F.col("_g")))
    return hits.select("id", "group", F.round(score, 6).alias("score"))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of the documents that hold a query term, rounded to 6 digits.

    The terms are counted inside the scan (an array of as many counts as the query has terms) and the counts are written, so neither postings
    nor texts are shuffled or read twice.
    """
    terms = list(dict.fromkeys(terms))
    rows = materialize(docs.select(F.col(id_col).alias("id"), counted(F.col(text_col), terms).alias("c")).select("id", F.lit(None).cast("string").alias("group"), "c.*"), "bm25-counts")
    return weighed(rows, len(terms)).select("id", "score")


#: Partitions of stored postings; a query reads those of its terms.
BUCKETS = 64


def write_postings(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Store postings by bucket of the term, and the documents' lengths, so that questions need not read the texts."""
    rows = docs.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg")).write.mode("overwrite").parquet(f"{path}/lengths")
    stored = postings(docs, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    stored.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def bm25_stored(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """:func:`bm25` from stored postings: only the partitions and row groups of the terms are read."""
    terms = list(dict.fromkeys(terms))
    buckets = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    known = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a term
    size = spark.read.parquet(f"{path}/lengths").first()
    f = F.col("tf")
    idf = F.log(1 + (F.lit(size.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(size.avg)))
    return rows.join(F.broadcast(known), "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def similarity(vector: Column, query: list[float]) -> Column:
    """Cosine with a query vector, rounded to 6 digits; null for vectors of another length and where it is no number."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.round(cosine(vector, q), 6)
    return F.when((F.size(vector) == len(query)) & ~F.isnan(score), score)


def vector_scores(vectors: DataFrame, query: list[float], id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``(id, score)``: cosine with one query vector, rounded to 6 digits; vectors of another length are left out."""
    return vectors.select(F.col(id_col).alias("id"), similarity(F.col(vec_col), query).alias("score")).where("score IS NOT NULL")


def top(scores: DataFrame, k: int = PER_METHOD) -> DataFrame:
    """``(id, score, rank)`` of the k best: a bounded sort first, so that the ranking window meets k rows."""
    best = scores.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(vector: DataFrame, text: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists ``(id[, group], score, rank)``: ``(id[, group], rrf, vector_rank, vector_score, ...)``."""
    key = ["id", *(["group"] if "group" in vector.columns else [])]
    v = vector.select(*key, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    t = text.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("rank").alias("fulltext_rank"), F.col("score").alias("fulltext_score"))
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    by = F.filter(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("fulltext_rank").isNotNull(), "fulltext")), lambda x: x.isNotNull())
    out = v.join(t, same, "full").select(*[F.coalesce(c, f"_{c}").alias(c) for c in key], "vector_rank", "vector_score", "fulltext_rank", "fulltext_score")
    out = out.withColumn("rrf", F.round(part("vector_rank") + part("fulltext_rank"), 9)).withColumn("matched_by", by)
    return out.orderBy(F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("fulltext_rank"), "id").limit(k) if k else out


def query_terms(question: str, expansions: dict[str, list[str]] | None = None) -> list[str]:
    """Content words of a question: stop words out, longer than two letters or all capitals; expansions follow as phrases."""
    import re

    raw = re.findall(r"\w[\w-]*", question)
    kept = [w for w in raw if w.lower() not in STOPWORDS and (len(w) > 2 or w.isupper())]
    single = [t for w in kept for t in re.findall(r"[a-z0-9]+", w.lower())]
    # an expansion is a phrase: its words count together, in their order
    phrases = [" ".join(re.findall(r"[a-z0-9]+", v.lower())) for values in (expansions or {}).values() for v in values]
    return list(dict.fromkeys([*single, *(p for p in phrases if p)]))


def hash_embedding(c: Column, dim: int = 64) -> Column:
    """Deterministic bag-of-words vector: each word adds 1 at its hash modulo ``dim``; unit length."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731 - a value that inner functions read is computed once
    at = F.transform(words(c), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)))
    raw = once(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(a, lambda x: x == i)).cast("double")))
    length = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    return once(raw, lambda r: once(length(r), lambda n: F.transform(r, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float"))))


def embed_with_cache(chunks: DataFrame, cache: DataFrame, embed=hash_embedding) -> tuple[DataFrame, DataFrame]:
    """(chunks with embeddings, new cache). Only texts that the cache lacks are computed; the cache is pruned then only."""
    keyed = chunks.withColumn("key", F.sha1(F.col("embed_text")))
    misses = keyed.select("key", "embed_text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = misses.select("key", embed(F.col("embed_text")).alias("embedding"))
    both = cache.select("key", "embedding").unionByName(fresh)
    pruned = cache.select("key", "embedding").join(keyed.select("key").distinct(), "key", "left_semi").unionByName(fresh)
    return keyed.drop("embedding").join(both, "key").drop("key"), (cache if fresh.isEmpty() else pruned)
