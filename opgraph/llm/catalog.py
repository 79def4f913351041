"""Queries of the training-data operators over their whole tables, and SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opgraph.llm import mixing, names, neighbours, packing, residue, spam, split, topn
from opgraph.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in tables))


def _search(embeddings: DataFrame) -> DataFrame:
    """Stated query set: every vector whose id is divisible by 50, against all rows."""
    return neighbours.exact_neighbours(embeddings.where(F.col("vec_id") % 50 == 0), embeddings, "vec_id", "embedding")


def _segment_hosts(chunks: DataFrame) -> DataFrame:
    """How many masked segments of the chunks stand in how many documents: the count behind the host evidence."""
    counted = residue.segment_hosts(residue.scan([residue.table_rows(chunks, "chunk_id", kind="chunk")]))
    return counted.groupBy("hosts").agg(F.count(F.lit(1)).alias("segments"))


def _pieces_kept(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Tokens of every split record, counted from its pieces without what they share, and whether each piece keeps the limits."""
    pieces = split.split_records(chunks, sections)
    right = (F.col("tokens") <= split.LIMIT) & ((F.col("piece") == 0) | (F.col("shared") == split.OVERLAP))
    return pieces.groupBy("record_kind", "record_id").agg(F.sum(F.col("tokens") - F.col("shared")).alias("tokens"), F.min(right).alias("within_limits"))


def _packed_kept(documents: DataFrame) -> DataFrame:
    """Tokens and pieces of every packed document, and whether no container of it holds more than the capacity."""
    packed = packing.pack(documents)
    used = packed.groupBy("container").agg(F.sum("size").alias("used"))
    rows = packed.join(used, "container")
    return rows.groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max((F.col("used") > packing.CAPACITY).cast("int")).alias("overfull"))


def _shares_kept(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens and documents that each source holds, and whether the mixture counts what the report says and keeps the cap."""
    shares = mixing.mixed_shares(documents, targets)
    given = F.coalesce("counted_tokens", F.lit(0)) == F.col("mixed_tokens")
    capped = F.coalesce("most_uses", F.lit(0)) <= F.col("max_repeats")
    return shares.select("source", "target_share", "max_repeats", "tokens", "docs", (given & capped).alias("as_reported"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(neighbours.similar_pairs, "chunks"),
        "p1_nearest": _over(lambda c: neighbours.most_similar(c, floor=None).select("id", "neighbour", "rank"), "chunks"),
        "p1_search": _over(_search, "embeddings"),
        "p2_found": _over(lambda hits: topn.best_hits(hits).select("project_id", "hit_id"), "hits"),
        "p3_found": _over(lambda c, s: residue.residue_records(c, s).select("record_kind", "record_id"), "chunks", "sections"),
        "p3_hosts": _over(_segment_hosts, "chunks"),
        "p4_found": _over(split.oversized_records, "chunks", "sections"),
        "p4_pieces": _over(split.split_records, "chunks", "sections"),
        "p4_kept": _over(_pieces_kept, "chunks", "sections"),
        "p5_found": _over(names.variant_pairs, "organizations", "org_aliases"),
        "p6_pack": _over(packing.pack, "documents"),
        "p6_fill": _over(lambda d: packing.fill_report(packing.pack(d)), "documents"),
        "p6_harmonic": _over(lambda d: packing.fill_report(packing.pack(d, strategy="harmonic")), "documents"),
        "p6_kept": _over(_packed_kept, "documents"),
        "p7_mix": _over(lambda d, t: mixing.mix(d, t)[0], "documents", "mix_targets"),
        "p7_shares": _over(mixing.mixed_shares, "documents", "mix_targets"),
        "p7_kept": _over(_shares_kept, "documents", "mix_targets"),
        "p8_found": _over(spam.spam_pages, "documents"),
    }


_COSINE = "round(list_cosine_similarity(a.v, b.v), 6)"
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_SOURCE = r"nullif(regexp_replace(regexp_replace(lower(source), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))"
_LONG = "(" + " UNION ALL ".join(
    f"SELECT '{kind}' AS record_kind, {key} AS record_id, max({_TOKENS})::BIGINT AS tokens FROM (SELECT {key}, text FROM {name} QUALIFY loaded_at = max(loaded_at) OVER (PARTITION BY {key})) WHERE text <> '' GROUP BY ALL HAVING max({_TOKENS}) > 400"
    for kind, name, key in (("chunk", "chunks", "chunk_id"), ("section", "sections", "section_id"))) + ")"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
            WITH latest AS (SELECT chunk_id AS id, embedding FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1),
            usable AS (SELECT id, embedding::DOUBLE[] AS v FROM latest WHERE {_USABLE}),
            scored AS (SELECT a.id AS x, b.id AS y, {_COSINE} AS s FROM usable a JOIN usable b ON a.id <> b.id),
            best AS (SELECT x, y, s FROM scored WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 5)
            SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM best WHERE s >= 0.9""",
        "p1_search": f"""
            WITH usable AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_USABLE}),
            scored AS (SELECT a.id AS id, b.id AS neighbour, {_COSINE} AS similarity FROM usable a JOIN usable b ON a.id <> b.id AND a.id % 50 = 0)
            SELECT id, neighbour, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour)::INT AS rank FROM scored
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) <= 5""",
        "p2_found": """
            WITH latest AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC) = 1)
            SELECT project_id, hit_id FROM latest WHERE project_id IS NOT NULL AND rrf IS NOT NULL AND NOT isnan(rrf)
            QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY rrf DESC, vector_rank ASC NULLS LAST, hit_id) <= 8""",
        "p1_nearest": f"""
            WITH latest AS (SELECT chunk_id AS id, embedding FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1),
            usable AS (SELECT id, embedding::DOUBLE[] AS v FROM latest WHERE {_USABLE}),
            scored AS (SELECT a.id AS id, b.id AS neighbour, {_COSINE} AS s FROM usable a JOIN usable b ON a.id <> b.id)
            SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour)::INT AS rank FROM scored
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) <= 5""",
        "p3_hosts": r"""
            WITH t AS (SELECT split_part(chunk_id, ':', 1) AS host, regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g') AS text FROM chunks WHERE text <> ''),
            s AS (SELECT host, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS segment FROM t),
            m AS (SELECT regexp_replace(lower(segment), '[0-9a-f]*[0-9][0-9a-f]*', '0', 'g') AS mask, count(DISTINCT host) AS hosts FROM s WHERE segment <> '' GROUP BY 1)
            SELECT hosts, count(*) AS segments FROM m GROUP BY hosts""",
        "p4_found": f"SELECT record_kind, record_id FROM {_LONG}",
        "p4_kept": f"SELECT record_kind, record_id, tokens, true AS within_limits FROM {_LONG}",
        "p6_kept": f"SELECT doc_id, max(n) AS tokens, ceil(max(n) / 2048)::BIGINT AS pieces, 0 AS overfull FROM (SELECT doc_id, {_TOKENS}::BIGINT AS n FROM documents WHERE text <> '') WHERE n > 0 GROUP BY doc_id",
        "p7_kept": f"""
            WITH d AS (SELECT doc_id, {_SOURCE} AS source, {_TOKENS}::BIGINT AS n FROM documents WHERE text <> ''),
            one AS (SELECT doc_id, source, n FROM d WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY source DESC NULLS LAST, n DESC) = 1)
            SELECT {_SOURCE} AS source, target_share, max_repeats, coalesce(t.tokens, 0)::BIGINT AS tokens, coalesce(t.docs, 0) AS docs, true AS as_reported
            FROM mix_targets m LEFT JOIN (SELECT source AS s, sum(n) AS tokens, count(*) AS docs FROM one GROUP BY source) t ON t.s = {_SOURCE}""",
    }
