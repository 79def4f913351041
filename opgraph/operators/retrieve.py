"""Hybrid retrieval over chunks: filters first, two exact rankings, reciprocal rank fusion, optional grouping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opgraph.functions.text import name_norm
from opgraph.operators.index import PER_METHOD, counted, fuse, hash_embedding, query_terms, similarity, weighed
from opgraph.plans.materialize import materialize

MOST_K, MOST_PER_PROJECT, SCOPES = 30, 10, ("main", "phase")


def context_filter(countries: list[str] | None = None, project_ids: list[str] | None = None, types: list[str] | None = None, scope: str | None = None, include_front_matter: bool = False) -> Column:
    """The conjunction of the filters that are set; a filter that is not set leaves no trace in the plan."""
    keep = F.lit(True)
    if countries:
        folded = [name_norm(F.lit(c)) for c in countries]
        keep &= F.coalesce(name_norm(F.col("country")).isin(folded), F.lit(False)) | F.coalesce(F.upper("country_iso2").isin([c.upper() for c in countries]), F.lit(False))
    if project_ids:
        keep &= F.col("project_id").isin(project_ids) | F.col("phase_project_id").isin(project_ids)
    if types:
        keep &= F.col("type").isin(types) | F.col("subtype").isin(types)
    if scope:
        keep &= F.col("scope") == scope
    if not include_front_matter and not (types and "front_matter" in types):
        keep &= (F.col("type") != "front_matter") | (F.col("kind") == "glossary")
    return keep


def chunk_context(chunks: DataFrame, sections: DataFrame, operations: DataFrame) -> DataFrame:
    """Chunks with the section and operation facts that filters and payloads need; latest rows only."""
    from opgraph.plans.keys import latest, latest_wide

    c = latest_wide(chunks, "chunk_id", ["section_id", "order", "kind", "text", "embedding"], "loaded_at")
    s = latest(sections, "section_id", ["project_id", "type", "subtype", "scope", "path", "phase_project_id"], "loaded_at")
    o = latest(operations, "project_id", ["name", "country", "country_iso2"], "loaded_at")
    return c.join(s, "section_id").join(o, "project_id", "left")


def search(context: DataFrame, question: str, vector: list[float] | None = None, k: int = 8, per_project_k: int | None = None, project_ids: list[str] | None = None, expansions: dict[str, list[str]] | None = None, per_method: int = PER_METHOD, pool: int | None = None, **filters) -> DataFrame:
    """The k best chunks for a question; with ``per_project_k``, that many from each of ``project_ids``, in their order.

    The filtered context is read once: each chunk leaves its cosine, its counts of the terms and its length, which are written;
    both rankings and the BM25 statistics read those few numbers. Statistics are those of the filtered chunks (of each
    project in grouped mode), so a filter changes weights as well as candidates. Grouped or not, the plan is the same: ranks are taken by group, and
    a chunk that belongs to a project as its own and to another as its phase is in both groups. ``pool``: only so many of a
    ranking's best before the filters count, as an index with a fixed answer size does; default: no limit.
    """
    terms = query_terms(question, expansions)
    grouped = bool(per_project_k and project_ids)
    keep = context_filter(project_ids=project_ids, **filters)
    own = F.array("project_id", "phase_project_id") if "phase_project_id" in context.columns else F.array("project_id")
    groups = F.array_distinct(F.filter(own, lambda p: p.isin(project_ids))) if grouped else F.array(F.lit(None).cast("string"))
    rows = context.select(
        F.col("chunk_id").alias("id"), keep.alias("keep"), groups.alias("groups"), counted(F.col("text"), terms).alias("c"), (similarity(F.col("embedding"), vector) if vector is not None else F.lit(None).cast("double")).alias("near"))
    rows = rows if pool else rows.where("keep")
    rows = materialize(rows.select("id", "keep", "groups", "c.*", "near"), "retrieval-scored")
    if pool:
        best = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c), "id"))
        near = rows.where("near IS NOT NULL").orderBy(F.desc("near"), "id").limit(pool).withColumn("near_rank", best("near")).where("keep")
        text = weighed(rows.select("id", F.lit(None).cast("string").alias("group"), "len", "tf"), len(terms)).orderBy(F.desc("score"), "id").limit(pool)
        marked = rows.select("id", "keep", F.explode("groups").alias("group")).where("keep")
        near, text = near.select("id", "near", F.explode("groups").alias("group")), text.drop("group").join(marked.select("id", "group"), "id")
    else:
        marked = rows.select("id", "len", "tf", "near", F.explode("groups").alias("group"))
        near, text = marked.where("near IS NOT NULL").select("id", "near", "group"), weighed(marked.select("id", "group", "len", "tf"), len(terms))
    order = lambda c: Window.partitionBy("group").orderBy(F.desc(c), "id")
    near = near.withColumn("rank", F.row_number().over(order("near"))).where(F.col("rank") <= per_method).select("id", "group", F.col("near").alias("score"), "rank")
    text = text.withColumn("rank", F.row_number().over(order("score"))).where(F.col("rank") <= per_method).select("id", "group", "score", "rank")
    fused = fuse(near, text)
    if not grouped:
        return fused.orderBy(F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("fulltext_rank"), "id").limit(k)
    at = F.create_map(*[x for i, p in enumerate(project_ids) for x in (F.lit(p), F.lit(i))])
    by = Window.partitionBy("group").orderBy(F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("fulltext_rank"), "id")
    best = fused.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= per_project_k).withColumn("at", F.try_element_at(at, F.col("group"))).drop("_n")
    return best.orderBy(F.desc("rrf"), "at", "id").limit(k).orderBy("at", F.desc("rrf"), "id").drop("at")


def embed_question(spark, question: str, expansions: dict[str, list[str]] | None = None, instruction: str = "", dim: int = 64) -> list[float]:
    """The question's vector by the default embedder; expansions are appended as ``(A: x, y; B: z)``."""
    spelled = "; ".join(f"{a}: {', '.join(e)}" for a, e in (expansions or {}).items())
    text = f"{instruction}{question}" + (f"  ({spelled})" if spelled else "")
    return list(spark.range(1).select(hash_embedding(F.lit(text), dim).alias("v")).first().v)


def acronym_map(defines: DataFrame, most: int = 2) -> DataFrame:
    """``(acronym, expansions)``: up to ``most`` per acronym, by documents that define it, then by name."""
    counted = defines.groupBy("acronym", "expansion").agg(F.count_distinct("document").alias("n"))
    order = Window.partitionBy("acronym").orderBy(F.desc("n"), "expansion")
    best = counted.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    return best.groupBy("acronym").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "expansion"))), lambda x: x["expansion"]).alias("expansions"))


def expansions_for(question: str, known: DataFrame) -> dict[str, list[str]]:
    """Expansions of the acronyms a question holds and does not spell out, in order of first appearance."""
    tokens = list(dict.fromkeys(w for w in re.findall(r"\w[\w&/.'-]*", question) if len(w) >= 2 and sum(c.isupper() for c in w) >= 2))
    rows = {r.acronym: r.expansions for r in known.where(F.col("acronym").isin(tokens)).collect()} if tokens else {}
    out = {t: [e for e in rows.get(t, []) if e.lower() not in question.lower()] for t in tokens}
    return {t: e for t, e in out.items() if e}


def alias_acronyms(aliases: DataFrame) -> DataFrame:
    """``(document, acronym, expansion)`` of spellings that are acronyms: no blanks, two capitals or more, up to 16 characters; canonical names expand them."""
    capitals = F.length(F.regexp_replace("variant", "[^A-Z]", ""))
    rows = aliases.where(F.rlike("variant", F.lit(r"^[A-Z0-9][A-Za-z0-9&\-]{1,15}$")) & (capitals >= 2))
    return rows.select(F.lit("aliases").alias("document"), F.col("variant").alias("acronym"), F.col("canonical").alias("expansion"))


_maps: dict[tuple[int, str], list] = {}


def cached_map(defines: DataFrame, version: str) -> DataFrame:
    """:func:`acronym_map`, written once for a version of the graph; :func:`forget_maps` after an ingest."""
    key = (id(defines.sparkSession), version)
    if key not in _maps:
        _maps[key] = [materialize(acronym_map(defines), "acronym-map")]
    return _maps[key][0]


def forget_maps() -> None:
    _maps.clear()


def retrieve(context: DataFrame, question: str, vector: list[float] | None = None, project_ids: list[str] | None = None, countries: list[str] | None = None, section_types: list[str] | None = None, scope: str | None = None, k: int | None = None, per_project_k: int | None = None, include_front_matter: bool = False, known: DataFrame | None = None, embed: bool = False) -> dict:
    """The tool payload: ranked hits, or groups with the projects that gave none; bad arguments give ``{"error"}``.

    ``embed``: the question is embedded by :func:`embed_question` where no ``vector`` is given.
    """
    if scope is not None and scope not in SCOPES:
        return {"error": f"scope must be one of {', '.join(SCOPES)}"}
    if per_project_k and not project_ids:
        return {"error": "per_project_k needs project_ids"}
    per = min(max(per_project_k, 1), MOST_PER_PROJECT) if per_project_k else None
    k = min(max(k if k is not None else (per * len(project_ids) if per else 8), 1), MOST_K)
    spelled = expansions_for(question, known) if known is not None else {}
    if vector is None and embed:
        vector = embed_question(context.sparkSession, question, spelled)
    hits = search(context, question, vector, k, per, project_ids, spelled, countries=countries, types=section_types, scope=scope, include_front_matter=include_front_matter)
    facts = context.select(F.col("chunk_id").alias("id"), "project_id", "phase_project_id", F.col("name").alias("operation"), "country", F.col("path").alias("section_path"), F.col("type").alias("section_type"), F.col("subtype").alias("section_subtype"), "scope", F.col("kind").alias("chunk_kind"), "text")
    rows = [r.asDict(recursive=True) for r in hits.join(facts, "id").collect()]  # at most MOST_K rows
    at = {p: i for i, p in enumerate(project_ids or [])}
    rows.sort(key=lambda r: (at.get(r["group"], 0), -r["rrf"], r["vector_rank"] or 10**9, r["fulltext_rank"] or 10**9, r["id"]))
    shaped = [{"rank": i, "score": round(r["rrf"], 5), "chunk_id": r["id"], **{f: r[f] for f in ("project_id", "phase_project_id", "operation", "country", "section_path", "section_type", "section_subtype", "scope", "chunk_kind", "matched_by", "text", "group")}} for i, r in enumerate(rows, 1)]
    out = {"question": question, "expansions": spelled, "hits": [{f: v for f, v in h.items() if f != "group"} for h in shaped]}
    if per:
        out["groups"] = {p: [h["rank"] for h in shaped if h["group"] == p] for p in project_ids}
        out["projects_without_results"] = [p for p, found in out["groups"].items() if not found]
    return out
