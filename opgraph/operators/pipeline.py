"""The offline build and incremental ingest: spans and tables in, versioned section, table, chunk and graph tables out.

Every stage is a DataFrame plan over all documents of the delivery, so one document and a million take the same
path. Tables are merged by key, and what a delivered document no longer has is removed; other documents
stay as they are. Running a delivery again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opgraph.functions.text import clean_cells, clean_text, heading_slug, redact_rows, redact_text
from opgraph.functions.vocab import CORE, SECTION_GROUPS, SECTION_TYPES
from opgraph.operators import build, chunking, facts, glossary, graph, index, layout, retrieve
from opgraph.plans.materialize import materialize
from opgraph.sources.readers import TABLES, prune_versions, read_spans, read_tables, read_version, write_version

COUNTRIES = "name_norm string, canonical string, iso2 string, region string"
API = "project_id string, region string, status string, api_status string"


def _addressed(secs: DataFrame) -> DataFrame:
    """Adds path and slug_path: titles and slugs from the root down, one join a level of ancestors."""
    up = secs.select("doc_id", F.col("order").alias("walk"), F.col("title").alias("t"), F.col("slug").alias("s"), F.col("parent").alias("next"))
    cur = secs.withColumn("path", F.col("title")).withColumn("slug_path", F.col("slug")).withColumn("walk", F.col("parent"))
    for _ in range(max(0, layout.deepest(secs) - 1)):
        cur = cur.join(up, ["doc_id", "walk"], "left").withColumn("path", F.when(F.col("t").isNotNull(), F.concat_ws(" > ", "t", "path")).otherwise(F.col("path")))
        cur = cur.withColumn("slug_path", F.when(F.col("s").isNotNull(), F.concat_ws("/", "s", "slug_path")).otherwise(F.col("slug_path"))).withColumn("walk", F.col("next")).drop("t", "s", "next")
    return cur.drop("walk")


def extract(spans: DataFrame, tables: DataFrame | None = None) -> dict[str, DataFrame]:
    """``rows``, ``sections`` (typed, scoped, addressed) and ``tables`` (each with its section) of span rows and detected tables."""
    spark = spans.sparkSession
    rows = materialize(layout.drop_boilerplate(layout.page_rows(spans)), "rows")
    real = materialize(layout.real_tables(tables if tables is not None else spark.createDataFrame([], TABLES)), "tables")
    secs = layout.parents(layout.assemble(layout.detect_headings(rows, real)))
    secs = materialize(layout.assign_types(secs, SECTION_TYPES, SECTION_GROUPS), "sections-typed")
    box = lambda i: F.get("bbox", i)
    owners = layout.table_owner(real.select("doc_id", "table_no", "page", box(1).alias("top"), box(3).alias("bottom")), secs)
    tabs = real.join(owners, ["doc_id", "table_no"]).withColumn("rows", clean_cells(F.col("rows")))
    secs = layout.assign_scope(secs, layout.framework_ids(secs, tabs)).withColumn("slug", heading_slug(F.col("title")))
    cur = _addressed(materialize(secs, "sections-scoped")).withColumnRenamed("doc_id", "document_hash").withColumn("section_id", F.col("order").cast("string"))
    numbered = graph.section_ids(cur, F.col("slug_path"))
    address = F.concat(F.col("document_hash"), F.lit(":"), F.col("slug_path"), F.lit("#"), F.col("occurrence").cast("string"))
    ids = layout.project_ids(rows).withColumnRenamed("doc_id", "document_hash")
    kinds = layout.document_types(rows).withColumnRenamed("doc_id", "document_hash")
    listed = F.when(F.col("order") == 0, F.lit(None)).otherwise(F.lit("font"))
    out = numbered.withColumn("section_id", address).withColumn("text", redact_text(F.col("text"))).withColumn("chars", F.length("text"))
    out = out.join(ids, "document_hash", "left").join(kinds, "document_hash", "left").withColumn("source", listed)
    out = materialize(out.select("section_id", "document_hash", "project_id", "doc_type", "order", "level", "title", "path", "page", "type", "subtype", "inherited", "scope", "phase", "phase_project_id", "parent", "text", "chars", "source"), "sections")
    held = tabs.withColumnRenamed("doc_id", "document_hash").join(out.select("document_hash", "order", "section_id"), ["document_hash", "order"])
    place = Window.partitionBy("section_id").orderBy("page", "table_no")
    held = held.withColumn("table_id", F.concat("section_id", F.lit(":t"), (F.row_number().over(place) - 1).cast("string")))
    return {"rows": rows, "sections": out, "tables": materialize(held.select("table_id", "section_id", "document_hash", "order", "table_no", "page", "bbox", "rows"), "section-tables")}


def extract_sections(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """The sections of :func:`extract`."""
    return extract(spans, tables)["sections"]


def records(found: dict[str, DataFrame], aliases: dict[str, str] | None = None, countries: DataFrame | None = None, api: DataFrame | None = None, as_of: str = "2024-01-01") -> DataFrame:
    """One completed record a document, from the tables of its data sheet section; documents without one have an empty form."""
    secs, tabs = found["sections"].withColumnRenamed("document_hash", "doc_id"), found["tables"].withColumnRenamed("document_hash", "doc_id")
    spark = secs.sparkSession
    sheets = facts.sheet_rows(secs, tabs).join(facts.sheet_rows(secs, tabs, "mpa_framework").withColumnRenamed("rows", "framework_rows"), "doc_id", "full")
    docs = secs.select("doc_id", "doc_type", F.col("project_id").alias("header_id")).distinct()
    parsed = facts.parse_sheets(docs.select("doc_id").join(sheets, "doc_id", "left"), aliases, "framework_rows")
    done = facts.complete_operations(
        parsed, docs.select("doc_id", "header_id"), countries if countries is not None else spark.createDataFrame([], COUNTRIES), api if api is not None else spark.createDataFrame([], API), as_of)
    own = done.select("doc_id", "project_id")
    program = facts.running_header(found["rows"].join(own, "doc_id").where(~F.contains("text", F.coalesce("project_id", F.lit("-")))).drop("project_id"))
    ticked = F.array_contains("modalities", "mpa")
    out = done.join(docs.select("doc_id", "doc_type"), "doc_id").join(program.select("doc_id", F.col("name").alias("_pn"), F.col("project_id").alias("_pi")), "doc_id", "left")
    out = out.withColumn("program_id", F.when(ticked, F.col("_pi"))).withColumn("program_name", F.when(ticked, F.col("_pn"))).drop("_pi", "_pn")
    return materialize(facts.with_cover_amounts(out, facts.cover_facts(found["rows"])), "records")


def section_chunks(secs: DataFrame, tabs: DataFrame | None = None, countries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, abbreviation pairs) of sections. ``countries``: document_hash, country of the head lines."""
    lists = secs.where("type = 'front_matter'")
    found = glossary.from_text(lists, "section_id")
    if tabs is not None:
        found = found.unionByName(glossary.from_tables(tabs.join(lists.select("section_id"), "section_id", "left_semi"), "section_id"))
    pairs = materialize(glossary.merge(found).withColumnRenamed("id", "section_id"), "pairs")
    with_country = secs.join(countries, "document_hash", "left") if countries is not None else secs.withColumn("country", F.lit(None).cast("string"))
    body = with_country.select("section_id", "project_id", "phase_project_id", "country", "path", "page", clean_text(F.col("text")).alias("text"))
    own = tabs.select("table_id", "section_id", "page", redact_rows(F.col("rows")).alias("rows")) if tabs is not None else None
    return chunking.build_chunks(body, pairs, own), pairs


def _merged(spark: SparkSession, root: str, name: str, fresh: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(old rows of other documents and the fresh ones, old table)."""
    old = read_version(spark, f"{root}/{name}")
    if old is None:
        return fresh, None
    key = next(c for c in ("section_id", "chunk_id", "table_id") if c in fresh.columns)
    kept = old.withColumn("_doc", F.split_part(key, F.lit(":"), F.lit(1))).join(docs.withColumnRenamed("document_hash", "_doc"), "_doc", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh), old


def ingest(spark: SparkSession, path: str, root: str, tables: str | None = None, aliases: dict[str, str] | None = None, countries: DataFrame | None = None, api: DataFrame | None = None, as_of: str = "2024-01-01") -> dict:
    """Merge a delivery of span lines (``.jsonl`` file or folder) into the tables below ``root``; counts and flags as payload.

    Written: sections, tables, chunks with vectors, the vector cache, and one table for every label and edge type of the graph. ``tables``: the
    detected tables of the same documents, as lines.
    """
    if path.endswith(".pdf"):
        return {"error": "decode the file to span lines first: doc_id, page, x0, y0, x1, y1, text, size, flags"}
    try:
        found = extract(read_spans(spark, path), read_tables(spark, tables) if tables else None)
    except Exception as e:
        return {"error": str(e).splitlines()[0][:300]}
    secs, tabs = found["sections"], found["tables"]
    sheet = records(found, aliases, countries, api, as_of)
    chunks, pairs = section_chunks(secs, tabs, sheet.select(F.col("doc_id").alias("document_hash"), F.coalesce("country_canonical", "country").alias("country")))
    cache = read_version(spark, f"{root}/vectors")
    chunks, cache = index.embed_with_cache(materialize(chunks, "ingest-chunks"), cache if cache is not None else spark.createDataFrame([], "key string, embedding array<float>"))
    chunks = materialize(chunks, "ingest-embedded")
    docs = secs.select("document_hash").distinct()
    world = spark.createDataFrame([(k,) for k in sorted(set((aliases or {}).values()))], "name string").select(F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " ")).alias("name_norm"))
    nodes, edges = build.document_graph(sheet, secs, tabs, pairs, world, facts.cover_facts(found["rows"]))
    nodes["Chunk"] = chunks.drop("embedding")
    edges |= build.chunk_edges(chunks)
    # chunks are switched first and sections last: a reader that sees a new section finds its chunks
    chunks_all, _ = _merged(spark, root, "chunks", chunks, docs)
    tabs_all, _ = _merged(spark, root, "tables", tabs, docs)
    secs_all, old_secs = _merged(spark, root, "sections", secs, docs)
    gone = graph.stale(old_secs, secs).count() if old_secs is not None else 0
    graph_counts = _write_graph(spark, root, nodes, edges, docs)
    for name, df in (("vectors", cache), ("chunks", chunks_all), ("tables", tabs_all), ("sections", secs_all)):
        write_version(df, f"{root}/{name}")
        prune_versions(spark, f"{root}/{name}")
    retrieve.forget_maps()
    by = {r.type: r.n for r in secs.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    flags = {
        "oversized": layout.size_flags(secs).count(), "results_words": layout.results_words(secs).count(), "missing_core": layout.missing_core(secs, CORE).count(),
        "key_risk_tables": layout.key_risk_tables(secs, tabs).count(), "records": {r.kind: r.n for r in sheet.select(F.explode("flags").alias("f")).groupBy("f.kind").agg(F.count(F.lit(1)).alias("n")).collect()}}
    return {"documents": docs.count(), "sections": sum(by.values()), "sections_by_type": by, "unmatched_headings": by.get("other", 0), "tables": tabs.count(), "chunks": chunks.count(), "acronyms": pairs.count(), "stale_sections": gone, "flags": flags, "graph": graph_counts}


#: Labels whose keys begin with the hash of their document: rows of delivered documents are replaced, not merged.
OF_DOCUMENT = ("Section", "Table", "Chunk")


def _write_graph(spark: SparkSession, root: str, nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], docs: DataFrame) -> dict:
    """Merge the staged graph into ``root/graph``; counts of nodes, of edges, and of edges left out for want of an end."""
    out: dict[str, dict] = {"nodes": {}, "edges": {}, "left_out": {}}
    now: dict[str, DataFrame] = {}
    of_doc = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    for label, df in nodes.items():
        key, place = graph.NODE_KEYS[label], f"{root}/graph/{label}"
        staged = graph.coerce(df)
        old = read_version(spark, place)
        if old is not None and label in OF_DOCUMENT:
            rest = old.withColumn("_d", of_doc(F.col(key))).join(docs.select(F.col("document_hash").alias("_d")), "_d", "left_anti").drop("_d")
            staged = rest.unionByName(staged, allowMissingColumns=True)
        elif old is not None:
            missing = [c for c in staged.columns if c not in old.columns]
            old = old.select("*", *[F.lit(None).cast(staged.schema[c].dataType).alias(c) for c in missing])
            if "stub" in staged.columns:
                staged = graph.upsert_nodes(old, staged, key)
            else:
                staged = graph.upsert_edges(old, staged, [key])
        write_version(staged, place)
        prune_versions(spark, place)
        now[label] = read_version(spark, place)
        out["nodes"][label] = now[label].count()
    for (a, kind, b), df in edges.items():
        place = f"{root}/graph/{kind}"
        ends = (now[a], graph.NODE_KEYS[a], now[b], graph.NODE_KEYS[b])
        df = materialize(df, "edges")
        old, staged = read_version(spark, place), graph.resolve_ends(df, *ends)
        keys = [c for c in ("src", "dst", "detail") if c in staged.columns]
        if old is not None:
            of_document = a in ("Document", *OF_DOCUMENT)
            rest = old.withColumn("_d", of_doc(F.col("src"))).join(docs.select(F.col("document_hash").alias("_d")), "_d", "left_anti").drop("_d") if of_document else old
            staged = rest.select(*staged.columns).unionByName(staged) if of_document else graph.upsert_edges(rest, staged, keys)
        write_version(staged, place)
        prune_versions(spark, place)
        out["edges"][kind] = read_version(spark, place).count()
        lost = {r.missing: r.n for r in graph.dangling(df, *ends).collect()}
        if lost:
            out["left_out"][kind] = lost
    return out
