"""The property graph as one DataFrame per label and per edge type, from extracted documents or from the delivered tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opgraph.functions.text import name_norm, org_key, redact_rows, usd
from opgraph.operators import graph
from opgraph.plans.keys import latest

Tables = dict[str, DataFrame]
Edges = dict[tuple[str, str, str], DataFrame]


def _edge(df: DataFrame, src: Column, dst: Column, *props: Column | str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.select(src.alias("src"), dst.alias("dst"), *props)


def _once(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropDuplicates(list(keys) or ["src", "dst"])


def organizations(records: DataFrame, world: DataFrame) -> DataFrame:
    """``(doc_id, role, source, key, name, country_iso2, is_category, part)`` of the lenders, sources and agencies of records.

    International names (``world``: name_norm) have one node in all countries, others one a country; a financing row without a
    source is a category of its label.
    """
    fin = records.select("doc_id", "country_iso2", F.explode("financing").alias("part")).select("doc_id", "country_iso2", F.lit("finances").alias("role"), F.col("part.source").alias("source"), F.coalesce("part.source", "part.label").alias("name"), "part")
    imp = records.select("doc_id", "country_iso2", F.explode("agencies").alias("a")).where("a.role = 'implementing_agency'")
    imp = imp.select("doc_id", "country_iso2", F.lit("implements").alias("role"), F.col("a.name").alias("source"), F.col("a.name").alias("name"))
    rows = fin.unionByName(imp, allowMissingColumns=True).withColumn("norm", name_norm(F.col("name")))
    rows = rows.join(world.select(F.col("name_norm").alias("norm"), F.lit(True).alias("_w")).distinct(), "norm", "left").withColumn("global", F.coalesce("_w", F.lit(False)) | F.col("source").isNull())
    return rows.select("doc_id", "role", "source", org_key(F.col("norm"), F.col("country_iso2"), F.col("global")).alias("key"), "name", F.when(~F.col("global"), F.col("country_iso2")).alias("country_iso2"), F.col("source").isNull().alias("is_category"), "part")


def _original(records: DataFrame) -> list[Column]:
    """Currency and amount before conversion, where the records carry them."""
    names = records.schema["financing"].dataType.elementType.names
    return [F.col("part.orig_currency").alias("orig_currency"), usd(F.col("part.orig_millions")).alias("orig_amount"), F.col("part.orig_from").alias("orig_from")] if "orig_currency" in names else []


def document_graph(records: DataFrame, secs: DataFrame, tabs: DataFrame, pairs: DataFrame, world: DataFrame, covers: DataFrame | None = None) -> tuple[Tables, Edges]:
    """(nodes by label, edges by (source label, type, target label)) of extracted documents.

    ``records``: rows of ``facts.complete_operations``; doc_id is the document's hash. ``secs``: sections with section_id and document_hash.
    ``tabs``: table_id, section_id, page, bbox, rows. ``pairs``: section_id, acronym, expansion. ``world``: name_norm of international organizations.
    Keys are merged as by ``graph.stage_nodes``: a full operation wins over the stub that another document's phase table makes of it.
    """
    d = records.where(F.col("project_id").isNotNull())
    total = lambda key: usd(F.try_element_at("totals", F.lit(key)))
    borrower = F.get(F.filter("agencies", lambda a: a["role"] == "borrower"), 0)["name"]
    ops = d.select(
        "project_id", "name", F.coalesce("country_canonical", "country").alias("country"), "country_iso2", "region", "region_source", "status", "status_source", "instrument", "instrument_text", "is_cerp", "has_ipf_component", "modalities",
        F.to_date("approval_date").alias("approval_date"), F.to_date("closing_date").alias("closing_date"), F.to_date("program_closing_date").alias("program_closing_date"), "overall_risk", "es_risk_rating", "practice_area_lead", "practice_areas_contributing",
        borrower.alias("borrower"), total("total_financing").alias("total_financing_usd"), total("financing_gap").alias("financing_gap_usd"), "pdo_text", F.lit(False).alias("stub"), F.col("doc_id").alias("_seq"))
    # a program's id stands in the headers of its documents; its phases are those of the framework table
    phases = d.where(F.col("program_id").isNotNull()).select("program_id", "doc_id", F.explode("phases").alias("p")).select("program_id", "doc_id", "p.*")
    phase_id = F.concat("program_id", F.lit(":phase:"), F.col("phase").cast("string"))
    stubs = phases.where(F.col("project_id").isNotNull() & ~F.col("is_this_operation")).select("project_id", "instrument", F.lit(True).alias("stub"), F.col("doc_id").alias("_seq"))
    orgs = organizations(d, world)
    section = secs.select(*[c for c in ("section_id", "document_hash", "order", "level", "title", "path", "page", "type", "subtype", "inherited", "scope", "phase", "phase_project_id", "parent", "text", "chars", "source") if c in secs.columns])
    docs = d.select(F.col("doc_id").alias("document_hash"), "project_id", "pdo_text")
    made = graph.pdo_sections(docs, secs.join(docs.select("document_hash", F.col("project_id").alias("_p")), "document_hash", "left").withColumn("project_id", F.coalesce("project_id", "_p")).where(~F.coalesce(F.col("inherited"), F.lit(False)))).drop("project_id")
    clean = redact_rows(F.col("rows"))
    document = d.select(F.col("doc_id").alias("hash"), "doc_type") if "doc_type" in d.columns else d.select(F.col("doc_id").alias("hash"))
    if covers is not None:
        document = document.join(covers.select(F.col("doc_id").alias("hash"), "report_number", "date"), "hash", "left")
    program = d.where(F.col("program_id").isNotNull())
    overall = F.get(F.filter("risks", lambda r: r["scope"] == "mpa_program"), 0)["rating"]
    risk = d.select("project_id", F.explode("risks").alias("r")).where("r.scope = 'operation'")
    nodes = {
        "Operation": graph.stage_nodes(ops.unionByName(stubs, allowMissingColumns=True), "project_id", "_seq"),
        "Program": graph.stage_edges(program.select("program_id", F.col("program_name").alias("name"), F.col("program_pdo_text").alias("pdo_text"), usd(F.col("envelope_millions")).alias("financing_envelope_usd"), overall.alias("overall_risk"), F.size("phases").alias("phases"), F.col("doc_id").alias("_seq")), ["program_id"], "_seq"),
        "Phase": graph.stage_edges(phases.select(phase_id.alias("phase_id"), "program_id", "phase", "label", "project_id", "instrument", "sequencing", usd(F.col("ibrd")).alias("ibrd_usd"), usd(F.col("ida")).alias("ida_usd"), usd(F.col("other")).alias("other_usd"), "estimated_approval", "es_risk_rating", F.col("doc_id").alias("_seq")), ["phase_id"], "_seq"),
        "Document": document, "Organization": orgs.groupBy(F.col("key").alias("name_norm")).agg(F.min("name").alias("name"), F.max("country_iso2").alias("country_iso2"), F.min("is_category").alias("is_category")),
        "Location": d.where(F.col("country_canonical").isNotNull()).groupBy(name_norm(F.col("country_canonical")).alias("name_norm")).agg(F.min("country_canonical").alias("name"), F.min("country_iso2").alias("iso2"), F.min("region").alias("region")),
        "Risk": risk.select(F.col("r.category").alias("name")).distinct(), "Acronym": pairs.select(F.col("acronym").alias("name")).distinct(),
        "Section": section.drop("parent").unionByName(made.withColumn("path", F.col("title")).withColumn("inherited", F.lit(False)), allowMissingColumns=True),
        "Table": tabs.select("table_id", "section_id", "page", "bbox", F.size(clean).alias("n_rows"), F.coalesce(F.array_max(F.transform(clean, F.size)), F.lit(0)).alias("n_cols"), F.to_json(clean).alias("rows_json")),
    }
    fin = orgs.where("role = 'finances'").join(d.select("doc_id", "project_id"), "doc_id")
    own = graph.has_section_edges(secs).unionByName(made.select(F.col("document_hash").alias("src"), F.col("section_id").alias("dst"), F.lit("HAS_SECTION").alias("type")))
    listed = pairs.join(secs.select("section_id", "document_hash"), "section_id")
    held = F.coalesce("part.detail", "part.group").alias("detail")
    edges = {
        ("Document", "DESCRIBES", "Operation"): _once(_edge(d, F.col("doc_id"), F.col("project_id"))),
        ("Operation", "LOCATED_IN", "Location"): _once(_edge(d, F.col("project_id"), name_norm(F.col("country_canonical")), where=F.col("country_canonical").isNotNull())),
        ("Organization", "FINANCES", "Operation"): graph.stage_edges(_edge(fin, F.col("key"), F.col("project_id"), held, F.col("part.amount_usd").alias("amount_usd"), *_original(d), F.col("part.category").alias("category"), F.col("part.side").alias("side"), F.col("part.group").alias("group"), F.col("doc_id").alias("_seq")), ["src", "dst", "detail"], "_seq"),
        ("Organization", "IMPLEMENTS", "Operation"): _once(_edge(orgs.where("role = 'implements'").join(d.select("doc_id", "project_id"), "doc_id"), F.col("key"), F.col("project_id"))),
        ("Operation", "HAS_RISK", "Risk"): _once(_edge(risk, F.col("project_id"), F.col("r.category"), F.col("r.rating").alias("rating"))),
        ("Program", "HAS_PHASE", "Phase"): _once(_edge(phases, F.col("program_id"), phase_id, "phase")),
        ("Phase", "HAS_OPERATION", "Operation"): _once(_edge(phases, phase_id, F.col("project_id"), where=F.col("project_id").isNotNull())),
        ("Document", "HAS_SECTION", "Section"): own.where("type = 'HAS_SECTION'").select("src", "dst"), ("Section", "HAS_SUBSECTION", "Section"): own.where("type = 'HAS_SUBSECTION'").select("src", "dst"),
        ("Section", "HAS_TABLE", "Table"): _edge(tabs, F.col("section_id"), F.col("table_id")), ("Document", "DEFINES", "Acronym"): _once(_edge(listed, F.col("document_hash"), F.col("acronym"), "expansion")),
    }
    return nodes, edges


def chunk_edges(chunks: DataFrame) -> Edges:
    return {("Section", "HAS_CHUNK", "Chunk"): _once(_edge(chunks, F.col("section_id"), F.col("chunk_id"), where=F.col("section_id").isNotNull())), ("Chunk", "NEXT_CHUNK", "Chunk"): graph.next_chunk(chunks)}


def table_graph(ops: DataFrame, secs: DataFrame, chunks: DataFrame, fin: DataFrame, orgs: DataFrame) -> tuple[Tables, Edges]:
    """The same from the delivered tables: labels and edges that they hold. Programs are the projects whose documents have phases.

    Risks are the overall and the environmental and social rating; acronyms are the lines of glossary chunks.
    """
    o, s = graph.operations(ops), latest(secs, "section_id", ["document_hash", "project_id", "order", "level", "title", "path", "page", "type", "subtype", "inherited", "scope", "phase", "phase_project_id", "parent", "chars"], "loaded_at")
    c = latest(chunks, "chunk_id", ["section_id", "order", "kind", "tokens", "page", "table_id"], "loaded_at")
    lines = latest(chunks.where("kind = 'glossary'"), "chunk_id", ["text"], "loaded_at").select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("document_hash"), F.explode(F.split("text", "\n")).alias("l"))
    pairs = lines.select("document_hash", F.regexp_extract("l", "^([^:]+): (.+)$", 1).alias("acronym"), F.regexp_extract("l", "^([^:]+): (.+)$", 2).alias("expansion")).where("acronym != ''")
    first = Window.partitionBy("document_hash", "acronym").orderBy("expansion")
    pairs = pairs.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    phases = s.where("phase IS NOT NULL AND project_id IS NOT NULL").select(F.col("project_id").alias("program_id"), "phase", F.col("phase_project_id").alias("project_id"))
    phase_id = F.concat("program_id", F.lit(":phase:"), F.col("phase").cast("string"))
    risk = o.select("project_id", F.explode(F.array(F.struct(F.lit("Overall").alias("category"), F.col("overall_risk").alias("rating")), F.struct(F.lit("Environmental and Social").alias("category"), F.col("es_risk_rating").alias("rating")))).alias("r")).where("r.rating IS NOT NULL")
    paid = graph.finances_edges(fin)
    tables = c.where("table_id IS NOT NULL")
    nodes = {
        "Operation": o, "Program": phases.select("program_id").distinct(), "Phase": phases.groupBy(phase_id.alias("phase_id"), "program_id", "phase").agg(F.min("project_id").alias("project_id")), "Document": s.select(F.col("document_hash").alias("hash")).where("hash IS NOT NULL").distinct(),
        "Organization": orgs, "Location": graph.locations(o), "Risk": risk.select(F.col("r.category").alias("name")).distinct(), "Acronym": pairs.select(F.col("acronym").alias("name")).distinct(),
        "Section": s, "Table": tables.groupBy("table_id").agg(F.min("section_id").alias("section_id"), F.min("page").alias("page")), "Chunk": c,
    }
    own = graph.has_section_edges(s)
    edges = {
        ("Document", "DESCRIBES", "Operation"): _once(_edge(s, F.col("document_hash"), F.col("project_id"), where=F.col("project_id").isNotNull())),
        ("Operation", "LOCATED_IN", "Location"): _edge(o, F.col("project_id"), name_norm(F.col("country")), where=F.col("country").isNotNull()),
        ("Organization", "FINANCES", "Operation"): _edge(paid, F.col("name_norm"), F.col("project_id"), "detail", "category", "amount_usd", "orig_currency", "orig_amount"),
        ("Operation", "HAS_RISK", "Risk"): _edge(risk, F.col("project_id"), F.col("r.category"), F.col("r.rating").alias("rating")),
        ("Program", "HAS_PHASE", "Phase"): _once(_edge(phases, F.col("program_id"), phase_id, "phase")), ("Phase", "HAS_OPERATION", "Operation"): _once(_edge(phases, phase_id, F.col("project_id"), where=F.col("project_id").isNotNull())),
        ("Document", "HAS_SECTION", "Section"): own.where("type = 'HAS_SECTION'").select("src", "dst"), ("Section", "HAS_SUBSECTION", "Section"): own.where("type = 'HAS_SUBSECTION'").select("src", "dst"),
        ("Section", "HAS_TABLE", "Table"): _once(_edge(tables, F.col("section_id"), F.col("table_id"))), ("Document", "DEFINES", "Acronym"): _edge(pairs, F.col("document_hash"), F.col("acronym"), "expansion"), **chunk_edges(c),
    }
    return nodes, edges


def counts(nodes: Tables, edges: Edges) -> DataFrame:
    """``(kind, name, n)``: rows of every label and every edge type."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.lit(label).alias("name"), "n") for label, df in nodes.items()]
    parts += [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.lit(kind).alias("name"), "n") for (_, kind, _), df in edges.items()]
    return reduce(DataFrame.unionByName, parts)


def resolved(nodes: Tables, edges: Edges) -> tuple[Edges, DataFrame]:
    """(edges whose two ends exist, ``(type, missing, n)`` of the others)."""
    kept, lost = {}, []
    for (a, kind, b), df in edges.items():
        ends = (nodes[a], graph.NODE_KEYS[a], nodes[b], graph.NODE_KEYS[b])
        kept[a, kind, b] = graph.resolve_ends(df, *ends)
        lost.append(graph.dangling(df, *ends).select(F.lit(kind).alias("type"), "missing", "n"))
    return kept, reduce(DataFrame.unionByName, lost)


def register(nodes: Tables, edges: Edges) -> None:
    """A view for every label and every edge type, for ad-hoc and pattern queries."""
    for label, df in nodes.items():
        df.createOrReplaceTempView(label)
    for (_, kind, _), df in edges.items():
        df.createOrReplaceTempView(kind)
