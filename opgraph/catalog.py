"""Registered queries over the whole tables, and DuckDB SQL that states the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opgraph.functions import text as T
from opgraph.functions.vocab import CORE, SECTION_TYPES
from opgraph.operators import build, chunking, evaluate, facts, glossary, graph, index, layout, retrieve
from opgraph.operators.patterns import to_sql
from opgraph.operators.query import Rejected, check
from opgraph.plans.keys import latest, latest_wide
from opgraph.plans.materialize import shared_dir
from opgraph.session import table
from opgraph.sources.readers import html_rows
from opgraph.streaming.ingest import merge_latest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of DataFrames as a query over the named tables."""

    def add(build: Callable[..., DataFrame]):
        name = build.__name__
        _QUERIES[name] = lambda spark, sf_dir: build(*(table(spark, sf_dir, t) for t in tables))
        if sql:
            _SQL[name] = sql
        return build

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Views of the graph's labels and edges over the tables, for ad-hoc queries."""
    build.register(*build.table_graph(*(table(spark, sf_dir, t) for t in ("operations", "sections", "chunks", "finances", "organizations"))))


def _latest_sql(name: str, key: str) -> str:
    return f"(SELECT * FROM {name} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) = 1)"


OPS, SECS, CHUNKS, HITS = _latest_sql("operations", "project_id"), _latest_sql("sections", "section_id"), _latest_sql("chunks", "chunk_id"), _latest_sql("hits", "hit_id")
_FOLD = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
_NUMBERING = T.NUMBERING.replace("'", "''")
_BARE = f"regexp_replace(trim(title), '{_NUMBERING}', '')"


# ---- text functions -----------------------------------------------------------------------------------
@query("organizations", sql=f"SELECT name_norm AS id, {_FOLD.format('name')} AS folded FROM organizations WHERE name IS NOT NULL")
def name_norm(orgs):
    return orgs.where("name IS NOT NULL").select(F.col("name_norm").alias("id"), T.name_norm(F.col("name")).alias("folded"))


@query("documents", sql=f"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[email redacted]', 'g'), '{T.PHONE}', '[phone redacted]', 'g')) AS redacted FROM documents WHERE text IS NOT NULL""")
def redact_text(docs):
    return docs.where("text IS NOT NULL").select("doc_id", F.md5(T.redact_text(F.col("text"))).alias("redacted"))


@query("chunks", sql=f"""
    SELECT chunk_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x:
        trim(regexp_replace(regexp_replace(regexp_replace(x, '{T.TEMPLATE_MARK}', '', 'g'), '{T.EMAIL}', '[email redacted]', 'g'), '{T.PHONE}', '[phone redacted]', 'g'))),
        lambda x: x <> '' AND NOT regexp_matches(x, '{T.LEADER}')), chr(10))) AS cleaned
    FROM {CHUNKS} WHERE text IS NOT NULL""")
def clean_text(chunks):
    rows = latest_wide(chunks, "chunk_id", ["text"], "loaded_at").where("text IS NOT NULL")
    return rows.select("chunk_id", F.md5(T.clean_text(F.col("text"))).alias("cleaned"))


@query("sections", sql=f"""
    SELECT section_id, CASE {' '.join(f"WHEN regexp_matches(b, '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{k}'" for k, ps in SECTION_TYPES.items())} END AS subtype
    FROM (SELECT section_id, regexp_replace(lower(trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))), '\\s*-\\s*', '-', 'g') AS b FROM {SECS} WHERE title IS NOT NULL)""")
def classify_titles(secs):
    rows = latest(secs, "section_id", ["title"], "loaded_at").where("title IS NOT NULL")
    return rows.select("section_id", T.classify(F.col("title"), SECTION_TYPES).alias("subtype"))


_SLUG = f"regexp_replace(substr(replace({_FOLD.format(_BARE)}, ' ', '-'), 1, 60), '-+$', '')"


@query("sections", sql=f"SELECT section_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug, row_number() OVER (PARTITION BY document_hash, CASE WHEN s = '' THEN 'untitled' ELSE s END ORDER BY \"order\", section_id) - 1 AS occurrence FROM (SELECT *, {_SLUG} AS s FROM {SECS} WHERE title IS NOT NULL)")
def section_slugs(secs):
    rows = latest(secs, "section_id", ["title", "document_hash", "order"], "loaded_at").where("title IS NOT NULL")
    out = graph.section_ids(rows, T.heading_slug(F.col("title")))
    return out.select("section_id", F.col("slug_path").alias("slug"), F.col("occurrence").cast("long").alias("occurrence"))


@query("operations", sql=f"""SELECT project_id, '| ' || replace(project_id, '|', '\\|') || ' | ' || replace(coalesce(name, ''), '|', '\\|') || ' | ' || replace(coalesce(country, ''), '|', '\\|') || ' |' AS line FROM {OPS}""")
def markdown_rows(ops):
    return graph.operations(ops).select("project_id", T.md_row(F.array("project_id", "name", "country")).alias("line"))


@query("operations", sql=f"SELECT project_id, approval_date AS a, closing_date AS b, CASE WHEN approval_date IS NULL THEN NULL WHEN approval_date > DATE '2024-01-01' THEN 'Pipeline' WHEN closing_date < DATE '2024-01-01' THEN 'Closed' ELSE 'Active' END AS derived FROM {OPS}")
def dates_and_status(ops):
    rows = graph.operations(ops)
    a, b = T.iso_date(F.date_format("approval_date", "MMMM d, yyyy")), T.iso_date(F.date_format("closing_date", "d-MMM-yyyy"))
    return rows.select("project_id", a.alias("a"), b.alias("b"), T.derive_status(F.col("approval_date"), F.col("closing_date"), "2024-01-01").alias("derived"))


@query("finances", sql="SELECT name_norm, project_id, loaded_at, orig_amount AS amount, round_even(orig_amount * 1000000, 0)::BIGINT AS usd FROM finances WHERE orig_amount IS NOT NULL")
def usd_amounts(fin):
    rows = fin.where("orig_amount IS NOT NULL")
    text = F.format_number(F.abs("orig_amount"), 2)
    parsed = T.amount(F.when(F.col("orig_amount") < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text))
    return rows.select("name_norm", "project_id", "loaded_at", parsed.alias("amount"), T.usd(parsed).alias("usd"))


@query("sections", sql=f"""
    SELECT document_hash, acronym, min(expansion) AS expansion FROM (
      SELECT document_hash, regexp_extract(l, '^([A-Z0-9]+) ', 1) AS acronym, regexp_extract(l, '^[A-Z0-9]+ (.+)$', 1) AS expansion
      FROM (SELECT document_hash, unnest(string_split(text, chr(10))) AS l FROM {SECS} WHERE type = 'front_matter' AND text IS NOT NULL)
      WHERE regexp_matches(l, '^[A-Z][A-Z0-9]+ [A-Z][a-z]')) GROUP BY ALL""")
def acronym_lines(secs):
    rows = latest(secs, "section_id", ["document_hash", "type", "text"], "loaded_at").where("type = 'front_matter' AND text IS NOT NULL")
    lines = rows.select("document_hash", F.explode(F.split("text", "\n")).alias("l")).select("document_hash", T.split_acronym(F.col("l")).alias("p")).select("document_hash", "p.*")
    ok = lines.where(F.col("acronym").isNotNull() & F.col("expansion").isNotNull() & T.plausible_pair(F.col("acronym"), F.col("expansion")))
    return ok.groupBy("document_hash", "acronym").agg(F.min("expansion").alias("expansion"))


@query("sections", sql=f"""
    SELECT section_id AS id, acronym, arg_min(expansion, pos) AS expansion FROM (
      SELECT section_id, pos, regexp_extract(l, '^([A-Z0-9]+) ', 1) AS acronym, trim(regexp_extract(l, '^[A-Z0-9]+ (.+)$', 1)) AS expansion
      FROM (SELECT section_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {SECS} WHERE type = 'front_matter' AND text IS NOT NULL)
      WHERE regexp_matches(l, '^[A-Z][A-Z0-9]+ [A-Z][a-z]')) GROUP BY ALL""")
def glossary_pairs(secs):
    rows = latest(secs, "section_id", ["type", "text"], "loaded_at").where("type = 'front_matter' AND text IS NOT NULL")
    return glossary.merge(glossary.from_text(rows, "section_id", needs_start=False))


@query("chunks", sql=f"""
    WITH d AS (SELECT split_part(chunk_id, ':', 1) AS document, unnest(string_split(text, chr(10))) AS l FROM {CHUNKS} WHERE kind = 'glossary'),
    p AS (SELECT document, regexp_extract(l, '^([^:]+): (.+)$', 1) AS acronym, regexp_extract(l, '^([^:]+): (.+)$', 2) AS expansion FROM d WHERE regexp_matches(l, '^([^:]+): (.+)$')),
    c AS (SELECT acronym, expansion, count(DISTINCT document) AS n FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY acronym ORDER BY n DESC, expansion) AS rn FROM c QUALIFY rn <= 2)
    SELECT acronym, string_agg(expansion, '; ' ORDER BY rn) AS expansions FROM r GROUP BY acronym""")
def acronym_map(chunks):
    rows = latest(chunks, "chunk_id", ["kind", "text"], "loaded_at").where("kind = 'glossary'")
    lines = rows.select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("document"), F.explode(F.split("text", "\n")).alias("l"))
    pairs = lines.select("document", F.regexp_extract("l", "^([^:]+): (.+)$", 1).alias("acronym"), F.regexp_extract("l", "^([^:]+): (.+)$", 2).alias("expansion")).where("acronym != ''")
    return retrieve.acronym_map(pairs).select("acronym", F.array_join("expansions", "; ").alias("expansions"))


# ---- layout and chunking ------------------------------------------------------------------------------
@query("documents", sql="""
    WITH r AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
    k AS (SELECT *, lower(trim(regexp_replace(l, '[0-9\\s]+', ' ', 'g'))) AS key FROM r),
    p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM r GROUP BY source),
    o AS (SELECT source, key FROM k JOIN p USING (source) GROUP BY source, key, pages HAVING count(DISTINCT doc_id) >= greatest(3, 0.02 * pages))
    SELECT source, count(*) AS kept FROM k ANTI JOIN o USING (source, key) GROUP BY source""")
def boilerplate_rows(docs):
    rows = docs.where("text IS NOT NULL AND source IS NOT NULL").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return layout.drop_boilerplate(rows, "source", "doc_id", "text", share=0.02).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


@query("sections", sql=f"""
    WITH s AS (SELECT * FROM {SECS}) SELECT a.section_id, max(b."order") AS parent FROM s a LEFT JOIN s b ON a.document_hash = b.document_hash AND b."order" < a."order" AND b.level < a.level AND b.level > 0 GROUP BY a.section_id""")
def section_parents(secs):
    rows = latest(secs, "section_id", ["document_hash", "order", "level"], "loaded_at")
    return layout.parents(rows, "document_hash").select("section_id", "parent")


@query("sections", sql=f"""
    WITH s AS (SELECT * FROM {SECS} WHERE NOT coalesce(inherited, false) AND chars > 0),
    m1 AS (SELECT subtype, median(chars) AS m1 FROM s WHERE subtype IS NOT NULL GROUP BY subtype HAVING count(*) >= 3),
    m2 AS (SELECT type, median(chars) AS m2 FROM s WHERE type IS NOT NULL GROUP BY type HAVING count(*) >= 3)
    SELECT section_id, chars, coalesce(m1, m2)::DOUBLE AS median FROM s LEFT JOIN m1 USING (subtype) LEFT JOIN m2 USING (type) WHERE chars > 3 * coalesce(m1, m2)""")
def oversized_sections(secs):
    return layout.size_flags(latest(secs, "section_id", ["type", "subtype", "inherited", "chars"], "loaded_at"))


@query("sections", sql=f"SELECT section_id, len(regexp_extract_all(text, '(?i)\\b(?:baselines?|targets?|indicators?)\\b')) AS n FROM {SECS} WHERE subtype = 'key_risks' AND len(regexp_extract_all(text, '(?i)\\b(?:baselines?|targets?|indicators?)\\b')) >= 3")
def results_words(secs):
    return layout.results_words(latest_wide(secs, "section_id", ["subtype", "text"], "loaded_at"))


@query("sections", sql=f"""
    WITH s AS (SELECT * FROM {SECS}), need AS (SELECT DISTINCT document_hash, unnest([{', '.join(f"'{c}'" for c in CORE)}]) AS subtype FROM s)
    SELECT * FROM need ANTI JOIN (SELECT DISTINCT document_hash, subtype FROM s WHERE scope = 'main' AND NOT coalesce(inherited, false)) h USING (document_hash, subtype)""")
def missing_core(secs):
    return layout.missing_core(latest(secs, "section_id", ["document_hash", "scope", "subtype", "inherited"], "loaded_at"), CORE)


@query("sections", sql=f"""
    WITH RECURSIVE d AS (SELECT section_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM {SECS} WHERE text IS NOT NULL),
    b AS (SELECT id, w, len(w) AS n FROM d WHERE len(w) > 0),
    step(id, n, k, s, e) AS (
      SELECT id, n, 0, 0, CASE WHEN n <= 400 THEN n ELSE coalesce(list_max(list_filter(range(300, 401), lambda j: j > 1 AND regexp_matches(w[j], '[.;:!?]["”’)\\]]*$'))), 400) END FROM b
      UNION ALL
      SELECT id, n, k + 1, s2, CASE WHEN e0 = n THEN n ELSE coalesce(list_max(list_filter(range(e0 - 100, e0 + 1), lambda j: j > s2 + 1 AND regexp_matches(w[j], '[.;:!?]["”’)\\]]*$'))), e0) END
      FROM (SELECT step.id, step.n, step.k, b.w, greatest(step.e - 50, step.s + 1) AS s2, least(greatest(step.e - 50, step.s + 1) + 400, step.n) AS e0 FROM step JOIN b USING (id) WHERE step.e < step.n))
    SELECT id, k AS n, s AS "start", e AS "end" FROM step""")
def text_windows(secs):
    rows = latest_wide(secs, "section_id", ["text"], "loaded_at")
    return chunking.text_windows(rows, "section_id").select("id", "n", "start", "end")


@query("chunks", sql=f"SELECT chunk_id AS src, nxt AS dst FROM (SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY section_id ORDER BY \"order\", chunk_id) AS nxt FROM {CHUNKS}) WHERE nxt IS NOT NULL")
def next_chunk(chunks):
    return graph.next_chunk(latest(chunks, "chunk_id", ["section_id", "order"], "loaded_at"))


@query("chunks", "sections", sql=f"""
    WITH s AS (SELECT document_hash AS d, section_id, page, "order" AS o FROM {SECS}), c AS (SELECT chunk_id, split_part(chunk_id, ':', 1) AS d, page FROM {CHUNKS} WHERE page IS NOT NULL)
    SELECT chunk_id, arg_max(section_id, (s.page, o)) AS owner FROM c LEFT JOIN s ON s.d = c.d AND s.page <= c.page GROUP BY chunk_id""")
def page_owner(chunks, secs):
    """As-of: the last section that starts on or before a chunk's page. One sort per document, no range join."""
    s = latest(secs, "section_id", ["document_hash", "page", "order"], "loaded_at").select(F.col("document_hash").alias("d"), "page", F.lit(0).alias("is_chunk"), F.col("order").alias("o"), "section_id", F.lit(None).cast("string").alias("chunk_id")).where("page IS NOT NULL")
    c = latest(chunks, "chunk_id", ["page"], "loaded_at").where("page IS NOT NULL").select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("d"), "page", F.lit(1).alias("is_chunk"), F.lit(None).cast("int").alias("o"), F.lit(None).cast("string").alias("section_id"), "chunk_id")
    order = Window.partitionBy("d").orderBy("page", "is_chunk", "o").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(c).withColumn("owner", F.last("section_id", ignorenulls=True).over(order)).where("is_chunk = 1").select("chunk_id", "owner")


# ---- graph ----------------------------------------------------------------------------------------------
@query("sections", sql=f"""
    WITH s AS (SELECT * FROM {SECS}) SELECT coalesce(p.section_id, a.document_hash) AS src, a.section_id AS dst, CASE WHEN p.section_id IS NULL THEN 'HAS_SECTION' ELSE 'HAS_SUBSECTION' END AS type
    FROM s a LEFT JOIN s p ON a.document_hash = p.document_hash AND a.parent = p."order" """)
def section_edges(secs):
    return graph.has_section_edges(graph.sections(secs, "document_hash", "order", "parent"))


@query("sections", sql=f"""
    WITH RECURSIVE s AS (SELECT * FROM {SECS}),
    e AS (SELECT coalesce(p.section_id, a.document_hash) AS src, a.section_id AS dst FROM s a LEFT JOIN s p ON a.document_hash = p.document_hash AND a.parent = p."order"),
    t(root, node, hops) AS (SELECT DISTINCT document_hash, document_hash, 0 FROM s UNION SELECT root, dst, hops + 1 FROM t JOIN e ON t.node = e.src WHERE hops < 16)
    SELECT root, node, min(hops) AS hops FROM t GROUP BY root, node""")
def section_tree(secs):
    s = graph.sections(secs, "document_hash", "order", "parent")
    return graph.descendants(graph.has_section_edges(s), s.select("document_hash"))


@query("operations", sql=f"SELECT country, count(*) AS n, string_agg(project_id, ',' ORDER BY project_id) AS projects FROM {OPS} WHERE overall_risk = 'High' GROUP BY country")
def rated_operations(ops):
    return graph.rated(graph.operations(ops), "High")


_FIN = "(SELECT * FROM (SELECT name_norm, project_id, coalesce(detail, category) AS detail, category, amount_usd, orig_currency, orig_amount, loaded_at FROM finances) QUALIFY row_number() OVER (PARTITION BY name_norm, project_id, detail ORDER BY loaded_at DESC, category DESC, amount_usd DESC, orig_currency DESC, orig_amount DESC) = 1)"


@query("finances", sql=f"SELECT name_norm, project_id, detail, category, amount_usd FROM {_FIN}")
def finances_edges(fin):
    return graph.finances_edges(fin).select("name_norm", "project_id", "detail", "category", "amount_usd")


@query("finances", "organizations", "operations", sql=f"""
    SELECT o.project_id, o.country, g.name_norm AS source, f.detail, f.amount_usd, f.orig_currency FROM {_FIN} f JOIN organizations g ON g.name_norm = f.name_norm JOIN {OPS} o ON o.project_id = f.project_id""")
def financing_by_source(fin, orgs, ops):
    e = graph.finances_edges(fin).join(orgs.select("name_norm"), "name_norm").join(graph.operations(ops).select("project_id", "country"), "project_id")
    return e.select("project_id", "country", F.col("name_norm").alias("source"), "detail", "amount_usd", "orig_currency")


@query("finances", "organizations", sql=f"SELECT name_norm, count(DISTINCT project_id) AS n_ops FROM {_FIN} f SEMI JOIN (SELECT name_norm FROM organizations WHERE NOT coalesce(is_category, false)) g USING (name_norm) WHERE project_id IS NOT NULL GROUP BY name_norm HAVING n_ops >= 2")
def multi_financiers(fin, orgs):
    return graph.multi_financiers(graph.finances_edges(fin), orgs)


@query("operations", "sections", sql=f"""
    SELECT o.project_id, count(s.section_id) AS phase_sections FROM {OPS} o LEFT JOIN (SELECT * FROM {SECS} WHERE scope <> 'main') s USING (project_id) GROUP BY o.project_id""")
def optional_phase(ops, secs):
    s = latest(secs, "section_id", ["project_id", "scope"], "loaded_at").where("scope != 'main'").groupBy("project_id").agg(F.count(F.lit(1)).alias("phase_sections"))
    return graph.operations(ops).select("project_id").join(s, "project_id", "left").select("project_id", F.coalesce("phase_sections", F.lit(0)).cast("long").alias("phase_sections"))


_STAGE = ", ".join(f"CASE WHEN bool_or(NOT coalesce(stub, false)) THEN arg_max({c}, loaded_at) FILTER ({c} IS NOT NULL AND NOT coalesce(stub, false)) ELSE arg_max({c}, loaded_at) FILTER ({c} IS NOT NULL) END AS {c}" for c in ("name", "country", "status"))


@query("operations", sql=f"SELECT project_id, {_STAGE}, NOT bool_or(NOT coalesce(stub, false)) AS stub FROM operations GROUP BY project_id")
def node_staging(ops):
    return graph.stage_nodes(ops.select("project_id", "name", "country", "status", "stub", "loaded_at"), "project_id", "loaded_at")


_EARLY = "TIMESTAMP '2024-01-01 12:00:00'"


@query("operations", sql=f"""
    WITH a AS (SELECT project_id, {_STAGE}, NOT bool_or(NOT coalesce(stub, false)) AS stub FROM operations WHERE loaded_at < {_EARLY} GROUP BY project_id),
    b AS (SELECT project_id, {_STAGE}, NOT bool_or(NOT coalesce(stub, false)) AS stub FROM operations WHERE loaded_at >= {_EARLY} GROUP BY project_id)
    SELECT coalesce(a.project_id, b.project_id) AS project_id, CASE WHEN a.project_id IS NOT NULL AND coalesce(b.stub, true) THEN a.name ELSE coalesce(b.name, a.name) END AS name,
      CASE WHEN a.project_id IS NOT NULL AND coalesce(b.stub, true) THEN a.country ELSE coalesce(b.country, a.country) END AS country,
      CASE WHEN a.project_id IS NOT NULL AND coalesce(b.stub, true) THEN a.status ELSE coalesce(b.status, a.status) END AS status,
      CASE WHEN a.project_id IS NOT NULL THEN a.stub AND coalesce(b.stub, true) ELSE b.stub END AS stub
    FROM a FULL JOIN b ON a.project_id = b.project_id""")
def node_upsert(ops):
    """What was delivered later is merged into what was delivered before."""
    rows = ops.select("project_id", "name", "country", "status", "stub", "loaded_at")
    cut = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    before, after = (graph.stage_nodes(rows.where(c), "project_id", "loaded_at") for c in (F.col("loaded_at") < cut, F.col("loaded_at") >= cut))
    return graph.upsert_nodes(before, after, "project_id")


@query("sections", sql=f"""
    WITH s AS (SELECT * FROM {SECS}), k AS (SELECT document_hash, section_id FROM s WHERE text IS NOT NULL AND text <> '')
    SELECT section_id FROM s SEMI JOIN (SELECT DISTINCT document_hash FROM k) d USING (document_hash) ANTI JOIN k USING (document_hash, section_id)""")
def stale_sections(secs):
    s = latest(secs, "section_id", ["document_hash", "text"], "loaded_at")
    return graph.stale(s.select("document_hash", "section_id"), s.where("text != ''").select("document_hash", "section_id")).select("section_id")


@query("chunks", "sections", sql="SELECT DISTINCT section_id FROM chunks ANTI JOIN sections USING (section_id) WHERE section_id IS NOT NULL")
def missing_sections(chunks, secs):
    return graph.missing_parents(chunks, secs)


@query("hits", sql="SELECT hit_id, count(*) AS n FROM hits GROUP BY hit_id HAVING n > 1")
def duplicate_keys(hits):
    return graph.duplicate_keys(hits, "hit_id")


@query("operations", "sections", "chunks", "organizations", sql="SELECT 'Operation' AS label, count(*) AS n FROM operations UNION ALL SELECT 'Section', count(*) FROM sections UNION ALL SELECT 'Chunk', count(*) FROM chunks UNION ALL SELECT 'Organization', count(*) FROM organizations")
def schema_counts(ops, secs, chunks, orgs):
    return graph.schema_counts({"Operation": ops, "Section": secs, "Chunk": chunks, "Organization": orgs}).select("label", "n")


@query("operations", "sections", "chunks", sql=" UNION ALL ".join(f"(SELECT DISTINCT '{c}' AS vocab, {c} AS value FROM {t} WHERE {c} IS NOT NULL)" for t, cs in (("operations", ("country", "region", "status", "instrument", "overall_risk")), ("sections", ("type", "subtype", "scope")), ("chunks", ("kind",))) for c in cs))
def vocabulary(ops, secs, chunks):
    return graph.vocabulary(ops, secs, chunks)


@query("operations", sql=f"SELECT {_FOLD.format('country')} AS name_norm, max(country) AS name, max(country_iso2) AS iso2, max(region) AS region FROM {OPS} WHERE country IS NOT NULL GROUP BY 1")
def locations(ops):
    return graph.locations(graph.operations(ops))


@query("organizations", "org_aliases", sql=f"""
    WITH a AS (SELECT {_FOLD.format('variant')} AS v, min(canonical) AS canonical FROM org_aliases GROUP BY 1)
    SELECT name_norm, coalesce(a.canonical, o.name) AS canonical FROM organizations o LEFT JOIN a ON a.v = {_FOLD.format('o.name')}""")
def alias_lookup(orgs, aliases):
    a = aliases.groupBy(T.name_norm(F.col("variant")).alias("v")).agg(F.min("canonical").alias("canonical"))
    return orgs.withColumn("v", T.name_norm(F.col("name"))).join(a, "v", "left").select("name_norm", F.coalesce("canonical", "name").alias("canonical"))


@query("finances", "operations", sql=f"""
    WITH p AS (SELECT project_id AS doc_id, row_number() OVER (PARTITION BY project_id ORDER BY name_norm, detail, amount_usd) AS part, amount_usd / 1e6 AS m FROM {_FIN} WHERE amount_usd IS NOT NULL AND project_id IS NOT NULL),
    c AS (SELECT project_id AS doc_id, total_financing_usd / 1e6 AS u FROM {OPS} WHERE total_financing_usd IS NOT NULL)
    SELECT doc_id, min(part)::INT AS part, 0 AS cover FROM p JOIN c USING (doc_id) WHERE abs(m - u) <= 0.01 * greatest(1, u) GROUP BY doc_id""")
def tolerance_match(fin, ops):
    order = Window.partitionBy("project_id").orderBy("name_norm", "detail", "amount_usd")
    rows = graph.finances_edges(fin).where("amount_usd IS NOT NULL AND project_id IS NOT NULL")
    parts = rows.select(F.col("project_id").alias("doc_id"), F.row_number().over(order).alias("part"), (F.col("amount_usd") / 1e6).alias("amount_millions"))
    covers = graph.operations(ops).where("total_financing_usd IS NOT NULL").select(F.col("project_id").alias("doc_id"), F.lit(0).alias("cover"), (F.col("total_financing_usd") / 1e6).alias("usd_millions"))
    return facts.match_amounts(parts, covers)


@query("hits", sql=f"""
    WITH a AS (SELECT * FROM hits WHERE hit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at) = 1), b AS (SELECT * FROM {HITS}),
    x AS (SELECT a.hit_id, unnest([{{'field': 'project_id', 'own': coalesce(a.project_id, ''), 'other': coalesce(b.project_id, '')}}, {{'field': 'rank', 'own': coalesce(a.rank::VARCHAR, ''), 'other': coalesce(b.rank::VARCHAR, '')}}, {{'field': 'chunk_id', 'own': coalesce(a.chunk_id, ''), 'other': coalesce(b.chunk_id, '')}}]) AS s FROM a JOIN b USING (hit_id))
    SELECT hit_id, s.field, s.own, s.other FROM x WHERE s.own <> '' AND s.other <> '' AND lower(s.own) <> lower(s.other)""")
def corrected_fields(hits):
    """Fields that a later delivery of a hit changed: two records of one key compared field by field."""
    cols = ["project_id", "rank", "chunk_id"]
    first = hits.where("hit_id IS NOT NULL").groupBy("hit_id").agg(F.min(F.struct("loaded_at", *cols)).alias("r")).select("hit_id", *[F.col("r")[c].alias(c) for c in cols])
    return facts.conflicts(first, latest(hits, "hit_id", cols, "loaded_at"), "hit_id", cols)


@query("finances", sql="SELECT category, orig_currency, grouping_id(category, orig_currency) AS g, count(*) AS n, sum(amount_usd)::BIGINT AS usd FROM finances GROUP BY ROLLUP (category, orig_currency)")
def financing_rollup(fin):
    return fin.rollup("category", "orig_currency").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("amount_usd").alias("usd"))


@query("operations", "hits", "finances", sql="""
    SELECT 'all' AS op, count(*) AS n FROM (SELECT project_id FROM operations UNION ALL SELECT project_id FROM finances)
    UNION ALL SELECT 'both', count(*) FROM (SELECT project_id FROM hits INTERSECT SELECT project_id FROM finances)
    UNION ALL SELECT 'only', count(*) FROM (SELECT project_id FROM operations EXCEPT SELECT project_id FROM hits)""")
def set_operations(ops, hits, fin):
    o, h, f = (df.select("project_id") for df in (ops, hits, fin))
    n = lambda df, label: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("op"), "n")
    return n(o.unionByName(f), "all").unionByName(n(h.intersect(f), "both")).unionByName(n(o.subtract(h), "only"))


def pattern_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financiers of more than one operation, as a pattern query compiled to SQL over the graph's views."""
    register_views(spark, sf_dir)
    return spark.sql(to_sql("MATCH (g:Organization)-[f:FINANCES]->(o:Operation) WHERE f.amount_usd > 0 AND o.status = 'Active' RETURN g.name_norm AS name_norm, count(*) AS n ORDER BY n DESC, name_norm"))


_QUERIES["pattern_query"] = pattern_query
_SQL["pattern_query"] = f"SELECT g.name_norm, count(*) AS n FROM organizations g JOIN {_FIN} f ON f.name_norm = g.name_norm JOIN {OPS} o ON o.project_id = f.project_id WHERE f.amount_usd > 0 AND o.status = 'Active' GROUP BY g.name_norm"


def _pattern(name: str, text: str, sql: str) -> None:
    """Register a pattern query over the graph's views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir)
        return spark.sql(to_sql(text))

    _QUERIES[name], _SQL[name] = run, sql


_pattern("pattern_risks", "MATCH (o:Operation)-[r:HAS_RISK]->(k:Risk) WHERE r.rating = 'High' RETURN k.name AS risk, count(*) AS n, min(o.project_id + ' ' + coalesce(o.country, '?')) AS first ORDER BY risk", f"""
    SELECT risk, count(*) AS n, min(project_id || ' ' || coalesce(country, '?')) AS first FROM (SELECT 'Overall' AS risk, * FROM {OPS} WHERE overall_risk = 'High' UNION ALL SELECT 'Environmental and Social', * FROM {OPS} WHERE es_risk_rating = 'High') GROUP BY risk""")
_pattern("pattern_with", "MATCH (g:Organization)-[:FINANCES]->(o:Operation) WHERE NOT coalesce(g.is_category, false) WITH g, collect(DISTINCT o.project_id) AS ops WHERE size(ops) > 1 RETURN g.name_norm AS name_norm, size(ops) AS n ORDER BY n DESC", f"""
    SELECT name_norm, count(DISTINCT f.project_id) AS n FROM {_FIN} f JOIN organizations g USING (name_norm) JOIN {OPS} o USING (project_id) WHERE NOT coalesce(g.is_category, false) GROUP BY name_norm HAVING n > 1""")
_pattern("pattern_tree", "MATCH (d:Document)-[:HAS_SECTION]->(top:Section) OPTIONAL MATCH (top)-[:HAS_SUBSECTION*]->(sub:Section) WHERE sub.type <> 'other' RETURN top.section_id AS top, count(sub.section_id) AS n ORDER BY top", f"""
    WITH RECURSIVE s AS (SELECT * FROM {SECS}), e AS (SELECT p.section_id AS src, a.section_id AS dst FROM s a JOIN s p ON a.document_hash = p.document_hash AND a.parent = p."order"),
    t AS (SELECT section_id AS top FROM s WHERE document_hash IS NOT NULL AND section_id NOT IN (SELECT dst FROM e)), w(top, node) AS (SELECT top, dst FROM t JOIN e ON e.src = t.top UNION SELECT top, dst FROM w JOIN e ON e.src = w.node)
    SELECT t.top, count(s.section_id) AS n FROM t LEFT JOIN w USING (top) LEFT JOIN s ON s.section_id = w.node AND s.type <> 'other' GROUP BY t.top""")
_pattern("pattern_optional", "MATCH (o:Operation) OPTIONAL MATCH (o)-[:LOCATED_IN]->(l) RETURN o.project_id AS pid, head(collect(l.name_norm)) AS place, head(labels(o)) AS label, size(keys(o)) > 1 AS full", f"SELECT project_id AS pid, CASE WHEN country IS NOT NULL THEN {_FOLD.format('country')} END AS place, 'Operation' AS label, true AS full FROM {OPS}")
_pattern("pattern_lists", "MATCH (o:Operation) WHERE size(o.modalities) > 0 WITH o.project_id AS pid, [m IN o.modalities WHERE size(split(m, ' ')) < 9 | toUpper(left(m, 3))] AS short UNWIND short[0..2] AS m RETURN pid, m, reduce(n = 0, x IN short | n + 1) AS n", f"""
    SELECT pid, unnest(short[1:2]) AS m, len(short) AS n FROM (SELECT project_id AS pid, list_transform(list_filter(modalities, lambda m: len(string_split(m, ' ')) < 9), lambda m: upper(m[1:3])) AS short FROM {OPS} WHERE len(modalities) > 0)""")
_pattern("pattern_walk", "MATCH (s:Section {subtype: 'key_risks'})<-[:HAS_SECTION|HAS_SUBSECTION*]-(d:Document)-[:DESCRIBES]->(o:Operation) MATCH (s)-[:HAS_CHUNK]->(c:Chunk) WHERE c.kind = 'text' RETURN DISTINCT o.project_id AS pid, c.chunk_id AS chunk, c.`order` AS place", f"""
    SELECT DISTINCT o.project_id AS pid, c.chunk_id AS chunk, c."order" AS place FROM {SECS} s JOIN (SELECT DISTINCT document_hash, project_id FROM {SECS}) d USING (document_hash) JOIN {OPS} o ON o.project_id = d.project_id JOIN {CHUNKS} c USING (section_id) WHERE s.subtype = 'key_risks' AND c.kind = 'text'""")


def readonly_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the guard on reads and writes; nothing of them runs."""
    statements = ["SELECT 1 AS x", "DROP TABLE t", "CREATE VIEW v AS SELECT 1", "INSERT INTO t VALUES (1)", "EXECUTE IMMEDIATE 'drop table t'", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM nowhere"]
    out = []
    for s in statements:
        try:
            check(spark, s, set())
            out.append((s, True))
        except Rejected:
            out.append((s, False))
    return spark.createDataFrame(out, "statement string, allowed boolean")


_QUERIES["readonly_guard"] = readonly_guard
_SQL["readonly_guard"] = """SELECT * FROM (VALUES ('SELECT 1 AS x', true), ('DROP TABLE t', false), ('CREATE VIEW v AS SELECT 1', false), ('INSERT INTO t VALUES (1)', false), ('EXECUTE IMMEDIATE ''drop table t''', false),
    ('SELECT reflect(''java.lang.System'', ''exit'', 1)', false), ('SELECT * FROM parquet.`/tmp/x`', false), ('SELECT * FROM nowhere', false)) AS t(statement, allowed)"""


# ---- retrieval and evaluation ---------------------------------------------------------------------------
TERMS = ["water", "tariffs", "households"]
QUESTION = "How do water tariffs affect households?"
VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"
_CONTEXT = f"SELECT c.chunk_id AS id, c.text, c.embedding, c.kind, s.type, s.project_id FROM {CHUNKS} c JOIN {SECS} s USING (section_id) WHERE s.type <> 'front_matter' OR c.kind = 'glossary'"


def _bm25_sql(source: str) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(TERMS)))
    s = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(TERMS)))
    return f"""SELECT id, round(0.0 + {s}, 6) AS score FROM (SELECT id, len(w) AS l, {tf} FROM (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {source})) b,
      (SELECT count(*) AS n, avg(l) AS a, {df} FROM (SELECT len(w) AS l, {tf} FROM (SELECT list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {source}))) WHERE t0 + t1 + t2 > 0"""


def _vector_sql(source: str) -> str:
    bad = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR_SQL}), 6) AS score FROM {source} WHERE len(embedding) = 64 AND {bad}"


def _context(chunks, secs, ops):
    return retrieve.chunk_context(chunks, secs, ops)


@query("chunks", sql=f"WITH c AS (SELECT chunk_id AS id, text FROM {CHUNKS}) SELECT * FROM ({_bm25_sql('c')}) ORDER BY score DESC, id LIMIT 20")
def bm25_topk(chunks):
    rows = latest_wide(chunks, "chunk_id", ["text"], "loaded_at")
    return index.top(index.bm25(rows, TERMS, "chunk_id")).select("id", "score")


@query("chunks", sql=f"WITH c AS (SELECT chunk_id AS id, embedding FROM {CHUNKS}) SELECT * FROM ({_vector_sql('c')}) ORDER BY score DESC, id LIMIT 20")
def vector_topk(chunks):
    rows = latest_wide(chunks, "chunk_id", ["embedding"], "loaded_at")
    return index.top(index.vector_scores(rows, VECTOR, "chunk_id")).select("id", "score")


def _ranked_sql(name: str, scores: str) -> str:
    return f"{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({scores}) QUALIFY r <= 20)"


def _fused_sql(source: str, k: int) -> str:
    return f"""(WITH {_ranked_sql("v", _vector_sql(source))}, {_ranked_sql("t", _bm25_sql(source))}
      SELECT coalesce(v.id, t.id) AS id, round(coalesce(1 / (60 + v.r), 0) + coalesce(1 / (60 + t.r), 0), 9) AS rrf, v.r AS vr, t.r AS tr
      FROM v FULL JOIN t ON v.id = t.id ORDER BY rrf DESC, vr ASC NULLS LAST, tr ASC NULLS LAST, 1 LIMIT {k})"""


@query("chunks", "sections", "operations", sql=f"WITH c AS ({_CONTEXT}) SELECT id, rrf FROM {_fused_sql('c', 8)}")
def hybrid_rrf(chunks, secs, ops):
    """Flagship: filtered context, exact cosine and BM25 ranks, reciprocal rank fusion, top 8."""
    terms = " ".join(TERMS)
    return retrieve.search(_context(chunks, secs, ops), terms, VECTOR, 8).select("id", "rrf")


@query("chunks", "sections", "operations", sql=f"""
    WITH c AS ({_CONTEXT}), c0 AS (SELECT * FROM c WHERE project_id = 'P1000101'), c1 AS (SELECT * FROM c WHERE project_id = 'P1000102')
    SELECT id, rrf, 'P1000101' AS "group" FROM {_fused_sql('c0', 3)} UNION ALL SELECT id, rrf, 'P1000102' FROM {_fused_sql('c1', 3)}""")
def hybrid_grouped(chunks, secs, ops):
    """Three hits from each of two projects."""
    ctx = _context(chunks, secs, ops).withColumn("phase_project_id", F.lit(None).cast("string"))
    return retrieve.search(ctx, " ".join(TERMS), VECTOR, 6, 3, ["P1000101", "P1000102"]).select("id", "rrf", "group")


@query("chunks", "sections", "operations", sql=f"""
    SELECT c.chunk_id FROM {CHUNKS} c JOIN {SECS} s USING (section_id) LEFT JOIN {OPS} o USING (project_id)
    WHERE ({_FOLD.format('o.country')} = 'quorania' OR o.country_iso2 = 'XP') AND (s.type IN ('context', 'risks') OR s.subtype IN ('context', 'risks')) AND s.scope = 'main' AND (s.type <> 'front_matter' OR c.kind = 'glossary')""")
def retrieval_filtered(chunks, secs, ops):
    keep = retrieve.context_filter(countries=["Quorania", "XP"], types=["context", "risks"], scope="main")
    return _context(chunks, secs, ops).where(keep).select("chunk_id")


@query("hits", sql=f"SELECT hit_id, round(coalesce(1 / (60 + vector_rank), 0) + coalesce(1 / (60 + fulltext_rank), 0), 9) AS rrf FROM {HITS}")
def rrf_scores(hits):
    part = lambda c: F.coalesce(1 / (index.RRF_K + F.col(c)), F.lit(0.0))
    return latest(hits, "hit_id", ["vector_rank", "fulltext_rank"], "loaded_at").select("hit_id", F.round(part("vector_rank") + part("fulltext_rank"), 9).alias("rrf"))


@query("hits", sql=f"SELECT question_id, project_id, hit_id FROM {HITS} WHERE project_id IS NOT NULL AND vector_score IS NOT NULL AND NOT isnan(vector_score) QUALIFY row_number() OVER (PARTITION BY question_id, project_id ORDER BY vector_score DESC, hit_id) <= 2")
def top_per_question(hits):
    rows = latest(hits, "hit_id", ["question_id", "project_id", "vector_score"], "loaded_at").where("project_id IS NOT NULL AND vector_score IS NOT NULL AND NOT isnan(vector_score)")
    order = Window.partitionBy("question_id", "project_id").orderBy(F.desc("vector_score"), "hit_id")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn <= 2").select("question_id", "project_id", "hit_id")


@query("hits", sql=f"""
    WITH h AS (SELECT * FROM {HITS}), e AS (SELECT question_id, list(DISTINCT project_id) AS projects FROM h WHERE fulltext_rank = 1 AND project_id IS NOT NULL GROUP BY question_id),
    j AS (SELECT e.question_id, e.projects, h.project_id, CASE WHEN list_contains(e.projects, h.project_id) THEN h.rank END AS joint FROM e JOIN h USING (question_id))
    SELECT question_id, round(len(list_intersect(any_value(projects), list(DISTINCT project_id) FILTER (project_id IS NOT NULL))) / len(any_value(projects)), 6) AS recall, min(joint) AS joint_rank, round(coalesce(1 / min(joint), 0), 6) AS rr FROM j GROUP BY question_id""")
def eval_scores(hits):
    h = latest(hits, "hit_id", ["question_id", "project_id", "rank", "fulltext_rank"], "loaded_at").withColumns({"type": F.lit(None).cast("string"), "subtype": F.lit(None).cast("string"), "scope": F.lit(None).cast("string")})
    e = h.where("fulltext_rank = 1 AND project_id IS NOT NULL").groupBy("question_id").agg(F.collect_set("project_id").alias("projects"))
    e = e.withColumns({"types": F.array().cast("array<string>"), "want_scope": F.lit(None).cast("string")})
    return evaluate.score_retrieval(h, e).select("question_id", F.round("recall", 6).alias("recall"), "joint_rank", F.round("rr", 6).alias("rr"))


@query("hits", sql=f"""
    WITH h AS (SELECT question_id, hit_id, rank, coalesce(matched_by[1], 'none') AS tool FROM {HITS} WHERE question_id IS NOT NULL),
    c AS (SELECT *, CASE WHEN lag(tool) OVER w IS DISTINCT FROM tool THEN 1 ELSE 0 END AS c FROM h WINDOW w AS (PARTITION BY question_id ORDER BY rank, hit_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY question_id ORDER BY rank, hit_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
    g AS (SELECT question_id, run, tool, count(*) AS n FROM r GROUP BY ALL)
    SELECT question_id, string_agg(CASE WHEN n > 1 THEN tool || ' ×' || n ELSE tool END, ' → ' ORDER BY run) AS route FROM g GROUP BY question_id""")
def routes(hits):
    h = latest(hits, "hit_id", ["question_id", "rank", "matched_by"], "loaded_at").where("question_id IS NOT NULL")
    rows = h.select("question_id", F.struct("rank", "hit_id").alias("at"), F.coalesce(F.get("matched_by", 0), F.lit("none")).alias("tool"))
    return evaluate.routes(rows, "question_id", "at")


@query("chunks", sql=f"""
    SELECT kind, count(*) AS n, quantile_cont(tokens, 0.1)::DOUBLE AS p10, quantile_cont(tokens, 0.5)::DOUBLE AS p50, quantile_cont(tokens, 0.9)::DOUBLE AS p90, round(avg(tokens), 6) AS mean, count(*) FILTER (tokens > 400) AS over FROM {CHUNKS} GROUP BY kind""")
def token_stats(chunks):
    q = lambda p: F.expr(f"percentile(tokens, {p})")
    rows = latest(chunks, "chunk_id", ["kind", "tokens"], "loaded_at")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.round(F.avg("tokens"), 6).alias("mean"), F.count_if(F.col("tokens") > 400).alias("over"))


@query("chunks", "sections", sql=f"""
    SELECT coalesce(project_id, '(all)') AS project, count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind = 'table') AS "table", count(*) FILTER (kind = 'glossary') AS glossary
    FROM {CHUNKS} c JOIN (SELECT section_id, project_id FROM {SECS} WHERE project_id IS NOT NULL) s USING (section_id) GROUP BY ROLLUP (project_id)""")
def chunk_counts(chunks, secs):
    rows = latest(chunks, "chunk_id", ["section_id", "kind"], "loaded_at").join(latest(secs, "section_id", ["project_id"], "loaded_at").where("project_id IS NOT NULL"), "section_id")
    return rows.rollup("project_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("text", "table", "glossary")]).withColumnRenamed("project_id", "project").fillna("(all)", ["project"])


@query("hits", sql=f"SELECT hit_id, project_id, rank, CASE WHEN NOT isnan(rrf) THEN rrf END AS rrf, coalesce(isnan(rrf), false) AS rrf_is_nan, loaded_at FROM {HITS}")
def ingest_latest(hits):
    """The table that the upsert stream holds after all deliveries; the table keeps NaN, here a flag stands for it."""
    rows = merge_latest(None, hits.select("hit_id", "project_id", "rank", "rrf", "loaded_at"), "hit_id", "loaded_at")
    nan = F.coalesce(F.isnan("rrf"), F.lit(False))
    return rows.select("hit_id", "project_id", "rank", F.when(~nan, F.col("rrf")).alias("rrf"), nan.alias("rrf_is_nan"), "loaded_at")


@query("hits", sql=f"SELECT time_bucket(INTERVAL 1 HOUR, asked_at) AS hour, project_id, count(*) AS hits FROM {HITS} WHERE project_id IS NOT NULL AND asked_at IS NOT NULL GROUP BY ALL")
def hits_per_hour(hits):
    rows = latest(hits, "hit_id", ["project_id", "asked_at"], "loaded_at").where("project_id IS NOT NULL AND asked_at IS NOT NULL")
    return rows.groupBy(F.window("asked_at", "1 hour")["start"].alias("hour"), "project_id").agg(F.count(F.lit(1)).alias("hits"))


# ---- derived nodes and layers ---------------------------------------------------------------------------
@query("operations", "sections", sql=f"""
    WITH s AS (SELECT * FROM {SECS}), d AS (SELECT DISTINCT s.document_hash, s.project_id, o.pdo_text FROM s JOIN {OPS} o USING (project_id) WHERE o.pdo_text IS NOT NULL AND o.pdo_text <> '')
    SELECT document_hash || ':project-development-objective-datasheet#0' AS section_id, project_id, -1 AS "order", length(pdo_text) AS chars FROM d
    ANTI JOIN (SELECT document_hash FROM s WHERE subtype = 'development_objective' AND (scope = 'main' OR phase_project_id = project_id)) x USING (document_hash)""")
def pdo_sections(ops, secs):
    s = graph.sections(secs, "document_hash", "project_id", "subtype", "scope", "phase_project_id")
    docs = s.select("document_hash", "project_id").distinct().join(graph.operations(ops).select("project_id", "pdo_text"), "project_id")
    return graph.pdo_sections(docs, s).select("section_id", "project_id", "order", "chars")


@query("sections", "operations", sql=f"SELECT DISTINCT phase_project_id AS project_id, true AS stub FROM {SECS} s WHERE phase_project_id IS NOT NULL AND phase_project_id NOT IN (SELECT project_id FROM {OPS})")
def phase_stubs(secs, ops):
    phases = latest(secs, "section_id", ["phase_project_id"], "loaded_at").select(F.col("phase_project_id").alias("project_id"))
    return graph.phase_stubs(phases, graph.operations(ops))


@query("operations", "finances", "organizations", sql=f"""
    WITH o AS (SELECT * FROM {OPS}), p AS (SELECT DISTINCT name_norm, project_id FROM {_FIN} WHERE project_id IS NOT NULL)
    SELECT 'LOCATED_IN' AS type, count(*) AS n FROM o WHERE country IS NOT NULL
    UNION ALL SELECT 'FINANCES', count(*) FROM p SEMI JOIN organizations USING (name_norm) SEMI JOIN o USING (project_id)""")
def layer_edges(ops, fin, orgs):
    _, edges = graph.operations_layer(graph.operations(ops), graph.finances_edges(fin), orgs)
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("sections", sql=f"SELECT document_hash, count(*) AS rows, count(subtype) AS subtype, count(text) AS text FROM {SECS} GROUP BY document_hash")
def section_summary(secs):
    from opgraph.sources.sinks import summary

    return summary(graph.sections(secs, "document_hash", "subtype", "text"), "document_hash", ["subtype", "text"])


# ---- the whole graph ------------------------------------------------------------------------------------
_PHASES = f"(SELECT project_id AS program_id, phase, phase_project_id AS project_id FROM {SECS} WHERE phase IS NOT NULL AND project_id IS NOT NULL)"
_DEFINES = f"(SELECT split_part(chunk_id, ':', 1) AS d, regexp_extract(l, '^([^:]+): (.+)$', 1) AS acronym FROM (SELECT chunk_id, unnest(string_split(text, chr(10))) AS l FROM {CHUNKS} WHERE kind = 'glossary') WHERE regexp_matches(l, '^([^:]+): (.+)$') GROUP BY ALL)"
_RISKS = f"(SELECT project_id, unnest([{{'c': 'Overall', 'r': overall_risk}}, {{'c': 'Environmental and Social', 'r': es_risk_rating}}]) AS x FROM {OPS})"
_COUNTS = {
    ("node", "Operation"): f"FROM {OPS}", ("node", "Program"): f"FROM (SELECT DISTINCT program_id FROM {_PHASES})", ("node", "Phase"): f"FROM (SELECT DISTINCT program_id, phase FROM {_PHASES})",
    ("node", "Document"): f"FROM (SELECT DISTINCT document_hash FROM {SECS} WHERE document_hash IS NOT NULL)", ("node", "Organization"): "FROM organizations", ("node", "Location"): f"FROM (SELECT DISTINCT {_FOLD.format('country')} FROM {OPS} WHERE country IS NOT NULL)",
    ("node", "Risk"): f"FROM (SELECT DISTINCT x.c FROM {_RISKS} WHERE x.r IS NOT NULL)", ("node", "Acronym"): f"FROM (SELECT DISTINCT acronym FROM {_DEFINES})", ("node", "Section"): f"FROM {SECS}",
    ("node", "Table"): f"FROM (SELECT DISTINCT table_id FROM {CHUNKS} WHERE table_id IS NOT NULL)", ("node", "Chunk"): f"FROM {CHUNKS}",
    ("edge", "DESCRIBES"): f"FROM (SELECT DISTINCT document_hash, project_id FROM {SECS} WHERE project_id IS NOT NULL)", ("edge", "LOCATED_IN"): f"FROM {OPS} WHERE country IS NOT NULL", ("edge", "FINANCES"): f"FROM {_FIN}",
    ("edge", "HAS_RISK"): f"FROM {_RISKS} WHERE x.r IS NOT NULL", ("edge", "HAS_PHASE"): f"FROM (SELECT DISTINCT program_id, phase FROM {_PHASES})", ("edge", "HAS_OPERATION"): f"FROM (SELECT DISTINCT * FROM {_PHASES} WHERE project_id IS NOT NULL)",
    ("edge", "HAS_SECTION"): f"FROM {SECS} a LEFT JOIN {SECS} p ON a.document_hash = p.document_hash AND a.parent = p.\"order\" WHERE p.section_id IS NULL", ("edge", "HAS_SUBSECTION"): f"FROM {SECS} a JOIN {SECS} p ON a.document_hash = p.document_hash AND a.parent = p.\"order\"",
    ("edge", "HAS_TABLE"): f"FROM (SELECT DISTINCT section_id, table_id FROM {CHUNKS} WHERE table_id IS NOT NULL)", ("edge", "DEFINES"): f"FROM {_DEFINES}", ("edge", "HAS_CHUNK"): f"FROM {CHUNKS} WHERE section_id IS NOT NULL",
    ("edge", "NEXT_CHUNK"): f"FROM (SELECT lead(chunk_id) OVER (PARTITION BY section_id ORDER BY \"order\", chunk_id) AS nxt FROM {CHUNKS}) WHERE nxt IS NOT NULL",
}


@query("operations", "sections", "chunks", "finances", "organizations", sql=" UNION ALL ".join(f"(SELECT '{k}' AS kind, '{n}' AS name, count(*) AS n {q})" for (k, n), q in _COUNTS.items()))
def graph_counts(ops, secs, chunks, fin, orgs):
    """Rows of all labels and edge types that the tables hold."""
    return build.counts(*build.table_graph(ops, secs, chunks, fin, orgs))


@query("operations", "sections", "chunks", "finances", "organizations", sql=f"""
    SELECT 'FINANCES' AS type, CASE WHEN g.name_norm IS NULL THEN 'source' ELSE 'target' END AS missing, count(*) AS n FROM {_FIN} f LEFT JOIN organizations g USING (name_norm) LEFT JOIN {OPS} o ON o.project_id = f.project_id WHERE g.name_norm IS NULL OR o.project_id IS NULL GROUP BY 2
    UNION ALL SELECT 'DESCRIBES', 'target', count(*) FROM (SELECT DISTINCT document_hash, project_id FROM {SECS} WHERE project_id IS NOT NULL) s ANTI JOIN {OPS} o USING (project_id) HAVING count(*) > 0
    UNION ALL SELECT 'HAS_OPERATION', 'target', count(*) FROM (SELECT DISTINCT * FROM {_PHASES} WHERE project_id IS NOT NULL) s ANTI JOIN {OPS} o USING (project_id) HAVING count(*) > 0
    UNION ALL SELECT 'HAS_CHUNK', 'source', count(*) FROM {CHUNKS} c ANTI JOIN {SECS} s USING (section_id) WHERE section_id IS NOT NULL HAVING count(*) > 0
    UNION ALL SELECT 'HAS_TABLE', 'source', count(*) FROM (SELECT DISTINCT section_id, table_id FROM {CHUNKS} WHERE table_id IS NOT NULL) c ANTI JOIN {SECS} s USING (section_id) HAVING count(*) > 0""")
def left_out_edges(ops, secs, chunks, fin, orgs):
    """Edges that a load leaves out, as one of their ends does not exist."""
    return build.resolved(*build.table_graph(ops, secs, chunks, fin, orgs))[1]


@query("operations", "finances", "organizations", "sections", sql=f"""
    WITH o AS (SELECT * FROM {OPS}), p AS (SELECT DISTINCT name_norm, project_id FROM {_FIN} WHERE project_id IS NOT NULL), h AS (SELECT DISTINCT * FROM {_PHASES})
    SELECT 'LOCATED_IN' AS type, count(*) AS n FROM o WHERE country IS NOT NULL UNION ALL SELECT 'FINANCES', count(*) FROM p SEMI JOIN organizations USING (name_norm) SEMI JOIN o USING (project_id)
    UNION ALL SELECT 'HAS_RISK', count(*) FROM o WHERE overall_risk = 'High' UNION ALL SELECT 'HAS_PHASE', count(*) FROM (SELECT DISTINCT program_id, phase FROM h) HAVING count(*) > 0
    UNION ALL SELECT 'HAS_OPERATION', count(*) FROM h SEMI JOIN o USING (project_id) HAVING count(*) > 0""")
def full_layer(ops, fin, orgs, secs):
    """Edges of the operations layer with high risks, phases and programs."""
    o = graph.operations(ops)
    risks = o.where("overall_risk IS NOT NULL").select("project_id", F.lit("Overall").alias("category"), F.col("overall_risk").alias("rating"))
    s = latest(secs, "section_id", ["project_id", "phase", "phase_project_id"], "loaded_at").where("phase IS NOT NULL AND project_id IS NOT NULL")
    phases = s.select(F.col("project_id").alias("program_id"), "phase", F.col("phase_project_id").alias("project_id")).distinct()
    _, edges = graph.operations_layer(o, graph.finances_edges(fin), orgs, risks, phases)
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("sections", "chunks", sql=f"SELECT c.chunk_id FROM {CHUNKS} c SEMI JOIN (WITH s AS (SELECT * FROM {SECS}), k AS (SELECT document_hash, section_id FROM s WHERE text IS NOT NULL AND text <> '') SELECT section_id FROM s SEMI JOIN (SELECT DISTINCT document_hash FROM k) d USING (document_hash) ANTI JOIN k USING (document_hash, section_id)) g USING (section_id)")
def stale_chunks(secs, chunks):
    """Chunks that go with stale sections."""
    s = latest(secs, "section_id", ["document_hash", "text"], "loaded_at")
    gone = graph.stale(s.select("document_hash", "section_id"), s.where("text != ''").select("document_hash", "section_id"))
    return graph.stale_parts(latest(chunks, "chunk_id", ["section_id"], "loaded_at"), gone).select("chunk_id")


# ---- data sheets: forms written from the tables are read back ---------------------------------------------
def _forms(ops: DataFrame) -> DataFrame:
    """A form per operation, with the labels of its type and the values of its row."""
    o = graph.operations(ops)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    day = lambda c: F.coalesce(F.date_format(c, "d-MMM-yyyy"), F.lit(""))
    line = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    instrument = F.when(F.col("instrument") == "IPF", "Investment Project Financing").when(F.col("instrument") == "PforR", "Program-for-Results Financing").when(F.col("instrument") == "DPF", "Development Policy Financing").otherwise("")
    money = F.coalesce(F.format_number(F.col("total_financing_usd") / 1e6, 2), F.lit(""))
    rows = F.array(
        line("Operation ID", "Financing Instrument", "Environmental and Social Risk Classification"), line(F.col("project_id"), instrument, text("es_risk_rating")), line(""), line("Operation Name", "Country"), line(text("name"), text("country")),
        line("Expected Approval Date", "Expected Closing Date"), line(day("approval_date"), day("closing_date")), line("Proposed Development Objective"), line(text("pdo_text")), line("Organizations"), line(F.concat(F.lit("Borrower: "), text("borrower"))),
        line("Total Financing", money), line("1. Political and Governance", text("es_risk_rating")), line("Overall", text("overall_risk")))
    return o.select(F.col("project_id").alias("doc_id"), rows.alias("rows"))


_TIDY = "nullif(trim(regexp_replace({}, '\\s+', ' ', 'g')), '')"


@query("operations", sql=f"""
    SELECT project_id AS doc_id, project_id, {_TIDY.format('name')} AS name, {_TIDY.format('country')} AS country, CASE WHEN instrument IN ('IPF', 'PforR', 'DPF') THEN instrument END AS instrument, approval_date::VARCHAR AS approval_date, closing_date::VARCHAR AS closing_date,
      CASE WHEN es_risk_rating IN ('Low', 'Moderate', 'Substantial', 'High') THEN es_risk_rating END AS es_risk_rating, CASE WHEN overall_risk IN ('Low', 'Moderate', 'Substantial', 'High') THEN overall_risk END AS overall_risk,
      {_TIDY.format('pdo_text')} AS pdo_text, {_TIDY.format('borrower')} AS borrower, round(total_financing_usd / 1e6, 2) AS total_financing FROM {OPS}""")
def sheet_facts(ops):
    """Header and value cells, dates, ratings, objective, borrower and totals of forms."""
    d = facts.parse_sheets(_forms(ops))
    borrower = F.get(F.filter("agencies", lambda a: a["role"] == "borrower"), 0)["name"]
    return d.select("doc_id", "project_id", "name", "country", "instrument", "approval_date", "closing_date", "es_risk_rating", "overall_risk", "pdo_text", borrower.alias("borrower"), F.round(F.try_element_at("totals", F.lit("total_financing")), 2).alias("total_financing"))


@query("operations", sql=f"""
    SELECT project_id AS doc_id, m.field, m.kind FROM (SELECT project_id, unnest([{{'field': 'name', 'kind': 'unparsed', 'v': name}}, {{'field': 'country', 'kind': 'unparsed', 'v': country}}, {{'field': 'approval_date', 'kind': 'unparsed', 'v': approval_date::VARCHAR}},
      {{'field': 'overall_risk', 'kind': 'unparsed', 'v': overall_risk}}, {{'field': 'pdo_text', 'kind': 'unparsed', 'v': pdo_text}}, {{'field': 'practice_area_lead', 'kind': 'absent', 'v': NULL}}]) AS m FROM {OPS}) WHERE {_TIDY.format('m.v')} IS NULL""")
def sheet_missing(ops):
    """Fields without a value: unparsed where the form has their label, else absent."""
    rows = facts.parse_sheets(_forms(ops)).select("doc_id", F.explode("missing").alias("m")).select("doc_id", "m.field", "m.kind")
    return rows.where(F.col("field").isin("name", "country", "approval_date", "overall_risk", "pdo_text", "practice_area_lead"))


_PAID = f"(SELECT project_id, category, coalesce(detail, category) AS detail, amount_usd FROM {_FIN} WHERE project_id IS NOT NULL AND amount_usd > 0 AND coalesce(detail, category) IS NOT NULL)"


def _financing_forms(fin: DataFrame) -> DataFrame:
    """Forms of the positive amounts of a project: a group line a project, then a line a part, by amount and label."""
    rows = graph.finances_edges(fin).where("project_id IS NOT NULL AND amount_usd > 0 AND detail IS NOT NULL").select("project_id", (F.col("amount_usd") / 1e6).alias("m"), F.concat(F.lit("Part "), F.md5("detail")).alias("label"))
    held = rows.groupBy("project_id").agg(F.round(F.sum("m"), 0).alias("total"), F.sort_array(F.collect_list(F.struct("m", "label"))).alias("parts"))
    money = lambda c: F.format_number(c, 6)
    parts = F.transform("parts", lambda p: F.array(p["label"], money(p["m"])))
    return held.select(F.col("project_id").alias("doc_id"), F.concat(F.array(F.array(F.lit("International Development Association (IDA)"), money(F.col("total")))), parts).alias("rows"))


@query("finances", sql=f"SELECT project_id AS doc_id, 'Part ' || md5(detail) AS label, 'IDA' AS source, amount_usd FROM {_PAID}")
def sheet_financing(fin):
    """Parts of a lender's group with their source."""
    d = facts.parse_sheets(_financing_forms(fin), fields=["financing"]).select("doc_id", F.explode("financing").alias("f"))
    return d.select("doc_id", "f.label", "f.source", "f.amount_usd")


@query("finances", sql=f"SELECT project_id AS doc_id, abs(round(sum(amount_usd) / 1e6, 0) - sum(amount_usd) / 1e6) <= 0.01 AS balanced FROM {_PAID} GROUP BY project_id")
def sheet_balance(fin):
    """Whether the parts of a group add up to it, which states whole millions."""
    d = facts.parse_sheets(_financing_forms(fin), fields=["financing"]).select("doc_id", F.explode("financing").alias("f"))
    return d.groupBy("doc_id").agg(F.max("f.balanced").alias("balanced"))


@query("finances", sql="SELECT name_norm, project_id, loaded_at, 'credit' AS kind, upper(orig_currency) AS currency, round(abs(orig_amount), 4) AS amount_millions, abs(amount_usd) / 1e6 AS usd_millions FROM finances WHERE orig_amount IS NOT NULL AND amount_usd IS NOT NULL AND length(orig_currency) = 3")
def cover_lines(fin):
    """Amounts proposed on covers, read back from the lines that state them."""
    rows = fin.where("orig_amount IS NOT NULL AND amount_usd IS NOT NULL AND length(orig_currency) = 3")
    line = F.concat(F.lit("PROPOSED CREDIT IN THE AMOUNT OF "), F.upper("orig_currency"), F.lit(" "), F.format_number(F.abs("orig_amount"), 6), F.lit(" MILLION (US$"), F.format_number(F.abs(F.col("amount_usd")) / 1e6, 6), F.lit(" MILLION EQUIVALENT) TO X"))
    read = rows.select("name_norm", "project_id", "loaded_at", F.explode(T.cover_amounts(line)).alias("a"))
    return read.select("name_norm", "project_id", "loaded_at", "a.kind", "a.currency", F.round("a.amount_millions", 4).alias("amount_millions"), "a.usd_millions")


@query("operations", sql=f"SELECT project_id, approval_date AS date FROM {OPS} WHERE approval_date IS NOT NULL")
def cover_dates(ops):
    rows = graph.operations(ops).where("approval_date IS NOT NULL")
    return rows.select("project_id", T.cover_date(F.concat(F.lit("Report No: X1 "), F.date_format("approval_date", "MMMM d, yyyy"), F.lit(" Region"))).alias("date"))


_FIRST = "(SELECT * FROM operations WHERE project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY loaded_at, name, country, status, region) = 1)"


@query("operations", sql=f"""
    WITH m AS (SELECT project_id, coalesce({_TIDY.format('a.name')}, {_TIDY.format('b.name')}) AS name, coalesce({_TIDY.format('a.country')}, {_TIDY.format('b.country')}) AS country, coalesce({_TIDY.format('a.status')}, {_TIDY.format('b.status')}) AS status, coalesce({_TIDY.format('a.region')}, {_TIDY.format('b.region')}) AS region FROM {OPS} a FULL JOIN {_FIRST} b USING (project_id))
    SELECT *, CASE WHEN (name IS NOT NULL)::INT + (country IS NOT NULL)::INT + (status IS NOT NULL)::INT + (region IS NOT NULL)::INT >= 4 THEN 'ok' WHEN coalesce(name, country, status, region) IS NOT NULL THEN 'sparse' ELSE 'not_found' END AS api_status FROM m""")
def merged_api(ops):
    """Newer records filled from older ones, with their status."""
    cols = ["name", "country", "status", "region"]
    first = ops.where("project_id IS NOT NULL").groupBy("project_id").agg(F.min(F.struct("loaded_at", *cols)).alias("r")).select("project_id", *[F.col("r")[c].alias(c) for c in cols])
    return facts.merge_api(graph.operations(ops).select("project_id", *cols), first, "project_id", cols, enough=4)


# ---- more text functions ------------------------------------------------------------------------------------
@query("organizations", sql="SELECT name_norm, CASE WHEN regexp_matches(name, '\\(([A-Z][A-Za-z0-9&-]+)\\)\\s*$') THEN regexp_extract(name, '\\(([A-Z][A-Za-z0-9&-]+)\\)\\s*$', 1) ELSE substr(name, 1, 30) END AS short FROM organizations WHERE name IS NOT NULL")
def short_names(orgs):
    return orgs.where("name IS NOT NULL").select("name_norm", T.short_org(F.col("name")).alias("short"))


@query("sections", sql=f"SELECT section_id, regexp_replace(lower({_BARE}), '[^a-z0-9]+', '', 'g') AS key FROM {SECS} WHERE title IS NOT NULL")
def title_keys(secs):
    return latest(secs, "section_id", ["title"], "loaded_at").where("title IS NOT NULL").select("section_id", T.title_key(F.col("title")).alias("key"))


@query("sections", sql=f"SELECT section_id, CASE WHEN regexp_matches(p, '^[0-9]+$') THEN p::INT WHEN p = 'I' THEN 1 WHEN p = 'II' THEN 2 WHEN p = 'III' THEN 3 WHEN p = 'IV' THEN 4 WHEN p = 'V' THEN 5 WHEN p = 'VI' THEN 6 WHEN p = 'VII' THEN 7 WHEN p = 'VIII' THEN 8 WHEN p = 'IX' THEN 9 WHEN p = 'X' THEN 10 END AS phase FROM (SELECT section_id, upper(regexp_extract(title || ' Phase ' || (phase % 11)::VARCHAR, '(?i)\\bphase\\s+([ivx]+|[0-9]+)\\b', 1)) AS p FROM {SECS} WHERE title IS NOT NULL AND phase IS NOT NULL)")
def phase_numbers(secs):
    rows = latest(secs, "section_id", ["title", "phase"], "loaded_at").where("title IS NOT NULL AND phase IS NOT NULL")
    return rows.select("section_id", T.phase_number(F.concat("title", F.lit(" Phase "), (F.col("phase") % 11).cast("string"))).alias("phase"))


@query("documents", sql="SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '… [' || (length(text) - 200) || ' more chars]' ELSE text END AS clipped FROM documents WHERE text IS NOT NULL")
def clipped_texts(docs):
    return docs.where("text IS NOT NULL").select("doc_id", T.clip(F.col("text"), 200).alias("clipped"))


@query("documents", sql="SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) WHERE contains(l, '....') OR contains(l, '. . .') GROUP BY doc_id")
def leader_lines(docs):
    lines = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.where(T.is_toc_line(F.col("l"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("chunks", sql=f"SELECT chunk_id, len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '{T.EMAIL}') AND NOT regexp_matches(l, '{T.PHONE}') AND NOT regexp_matches(l, '{T.CONTACT_LABEL}'))) AS kept FROM {CHUNKS} WHERE text IS NOT NULL")
def contact_rows(chunks):
    """Lines of chunks, as rows of one cell, without contact rows."""
    rows = latest_wide(chunks, "chunk_id", ["text"], "loaded_at").where("text IS NOT NULL")
    return rows.select("chunk_id", F.size(T.redact_rows(F.transform(F.split("text", "\n"), lambda x: F.array(x)))).alias("kept"))


@query("hits", sql=f"""
    WITH h AS (SELECT question_id, hit_id, rank, coalesce(matched_by[1], 'none') AS tool FROM {HITS} WHERE question_id IS NOT NULL) SELECT question_id::VARCHAR AS file, tool, count(*) AS n, count(*) FILTER (rank % 3 = 0) AS errors FROM h GROUP BY ALL""")
def trace_calls(hits):
    """Calls of transcripts that are written from hits: one call and one result a hit, every third rank with an error."""
    h = latest(hits, "hit_id", ["question_id", "rank", "matched_by"], "loaded_at").where("question_id IS NOT NULL")
    tool, key = F.coalesce(F.get("matched_by", 0), F.lit("none")), F.col("hit_id").cast("string")
    event = lambda kind, content: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(F.array(content).alias("content")).alias("message")))
    use = event("assistant", F.struct(F.lit("tool_use").alias("type"), key.alias("id"), F.concat(F.lit("mcp__graph__"), tool).alias("name")))
    res = event("user", F.struct(F.lit("tool_result").alias("type"), key.alias("tool_use_id"), F.when(F.col("rank") % 3 == 0, '{"error": "x"}').otherwise("[]").alias("content")))
    lines = h.select(F.col("question_id").cast("string").alias("file"), F.posexplode(F.array(use, res)).alias("k", "value"), (F.col("hit_id") * 2).alias("line"))
    calls = evaluate.tool_calls(evaluate.parse_events(lines))
    return calls.groupBy("file", "tool").agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("errors"))


@query("chunks", sql=f"WITH c AS (SELECT chunk_id AS id, text FROM {CHUNKS}) SELECT * FROM ({_bm25_sql('c')})")
def stored_postings(chunks):
    """BM25 from postings that were stored once: the texts are not read by the question."""
    where = f"{shared_dir(chunks.sparkSession)}/postings-{uuid.uuid4().hex}"
    index.write_postings(latest_wide(chunks, "chunk_id", ["text"], "loaded_at"), "chunk_id", "text", where)
    return index.bm25_stored(chunks.sparkSession, where, TERMS)


@query("org_aliases", sql="SELECT variant AS acronym, canonical AS expansion FROM org_aliases WHERE regexp_matches(variant, '^[A-Z0-9][A-Za-z0-9&\\-]{1,15}$') AND length(regexp_replace(variant, '[^A-Z]', '', 'g')) >= 2")
def alias_acronyms(aliases):
    return retrieve.alias_acronyms(aliases).select("acronym", "expansion")


@query("chunks", sql=f"SELECT width_bucket, count(*) AS n FROM (SELECT CASE WHEN tokens <= 0 THEN 0 ELSE least(10, ((tokens - 1) // 50 + 1)) END AS width_bucket FROM {CHUNKS} WHERE tokens IS NOT NULL) GROUP BY 1")
def token_histogram(chunks):
    """Chunks by size in steps of 50 tokens; 0 is empty, 10 is more than 450."""
    rows = latest(chunks, "chunk_id", ["tokens"], "loaded_at").where("tokens IS NOT NULL")
    return evaluate.size_histogram(rows, "tokens", 50, 10)


@query("operations", "hits", sql=f"SELECT overall_risk, count(*) AS n, row_number() OVER (ORDER BY overall_risk DESC NULLS FIRST) AS place FROM {OPS} GROUP BY overall_risk")
def ratings_nulls_first(ops, hits):
    """Ratings in descending order with null first, as the graph language sorts."""
    counted = graph.operations(ops).groupBy("overall_risk").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_first("overall_risk"))).cast("long"))


@query("sections", "operations", sql=f"SELECT project_id FROM {OPS} o SEMI JOIN (SELECT DISTINCT project_id FROM {SECS}) s USING (project_id)")
def corpus_operations(secs, ops):
    """Operations that a document describes."""
    return graph.operations(ops).join(latest(secs, "section_id", ["project_id"], "loaded_at").select("project_id"), "project_id", "left_semi").select("project_id")


@query("chunks", sql=f"SELECT kind, min(tokens) AS p0, max(tokens) AS p100, count(*) FILTER (coalesce(text, '') = '') AS empty FROM {CHUNKS} GROUP BY kind")
def token_ends(chunks):
    rows = latest_wide(chunks, "chunk_id", ["kind", "tokens", "text"], "loaded_at")
    return rows.groupBy("kind").agg(F.min("tokens").alias("p0"), F.max("tokens").alias("p100"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"))


@query("operations", sql=f"""
    WITH a AS (SELECT project_id, name, country, status FROM operations WHERE loaded_at < {_EARLY} AND project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY loaded_at DESC) = 1), b AS (SELECT project_id, name, country, status FROM {OPS})
    SELECT CASE WHEN a.project_id IS NULL THEN 'created' WHEN b.project_id IS NULL THEN 'gone' WHEN a.name IS NOT DISTINCT FROM b.name AND a.country IS NOT DISTINCT FROM b.country AND a.status IS NOT DISTINCT FROM b.status THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN b ON a.project_id = b.project_id GROUP BY 1""")
def node_changes(ops):
    """What the later deliveries changed: counters of a load."""
    cut, cols = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), ["name", "country", "status"]
    return graph.changes(latest(ops.where(F.col("loaded_at") < cut), "project_id", cols, "loaded_at"), latest(ops, "project_id", cols, "loaded_at"), "project_id")


@query("operations", sql=f"SELECT project_id, CASE upper(substr(es_risk_rating, 1, 1)) WHEN 'L' THEN 'Low' WHEN 'M' THEN 'Moderate' WHEN 'S' THEN 'Substantial' WHEN 'H' THEN 'High' END AS rating FROM {OPS}")
def rating_codes(ops):
    return graph.operations(ops).select("project_id", facts.rating_of(F.substring("es_risk_rating", 1, 1)).alias("rating"))


# ---- layout, from rows that are made of the tables -----------------------------------------------------------
_ROWS = "doc_id", "page", "row_no", "x0", "y0", "x1", "y1", "text", "size", "bold"


def _layout_rows(df: DataFrame, doc: str, page, row, text, size=None, bold=None) -> DataFrame:
    """Layout rows with the given columns; row numbers give heights."""
    y = row.cast("double") * 20
    return df.select(F.col(doc).alias("doc_id"), page.cast("int").alias("page"), row.cast("int").alias("row_no"), F.lit(0.0).alias("x0"), (y - 10).alias("y0"), F.lit(100.0).alias("x1"), y.alias("y1"), text.alias("text"), (size if size is not None else F.lit(10.0)).alias("size"), (bold if bold is not None else F.lit(False)).alias("bold"))


def _outline(secs: DataFrame) -> DataFrame:
    """A heading row for every section, whose annex number has as many parts as the section's level, and a body row after each."""
    s = latest(secs, "section_id", ["document_hash", "order", "level"], "loaded_at").where("level > 0 AND `order` > 0")
    head = F.concat(F.lit("ANNEX "), F.repeat(F.lit("1."), F.col("level") - 1), F.lit("1: T"), F.col("order").cast("string"))
    both = s.select("document_hash", F.col("order"), F.explode(F.array(F.struct((F.col("order") * 2).alias("r"), head.alias("t"), F.lit(True).alias("b")), F.struct((F.col("order") * 2 + 1).alias("r"), F.lit("body").alias("t"), F.lit(False).alias("b")))).alias("x"))
    return _layout_rows(both, "document_hash", F.lit(1), F.col("x.r"), F.col("x.t"), bold=F.col("x.b"))


_OUTLINE = f"(SELECT document_hash AS d, \"order\" AS o, level, row_number() OVER (PARTITION BY document_hash ORDER BY \"order\") AS n FROM {SECS} WHERE level > 0 AND \"order\" > 0)"


@query("sections", sql=f"""
    WITH s AS {_OUTLINE} SELECT a.d AS doc_id, a.n::INT AS "order", a.level, 'ANNEX ' || repeat('1.', a.level - 1) || '1: T' || a.o AS title, max(b.n)::INT AS parent, 'body' AS text FROM s a LEFT JOIN s b ON a.d = b.d AND b.n < a.n AND b.level < a.level GROUP BY ALL""")
def outlined_sections(secs):
    """Headings, sections and parents of layout rows."""
    out = layout.parents(layout.assemble(layout.detect_headings(_outline(secs)))).where("level > 0")
    return out.select("doc_id", F.col("order").cast("int").alias("order"), "level", "title", F.col("parent").cast("int").alias("parent"), "text")


@query("documents", sql="""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, 8 + length(t) % 5 AS s, sum(length(t)) AS n FROM l GROUP BY ALL)
    SELECT doc_id::VARCHAR AS doc_id, arg_max(s, (n, -s))::DOUBLE AS body FROM s GROUP BY doc_id""")
def body_sizes(docs):
    """The size that most characters of a document have."""
    lines = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("at", "t"))
    return layout.body_size(_layout_rows(lines, "doc_id", F.lit(1), F.col("at"), F.col("t"), size=(8 + F.length("t") % 5).cast("double")))


@query("hits", sql=f"""
    WITH h AS (SELECT question_id::VARCHAR AS doc_id, rank AS page, coalesce(project_id, '') AS p FROM {HITS} WHERE question_id IS NOT NULL), g AS (SELECT doc_id, count(DISTINCT page) AS pages FROM h GROUP BY 1),
    n AS (SELECT doc_id, substr(p, 1, 7) AS id, count(DISTINCT page) AS n FROM h WHERE regexp_matches(p, '^P[0-9]{{6}}') GROUP BY ALL), b AS (SELECT doc_id, arg_max(id, (n, id)) AS id, max(n) AS n FROM n GROUP BY 1)
    SELECT g.doc_id, CASE WHEN b.n >= 0.3 * g.pages THEN b.id END AS project_id FROM g LEFT JOIN b USING (doc_id)""")
def header_ids(hits):
    """The bracketed id on most pages of a document, if on a third of them."""
    h = latest(hits, "hit_id", ["question_id", "rank", "project_id"], "loaded_at").where("question_id IS NOT NULL").withColumn("d", F.col("question_id").cast("string"))
    return layout.project_ids(_layout_rows(h, "d", F.col("rank"), F.lit(0), F.concat(F.lit("x ("), F.substring(F.coalesce("project_id", F.lit("")), 1, 7), F.lit(")"))))


@query("chunks", "sections", sql=f"""
    WITH t AS (SELECT chunk_id, split_part(chunk_id, ':', 1) AS d, page, "order" * 10.0 AS top, "order" * 10.0 + 25 AS bottom FROM {CHUNKS} WHERE page IS NOT NULL AND kind = 'table'),
    s AS (SELECT document_hash AS d, "order" AS o, level, page, (page * 7 % 50) * 1.0 AS top FROM {SECS} WHERE page IS NOT NULL),
    j AS (SELECT t.chunk_id, s.o, s.level, (s.page = t.page AND s.top BETWEEN t.top AND t.bottom AND s.level > 0) AS inside, (s.page < t.page OR (s.page = t.page AND s.top <= t.top) OR s.level = 0) AS above FROM t JOIN s USING (d))
    SELECT chunk_id, coalesce(min(o) FILTER (inside), max(o) FILTER (above)) AS "order" FROM j WHERE inside OR above GROUP BY chunk_id""")
def table_owners(chunks, secs):
    """The section that a table belongs to: one whose heading it holds, else the last at or above it."""
    c = latest(chunks, "chunk_id", ["kind", "page", "order"], "loaded_at").where("page IS NOT NULL AND kind = 'table'")
    t = c.select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("doc_id"), F.col("chunk_id").alias("table_no"), "page", (F.col("order") * 10.0).cast("double").alias("top"), (F.col("order") * 10.0 + 25).cast("double").alias("bottom"))
    s = latest(secs, "section_id", ["document_hash", "order", "level", "page"], "loaded_at").where("page IS NOT NULL")
    s = s.select(F.col("document_hash").alias("doc_id"), "order", "level", "page", ((F.col("page") * 7) % 50).cast("double").alias("top"))
    return layout.table_owner(t, s).select(F.col("table_no").alias("chunk_id"), "order")


@query("sections", sql=f"SELECT section_id AS doc_id, n::INT AS row_no, text, size, bold FROM (SELECT section_id, 0 AS n, {_TIDY.format('title')} AS text, 16.0::DOUBLE AS size, true AS bold FROM {SECS} UNION ALL SELECT section_id, 1, {_TIDY.format('title')}, 10.0, false FROM {SECS}) WHERE text IS NOT NULL AND NOT contains(text, '<')")
def html_pages(secs):
    """Layout rows of pages: a heading and a paragraph with the title."""
    rows = latest(secs, "section_id", ["title"], "loaded_at").where("title IS NOT NULL AND NOT contains(title, '<')")
    pages = rows.select("section_id", F.concat(F.lit("<html><h1 class='x'>"), "title", F.lit("</h1><p><b>"), "title", F.lit("</b></p>")).alias("html"))
    return html_rows(pages, "section_id", "html").select("doc_id", "row_no", "text", "size", "bold")


@query("sections", sql=f"""
    SELECT section_id, string_agg(l, chr(10) ORDER BY a, e) AS text FROM (SELECT section_id, a, e, a || ': ' || e AS l, sum(1 + len(string_split(e, ' '))) OVER (PARTITION BY section_id) AS words FROM (
      SELECT section_id, a, arg_min(e, pos) AS e FROM (SELECT section_id, pos, regexp_extract(l, '^([A-Z0-9]+) ', 1) AS a, trim(regexp_extract(l, '^[A-Z0-9]+ (.+)$', 1)) AS e
        FROM (SELECT section_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {SECS} WHERE type = 'front_matter' AND text IS NOT NULL) WHERE regexp_matches(l, '^[A-Z][A-Z0-9]+ [A-Z][a-z]')) GROUP BY ALL))
    WHERE words <= 400 GROUP BY section_id""")
def glossary_texts(secs):
    """Glossary chunks: sorted lines of each section's abbreviations; lists of more than one chunk are left out of the comparison."""
    rows = latest(secs, "section_id", ["type", "text"], "loaded_at").where("type = 'front_matter' AND text IS NOT NULL")
    pairs = glossary.merge(glossary.from_text(rows, "section_id", needs_start=False)).withColumnRenamed("id", "section_id")
    out = chunking.glossary_chunks(pairs)
    several = out.where("n > 0").select("section_id").distinct()
    return out.join(several, "section_id", "left_anti").select("section_id", "text")


_CELL = "coalesce(chr(10) || '| {} | ' || replace({}, '|', chr(92) || '|') || ' |', '')"


@query("operations", sql=f"""
    SELECT project_id AS id, '| Field | Value |' || chr(10) || '| --- | --- |' || {_CELL.format('name', _TIDY.format('name'))} || {_CELL.format('country', _TIDY.format('country'))} || {_CELL.format('id', 'project_id')} AS text FROM {OPS}""")
def table_texts(ops):
    """Tables as markdown: an empty column goes, the header leads."""
    o = graph.operations(ops)
    line = lambda k, c: F.when(F.col(c).isNotNull() & (F.trim(c) != ""), F.array(F.lit(k), F.lit(""), F.col(c)))
    rows = F.filter(F.array(F.array(F.lit("Field"), F.lit(None), F.lit("Value")), line("name", "name"), line("country", "country"), line("id", "project_id")), lambda r: r.isNotNull())
    return chunking.table_chunks(o.select("project_id", rows.alias("rows")), "project_id").select("id", "text")


@query("chunks", sql=f"""
    WITH w AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM {CHUNKS} WHERE text IS NOT NULL),
    c AS (SELECT chunk_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM w GROUP BY ALL)
    SELECT chunk_id, count(*)::INT AS dims, arg_max(slot, (n, -slot))::INT AS top, round(max(n) / sqrt(sum(n * n)), 4) AS largest FROM c GROUP BY chunk_id""")
def hashed_vectors(chunks):
    """Vectors of the default embedder: filled dimensions, the largest and its share of unit length."""
    rows = latest_wide(chunks, "chunk_id", ["text"], "loaded_at").where("text IS NOT NULL").select("chunk_id", index.hash_embedding(F.col("text")).alias("v"))
    most = F.array_max("v")
    return rows.where(most > 0).select("chunk_id", F.size(F.filter("v", lambda x: x > 0)).alias("dims"), (F.array_position("v", most) - 1).cast("int").alias("top"), F.round(most.cast("double"), 4).alias("largest"))


@query("finances", sql=f"""
    WITH f AS (SELECT name_norm, project_id, coalesce(detail, category) AS detail, amount_usd, loaded_at FROM finances WHERE project_id IS NOT NULL AND coalesce(detail, category) IS NOT NULL),
    a AS (SELECT name_norm, project_id, detail, arg_max(amount_usd, loaded_at) FILTER (amount_usd IS NOT NULL) AS v FROM (SELECT * FROM f WHERE loaded_at < {_EARLY} QUALIFY row_number() OVER (PARTITION BY name_norm, project_id, detail ORDER BY loaded_at DESC, amount_usd DESC NULLS LAST) = 1) GROUP BY ALL),
    b AS (SELECT name_norm, project_id, detail, arg_max(amount_usd, loaded_at) FILTER (amount_usd IS NOT NULL) AS v FROM (SELECT * FROM f WHERE loaded_at >= {_EARLY} QUALIFY row_number() OVER (PARTITION BY name_norm, project_id, detail ORDER BY loaded_at DESC, amount_usd DESC NULLS LAST) = 1) GROUP BY ALL)
    SELECT name_norm, project_id, detail, coalesce(b.v, a.v) AS amount_usd FROM a FULL JOIN b USING (name_norm, project_id, detail)""")
def edge_upsert(fin):
    """Later edges are merged into earlier ones; null never erases."""
    f = fin.select("name_norm", "project_id", F.coalesce("detail", "category").alias("detail"), "amount_usd", "loaded_at").where("project_id IS NOT NULL AND detail IS NOT NULL")
    cut, keys = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), ["name_norm", "project_id", "detail"]
    before, after = (graph.stage_edges(f.where(c), keys, "loaded_at") for c in (F.col("loaded_at") < cut, F.col("loaded_at") >= cut))
    return graph.upsert_edges(before, after, keys)


@query("sections", sql=f"""
    WITH p AS (SELECT DISTINCT project_id AS program_id, phase FROM {SECS} WHERE phase IS NOT NULL AND project_id IS NOT NULL), m AS (SELECT program_id, max(phase) AS last FROM p GROUP BY 1)
    SELECT program_id, (SELECT count(*) FROM range(1, last + 1) r(i) WHERE i NOT IN (SELECT phase FROM p WHERE p.program_id = m.program_id))::INT AS gaps FROM m""")
def phase_gaps(secs):
    """Phase numbers that a programme lacks."""
    p = latest(secs, "section_id", ["project_id", "phase"], "loaded_at").where("phase IS NOT NULL AND project_id IS NOT NULL").select(F.col("project_id").alias("program_id"), "phase").distinct()
    none = {c: F.lit(None).cast("double") for c in ("ibrd", "ida", "other")}
    return facts.reconcile_phases(p.withColumns(none)).select("program_id", F.size("missing").alias("gaps"))


@query("finances", sql=f"""
    WITH f AS (SELECT project_id AS doc_id, coalesce(category, '-') AS g, amount_usd / 1e6 AS m FROM {_FIN} WHERE project_id IS NOT NULL AND amount_usd IS NOT NULL), s AS (SELECT doc_id, g, sum(m) AS found, round(sum(m), 0) AS expected FROM f GROUP BY ALL)
    SELECT doc_id, 'group ' || g AS "check", expected FROM s WHERE abs(expected - found) > 0.01""")
def group_sums(fin):
    """Financing groups, stated in whole millions, whose parts do not add up to them."""
    f = graph.finances_edges(fin).where("project_id IS NOT NULL AND amount_usd IS NOT NULL").select(F.col("project_id").alias("doc_id"), F.coalesce("category", F.lit("-")).alias("group"), (F.col("amount_usd") / 1e6).alias("amount_millions"))
    groups = f.groupBy("doc_id", "group").agg(F.round(F.sum("amount_millions"), 0).alias("amount_millions"))
    totals = groups.groupBy("doc_id").agg(F.sum("amount_millions").alias("total_millions"))
    return facts.financing_checks(f, groups, totals).select("doc_id", "check", "expected")


@query("chunks", "hits", sql=f"""
    WITH c AS (SELECT chunk_id, coalesce(text, '') AS t FROM {CHUNKS}) SELECT h.hit_id AS question_id, contains(lower(c.t), 'water') OR contains(lower(c.t), 'road') AS facts, NOT regexp_matches(c.t, 'US\\$ ?[0-9]') AS clean, h.matched_by[1] = 'vector' AS route
    FROM {HITS} h JOIN c ON c.chunk_id = h.chunk_id WHERE len(h.matched_by) > 0""")
def answer_scores(chunks, hits):
    """Answers made of chunks: one of two facts, no amounts, the tool that was asked for."""
    c = latest_wide(chunks, "chunk_id", ["text"], "loaded_at")
    h = latest(hits, "hit_id", ["chunk_id", "matched_by"], "loaded_at").where("size(matched_by) > 0")
    lists = lambda *xs: F.array(*[F.array(*[F.lit(v) for v in x]) for x in xs])
    none = F.array().cast("array<string>")
    answers = h.join(c, "chunk_id").select(F.col("hit_id").alias("question_id"), F.col("text").alias("answer"), F.slice("matched_by", 1, 1).alias("tools"), F.lit(0).alias("errors"), lists(["vector"]).alias("expect_route"), lists(["water", "Road"]).alias("expect_facts"), lists([r"re:US\$ ?[0-9]"]).alias("must_not"), none.alias("expect_ids"))
    return evaluate.score_answers(answers).select("question_id", "facts", "clean", "route")


@query("chunks", "sections", "operations", sql=f"""
    WITH s AS (SELECT s.section_id, coalesce(o.country, '?') || ' | ' || coalesce(s.phase_project_id, s.project_id) || ' | ' || s.path AS head FROM {SECS} s LEFT JOIN {OPS} o USING (project_id) WHERE s.text IS NOT NULL AND trim(s.text) <> '' AND s.path IS NOT NULL AND coalesce(s.phase_project_id, s.project_id) IS NOT NULL AND len(regexp_extract_all(s.text, '\\S+')) <= 400)
    SELECT section_id || ':c0' AS chunk_id, head FROM s""")
def chunk_heads(chunks, secs, ops):
    """Head lines of the chunks of sections that fit one chunk."""
    s = latest_wide(secs, "section_id", ["project_id", "phase_project_id", "path", "page", "text"], "loaded_at").where("text IS NOT NULL AND path IS NOT NULL AND coalesce(phase_project_id, project_id) IS NOT NULL")
    s = s.where(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) <= 400).join(graph.operations(ops).select("project_id", "country"), "project_id", "left")
    none = s.sparkSession.createDataFrame([], "section_id string, acronym string, expansion string")
    return chunking.build_chunks(s, none).select("chunk_id", F.element_at(F.split("embed_text", "\n"), 1).alias("head"))
