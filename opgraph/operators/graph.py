"""The property graph as typed node and edge DataFrames: build, staged and persisted upserts, traversal, introspection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opgraph.functions.text import name_norm
from opgraph.plans.keys import latest
from opgraph.plans.materialize import materialize

# ---- fixed values: labels and their key properties ----------------------------------------------------
NODE_KEYS = {
    "Operation": "project_id", "Program": "program_id", "Phase": "phase_id", "Document": "hash", "Organization": "name_norm",
    "Location": "name_norm", "Risk": "name", "Acronym": "name", "Section": "section_id", "Table": "table_id", "Chunk": "chunk_id",
}
# -----------------------------------------------------------------------------------------------------
#: Queries that show the pattern language to a client.
EXAMPLES = [
    "MATCH (o:Operation)-[:LOCATED_IN]->(l:Location) RETURN l.name AS country, count(*) AS n ORDER BY n DESC",
    "MATCH (g:Organization)-[f:FINANCES]->(o:Operation) WHERE o.project_id = $project RETURN g.name AS source, f.detail AS detail, f.amount_usd AS usd",
    "MATCH (d:Document)-[:HAS_SECTION|HAS_SUBSECTION*]->(s:Section) WHERE s.type = 'risks' RETURN d.hash AS document, collect(s.title) AS titles",
    "MATCH (d:Document)-[x:DEFINES]->(a:Acronym) WHERE a.name = $acronym RETURN x.expansion AS expansion, count(*) AS documents",
]


# ---- staging and upserts ------------------------------------------------------------------------------
def stage_nodes(rows: DataFrame, key: str, seq: str, stub: str = "stub") -> DataFrame:
    """One row per key. Full rows merge (a later non-null value wins); a stub counts only where no full row is."""
    props = [c for c in rows.columns if c not in (key, seq, stub)]
    full = ~F.coalesce(F.col(stub), F.lit(False))
    order = F.struct(full.alias("f"), F.col(seq).alias("s"))
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(full).alias("_any"),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(full.alias("f"), F.col(seq).alias("s"), F.col(c).alias("v")))).alias(c) for c in props], F.max(order).alias("_last"))
    value = lambda c: F.when(~F.col("_any") | F.col(c)["f"], F.col(c)["v"]).alias(c)
    return merged.select(key, *[value(c) for c in props], (~F.col("_any")).alias(stub))


def stage_edges(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per (ends, merge keys): the last staged one."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct(F.col(seq), *[F.col(c) for c in rest if c != seq])).alias("_r")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col("_r")[c].alias(c) for c in rest if c != seq])


def upsert_nodes(current: DataFrame, staged: DataFrame, key: str, stub: str = "stub") -> DataFrame:
    """Persisted merge: full rows set their non-null values, stubs only create; null never erases."""
    props = [c for c in current.columns if c not in (key, stub)]
    new = staged.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in props], F.col(stub).alias("n_stub"))
    old = current.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in props], F.col(stub).alias("o_stub"), F.lit(True).alias("_old"))
    joined = old.join(new, key, "full")
    kept = F.col("_old") & F.coalesce(F.col("n_stub"), F.lit(True))
    out = [F.when(kept, F.col(f"o_{c}")).otherwise(F.coalesce(f"n_{c}", f"o_{c}")).alias(c) for c in props]
    return joined.select(key, *out, F.when(F.col("_old"), F.col("o_stub") & F.coalesce(F.col("n_stub"), F.lit(True))).otherwise(F.col("n_stub")).alias(stub))


def changes(before: DataFrame | None, after: DataFrame, key: str) -> DataFrame:
    """``(change, n)``: rows of ``after`` that ``before`` lacks (created), has with other values (changed) or has alike (same), and rows gone."""
    shared = [c for c in after.columns if before is None or c in before.columns]
    print_ = lambda df: df.select(F.col(key).alias("_k"), F.xxhash64(*[F.col(c).cast("string") for c in shared]).alias("_h"))
    new = print_(after).withColumnRenamed("_h", "_n")
    if before is None:
        return new.select(F.lit("created").alias("change")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    both = print_(before).join(new, "_k", "full")
    which = F.when(F.col("_h").isNull(), "created").when(F.col("_n").isNull(), "gone").when(F.col("_h") == F.col("_n"), "same").otherwise("changed")
    return both.select(which.alias("change")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def upsert_edges(current: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    props = [c for c in current.columns if c not in keys]
    new = staged.select(*keys, *[F.col(c).alias(f"n_{c}") for c in props])
    old = current.select(*keys, *[F.col(c).alias(f"o_{c}") for c in props])
    return old.join(new, keys, "full").select(*keys, *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in props])


def coerce(df: DataFrame, dates: tuple[str, ...] = ()) -> DataFrame:
    """Properties as a graph store takes them: ISO text of ``dates`` becomes dates (other text stays away as null), maps, records and lists of records become JSON."""
    from pyspark.sql import types as T

    nested = lambda t: isinstance(t, (T.MapType, T.StructType)) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.MapType, T.StructType, T.ArrayType)))
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((F.try_to_date(c, "yyyy-MM-dd") if f.name in dates and isinstance(f.dataType, T.StringType) else F.to_json(c) if nested(f.dataType) else c).alias(f.name))
    return df.select(*out)


def resolve_ends(edges: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges whose two ends exist."""
    a, b = left.select(F.col(left_key).alias(source)).distinct(), right.select(F.col(right_key).alias(target)).distinct()
    return edges.join(a, source, "left_semi").join(b, target, "left_semi")


def dangling(edges: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str, source: str = "src", target: str = "dst") -> DataFrame:
    """``(missing, n)``: how many edges :func:`resolve_ends` leaves out, by the end that does not exist (source first)."""
    a, b = left.select(F.col(left_key).alias(source), F.lit(True).alias("_a")).distinct(), right.select(F.col(right_key).alias(target), F.lit(True).alias("_b")).distinct()
    both = edges.join(a, source, "left").join(b, target, "left")
    which = F.when(F.col("_a").isNull(), "source").when(F.col("_b").isNull(), "target")
    return both.select(which.alias("missing")).where("missing IS NOT NULL").groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


def stale_parts(parts: DataFrame, gone: DataFrame) -> DataFrame:
    """Tables or chunks whose section is stale: they go with it."""
    return parts.join(gone.select("section_id").distinct(), "section_id", "left_semi")


def stale(sections: DataFrame, keep: DataFrame) -> DataFrame:
    """Sections of documents in ``keep`` that ``keep`` no longer holds; other documents are untouched."""
    loaded = keep.select("document_hash").distinct()
    return sections.join(loaded, "document_hash", "left_semi").join(keep.select("document_hash", "section_id"), ["document_hash", "section_id"], "left_anti")


def missing_parents(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Section ids of chunks that no section has (a load aborts on any)."""
    return chunks.where(F.col("section_id").isNotNull()).select("section_id").distinct().join(sections.select("section_id"), "section_id", "left_anti")


def duplicate_keys(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


# ---- build from the tables ----------------------------------------------------------------------------
def operations(df: DataFrame) -> DataFrame:
    return latest(df, "project_id", [c for c in df.columns if c not in ("project_id", "loaded_at")], "loaded_at")


def sections(df: DataFrame, *columns: str) -> DataFrame:
    """Latest sections with the columns asked for (default: all); texts that no one asks for are neither read nor moved."""
    return latest(df, "section_id", list(columns) or [c for c in df.columns if c not in ("section_id", "loaded_at")], "loaded_at")


def locations(ops: DataFrame, fold=name_norm) -> DataFrame:
    return ops.where(F.col("country").isNotNull()).groupBy(fold(F.col("country")).alias("name_norm")).agg(F.max("country").alias("name"), F.max("country_iso2").alias("iso2"), F.max("region").alias("region"))


def finances_edges(df: DataFrame) -> DataFrame:
    """FINANCES: one edge per (organization, operation, detail), the latest delivered."""
    rows = df.select("name_norm", "project_id", F.coalesce("detail", "category").alias("detail"), "category", "amount_usd", "orig_currency", "orig_amount", "loaded_at")
    return stage_edges(rows, ["name_norm", "project_id", "detail"], "loaded_at")


def has_section_edges(secs: DataFrame) -> DataFrame:
    """HAS_SECTION from the document, or HAS_SUBSECTION from the parent section: ``(src, dst, type)``."""
    parent = secs.select(F.col("section_id").alias("parent_id"), "document_hash", F.col("order").alias("parent"))
    joined = secs.select("section_id", "document_hash", "parent").join(parent, ["document_hash", "parent"], "left")
    return joined.select(F.coalesce("parent_id", "document_hash").alias("src"), F.col("section_id").alias("dst"), F.when(F.col("parent_id").isNull(), "HAS_SECTION").otherwise("HAS_SUBSECTION").alias("type"))


def next_chunk(chunks: DataFrame) -> DataFrame:
    """NEXT_CHUNK: ``(src, dst)`` in the reading order of each section."""
    order = Window.partitionBy("section_id").orderBy("order", "chunk_id")
    return chunks.select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(order).alias("dst")).where(F.col("dst").isNotNull())


def section_ids(rows: DataFrame, slug: Column) -> DataFrame:
    """Occurrence number of each slug path within its document, in document order from 0."""
    order = Window.partitionBy("document_hash", "slug_path").orderBy("order", "section_id")
    return rows.withColumn("slug_path", slug).withColumn("occurrence", F.row_number().over(order) - 1)


# ---- traversal ------------------------------------------------------------------------------------------
def descendants(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", depth: int | None = None) -> DataFrame:
    """``(root, node, hops)`` of everything reachable from ``roots`` in at most ``depth`` steps (default: any number), breadth first.

    Each step joins only the last frontier; nodes already reached are dropped, so cycles end, and the loop stops with the
    first empty frontier.
    """
    frontier = roots.select(F.col(roots.columns[0]).alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("hops"))
    reached, hop = frontier, 0
    steps = materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct(), "graph-steps")
    while depth is None or hop < depth:
        hop += 1
        ahead = frontier.join(steps, "node").select("root", F.col("next").alias("node"), F.lit(hop).alias("hops")).distinct()
        frontier = materialize(ahead.join(reached.select("root", "node"), ["root", "node"], "left_anti"), "graph-frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


# ---- patterns -------------------------------------------------------------------------------------------
def rated(ops: DataFrame, rating: str) -> DataFrame:
    """Operations of a rating, listed by country."""
    rows = ops.where(F.col("overall_risk") == rating)
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("project_id")), ",").alias("projects"))


def multi_financiers(edges: DataFrame, orgs: DataFrame, at_least: int = 2) -> DataFrame:
    """Organizations (no categories) that finance more than one operation."""
    real = orgs.where(~F.coalesce(F.col("is_category"), F.lit(False))).select("name_norm")
    counted = edges.where(F.col("project_id").isNotNull()).groupBy("name_norm").agg(F.count_distinct("project_id").alias("n_ops"))
    return counted.where(F.col("n_ops") >= at_least).join(real, "name_norm", "left_semi")


def schema_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(label, n, properties)`` of every node table: counts from the data, properties from the catalog."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n", F.lit(",".join(sorted(df.columns))).alias("properties")) for label, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vocabulary(ops: DataFrame, secs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(vocab, value)``: the distinct values that filters accept."""
    parts = [(ops, c) for c in ("country", "region", "status", "instrument", "overall_risk")] + [(secs, "type"), (secs, "subtype"), (secs, "scope"), (chunks, "kind")]
    out = None
    for df, c in parts:
        part = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("vocab"), F.col(c).alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


#: Values of vocabularies that a schema payload holds at most; more raise, as they are no vocabulary.
MOST_VALUES = 5000


def edge_patterns(edges: dict[tuple[str, str, str], DataFrame]) -> DataFrame:
    """``(source, type, target, n, properties)`` of every edge table, keyed by (source label, type, target label)."""
    out = None
    for (a, kind, b), df in edges.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("source"), F.lit(kind).alias("type"), F.lit(b).alias("target"), "n", F.lit(",".join(sorted(c for c in df.columns if c not in ("src", "dst")))).alias("properties"))
        out = part if out is None else out.unionByName(part)
    return out


def graph_schema(tables: dict[str, DataFrame], ops: DataFrame, secs: DataFrame, chunks: DataFrame, edges: dict[tuple[str, str, str], DataFrame] | None = None) -> dict:
    """The introspection payload: labels, counts, properties, patterns, vocabularies, indexes and examples (all bounded by the schema)."""
    labels = {r.label: {"count": r.n, "properties": r.properties.split(",")} for r in schema_counts(tables).collect()}
    rows = vocabulary(ops, secs, chunks).orderBy("vocab", "value").limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values of vocabularies")
    vocab: dict[str, list[str]] = {}
    for r in rows:
        vocab.setdefault(r.vocab, []).append(r.value)
    patterns = [{"pattern": f"(:{r.source})-[:{r.type}]->(:{r.target})", "count": r.n, "properties": [p for p in r.properties.split(",") if p]} for r in edge_patterns(edges).orderBy("source", "type", "target").collect()] if edges else []
    indexes = [{"kind": "vector", "label": "Chunk", "property": "embedding", "similarity": "cosine"}, {"kind": "fulltext", "label": "Chunk", "property": "text"}]
    return {"labels": labels, "patterns": patterns, "vocabularies": vocab, "indexes": indexes, "examples": EXAMPLES}


# ---- derived nodes --------------------------------------------------------------------------------------
def pdo_sections(docs: DataFrame, secs: DataFrame) -> DataFrame:
    """A synthetic objective section (order -1, level 1) for documents with an objective text and no own section of that subtype.

    ``docs``: document_hash, project_id, pdo_text. Own sections are those of scope main or of the project's own phase.
    """
    own = secs.where((F.col("subtype") == "development_objective") & ((F.col("scope") == "main") | (F.col("phase_project_id") == F.col("project_id"))))
    lacking = docs.where(F.col("pdo_text").isNotNull() & (F.col("pdo_text") != "")).join(own.select("document_hash").distinct(), "document_hash", "left_anti")
    text = F.col("pdo_text")
    return lacking.select(
        F.concat("document_hash", F.lit(":project-development-objective-datasheet#0")).alias("section_id"), "document_hash", "project_id", F.lit(-1).alias("order"), F.lit(1).alias("level"),
        F.lit("Project Development Objective").alias("title"), F.lit("pdo").alias("type"), F.lit("development_objective").alias("subtype"), F.lit("main").alias("scope"), text.alias("text"), F.length(text).alias("chars"), F.lit("datasheet").alias("source"))


def phase_stubs(phases: DataFrame, ops: DataFrame) -> DataFrame:
    """Stub operations for the ids of phases that no operation has; phases without an id stay unlinked, none is dropped."""
    ids = phases.where(F.col("project_id").isNotNull()).select("project_id").distinct()
    return ids.join(ops.select("project_id"), "project_id", "left_anti").withColumn("stub", F.lit(True))


def property_keys(tables: dict[str, DataFrame], sample: int = 300) -> dict[str, list[str]]:
    """Properties that at least one of up to ``sample`` rows of a label has, as schema discovery reports them."""
    out = {}
    for label, df in tables.items():
        seen = df.limit(sample).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
        out[label] = sorted(c for c in df.columns if seen[c])
    return out


def operations_layer(ops: DataFrame, fin: DataFrame, orgs: DataFrame, risks: DataFrame | None = None, phases: DataFrame | None = None, all_risks: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the operations layer: operations, countries, financiers, and, where given, risks, phases and programs.

    ``risks``: project_id, category, rating (only High unless ``all_risks``). ``phases``: program_id, phase, project_id.
    """
    node = lambda prefix, key, label, name: [F.concat(F.lit(prefix), key).alias("id"), F.lit(label).alias("label"), name.alias("name")]
    edge = lambda src, kind, dst: [src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst")]
    at = lambda prefix, key: F.concat(F.lit(prefix), key)
    col = F.col
    land = ops.where("country IS NOT NULL")
    paid = fin.where("project_id IS NOT NULL").select("name_norm", "project_id").distinct()
    pays = paid.join(orgs.select("name_norm"), "name_norm", "left_semi").join(ops.select("project_id"), "project_id", "left_semi")
    nodes = [
        ops.select(*node("o:", col("project_id"), "Operation", col("name"))), land.select("country").distinct().select(*node("l:", col("country"), "Location", col("country"))),
        orgs.join(paid.select("name_norm").distinct(), "name_norm", "left_semi").select(*node("g:", col("name_norm"), "Organization", col("name")))]
    edges = [land.select(*edge(at("o:", col("project_id")), "LOCATED_IN", at("l:", col("country")))), pays.select(*edge(at("g:", col("name_norm")), "FINANCES", at("o:", col("project_id"))))]
    if risks is not None:
        shown = risks.join(ops.select("project_id"), "project_id", "left_semi")
        shown = shown if all_risks else shown.where("rating = 'High'")
        nodes.append(shown.select("category").distinct().select(*node("r:", col("category"), "Risk", col("category"))))
        edges.append(shown.select("project_id", "category").distinct().select(*edge(at("o:", col("project_id")), "HAS_RISK", at("r:", col("category")))))
    if phases is not None:
        key = F.concat(col("program_id"), F.lit(":phase:"), col("phase").cast("string"))
        nodes += [phases.select("program_id").distinct().select(*node("m:", col("program_id"), "Program", col("program_id"))), phases.select(*node("p:", key, "Phase", key)).distinct()]
        edges += [phases.select(*edge(at("m:", col("program_id")), "HAS_PHASE", at("p:", key))).distinct(), phases.join(ops.select("project_id"), "project_id", "left_semi").select(*edge(at("p:", key), "HAS_OPERATION", at("o:", col("project_id")))).distinct()]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
