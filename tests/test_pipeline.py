import json

from opgraph.functions.udfs import register
from opgraph.operators.pipeline import ingest
from opgraph.sources.readers import read_version


def lines(doc, items):
    out, y = [], 0.0
    for page, text, bold in items:
        y += 20
        out.append({"doc_id": doc, "page": page, "x0": 0.0, "y0": y - 10, "x1": 100.0, "y1": y, "text": text, "size": 10.0, "flags": 16 if bold else 0})
    return out


BODY = [(1, "PROJECT PAPER", False), (1, "for Water (P123456)", False), (1, "ABBREVIATIONS AND ACRONYMS", False), (1, "WB Water Board", False), (2, "I. Strategic Context", True), (2, "Call a@b.org now.", False), (2, "A. Country Context", True), (2, "Rivers.", False), (2, "II. Key Risks", True), (2, "Flood.", False)]


def test_ingest_is_idempotent_and_scoped(spark, tmp_path):
    first, root = tmp_path / "a.jsonl", f"file://{tmp_path}/tables"
    first.write_text("\n".join(json.dumps(x) for d in ("d1", "d2") for x in lines(d, BODY)))
    one = ingest(spark, str(first), root)
    assert (one["documents"], one["sections"], one["acronyms"], one["stale_sections"]) == (2, 8, 2, 0)
    secs = {r.section_id: r for r in read_version(spark, f"{root}/sections").collect()}
    context = secs["d1:strategic-context/country-context#0"]
    assert context.path == "I. Strategic Context > A. Country Context" and context.type == "context" and context.project_id == "P123456" and context.doc_type == "project_paper"
    assert "[email redacted]" in secs["d1:strategic-context#0"].text
    again = ingest(spark, str(first), root)
    assert again == one and {r.section_id for r in read_version(spark, f"{root}/sections").collect()} == set(secs)
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x) for x in lines("d1", BODY[:-2])))
    less = ingest(spark, str(tmp_path / "b.jsonl"), root)
    left = {r.section_id for r in read_version(spark, f"{root}/sections").collect()}
    assert less["stale_sections"] == 1 and left == set(secs) - {"d1:key-risks#0"}
    chunks = [r.chunk_id for r in read_version(spark, f"{root}/chunks").collect()]
    assert len(chunks) == len(set(chunks)) and "d2:key-risks#0:c0" in chunks and "d1:key-risks#0:c0" not in chunks
    assert "error" in ingest(spark, "x.pdf", root) and "error" in ingest(spark, str(tmp_path / "nothing.jsonl"), root)


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT name_norm('Türkiye ½') AS n").first().n == "turkiye 1 2"
    assert [(r.n, r.start, r.end) for r in spark.sql("SELECT * FROM text_windows(repeat('w ', 500))").collect()] == [(0, 0, 400), (1, 350, 500)]


FORM = [
    ["Operation ID", "Financing Instrument"], ["P123456", "Investment Project Financing"], [None], ["Operation Name", "Country"], ["Water", "Land"], ["Implementation Modalities"], ["[x] Multiphase Programmatic Approach"], ["Expected Approval Date"], ["1-Feb-2020"],
    ["Proposed Development Objective"], ["To improve water."], ["Organizations"], ["Borrower: Republic of Land"], ["Implementing Agency: Ministry of Water"], ["International Development Association (IDA)", "45.00"], ["Counterpart Funding", "5.00"], ["Borrower/Recipient", "5.00"],
    ["1. Political", "High"], ["Overall", "Low"],
]
PHASES = [["1", "Land; P123456", "Sequential", "x", "IPF", "45.0"], ["2", "Sea; P222222", "Sequential", "x", "IPF", "10.0"], ["3", "Later", "Sequential", "x", "IPF"]]


def test_graph_of_a_delivery(spark, tmp_path):
    body = [(1, "PROJECT PAPER", False), (1, "ABBREVIATIONS AND ACRONYMS", False), (1, "WB Water Board", False), (2, "DATASHEET", True), (2, "see table", False), (3, "I. Multiphase Programmatic Approach", True), (3, "Text (P123456)", False), (4, "ANNEX 1: MPA Phase 2", True), (4, "Sea.", False), (4, "A. More on it", True), (4, "Deep.", False)]
    spans, tabs, root = tmp_path / "s.jsonl", tmp_path / "t.jsonl", f"file://{tmp_path}/tables"
    heads = [{"doc_id": "d1", "page": p, "x0": 0.0, "y0": y, "x1": 100.0, "y1": y + 10, "text": t, "size": 10.0, "flags": 0} for p, y, t in ((1, -40.0, "Program One (P999999)"), (3, -40.0, "Program One (P999999)"), (2, -20.0, "Water (P123456)"), (3, -20.0, "Water (P123456)"))]
    spans.write_text("\n".join(json.dumps(x) for x in [*lines("d1", body), *heads]))
    table = lambda n, page, y, rows: {"doc_id": "d1", "table_no": n, "page": page, "bbox": [0.0, y, 100.0, y + 5], "rows": rows, "h_rules": 3, "v_rules": 3}
    tabs.write_text("\n".join(json.dumps(x) for x in (table(0, 2, 105.0, FORM), table(1, 3, 145.0, PHASES))))
    land = spark.createDataFrame([("land", "Land", "LD", "South")], "name_norm string, canonical string, iso2 string, region string")
    got = ingest(spark, str(spans), root, str(tabs), {"ida": "IDA"}, land)
    assert got["graph"]["nodes"] == {"Operation": 2, "Program": 1, "Phase": 3, "Document": 1, "Organization": 3, "Location": 1, "Risk": 1, "Acronym": 1, "Section": got["sections"] + 1, "Table": 2, "Chunk": got["chunks"]}
    e = got["graph"]["edges"]
    assert (e["FINANCES"], e["IMPLEMENTS"], e["HAS_RISK"], e["HAS_PHASE"], e["HAS_OPERATION"], e["LOCATED_IN"], e["DESCRIBES"], e["DEFINES"], e["HAS_TABLE"]) == (2, 1, 1, 3, 2, 1, 1, 1, 2) and got["graph"]["left_out"] == {}
    ops = {r.project_id: r for r in read_version(spark, f"{root}/graph/Operation").collect()}
    assert ops["P222222"].stub and not ops["P123456"].stub and (ops["P123456"].country, ops["P123456"].total_financing_usd, str(ops["P123456"].approval_date)) == ("Land", None, "2020-02-01")
    secs = {r.title: r for r in read_version(spark, f"{root}/sections").collect()}
    assert [(secs[t].scope, secs[t].phase, secs[t].phase_project_id) for t in ("ANNEX 1: MPA Phase 2", "A. More on it", "DATASHEET")] == [("phase", 2, "P222222"), ("phase", 2, "P222222"), ("main", None, None)]
    chunks = read_version(spark, f"{root}/chunks").collect()
    assert all(len(c.embedding) == 64 for c in chunks) and {c.kind for c in chunks} == {"text", "table", "glossary"} and any(c.embed_text.startswith("Land | P222222 | ") for c in chunks)
    again = ingest(spark, str(spans), root, str(tabs), {"ida": "IDA"}, land)
    assert again["graph"] == got["graph"] and read_version(spark, f"{root}/chunks").count() == len(chunks)
