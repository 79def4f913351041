import json

import pytest
from pyspark.sql import functions as F

from opgraph.operators import evaluate, facts, graph, layout
from opgraph.sources import sinks
from opgraph.sources.readers import write_html


def test_outline(spark):
    rows = spark.createDataFrame([("d", 1, 0, "Cover"), ("d", 1, 1, "I. Context"), ("d", 2, 0, "First")], "doc_id string, page int, row_no int, text string")
    out = spark.createDataFrame([("d", 0, 1, "Context", 1), ("d", 1, 1, "Nowhere", 2), ("d", 2, 1, "Gone", 9)], "doc_id string, entry int, level int, title string, page int")
    assert {r.entry: r.row_no for r in layout.outline_headings(out, rows).collect()} == {0: 1, 1: 0}


def test_derived_nodes(spark):
    docs = spark.createDataFrame([("h1", "P1", "aim"), ("h2", "P2", "aim"), ("h3", "P3", None)], "document_hash string, project_id string, pdo_text string")
    secs = spark.createDataFrame([("h1", "P1", "development_objective", "main", None), ("h2", "P2", "development_objective", "phase", "P9")], "document_hash string, project_id string, subtype string, scope string, phase_project_id string")
    got = graph.pdo_sections(docs, secs).collect()
    assert [(r.document_hash, r.order, r.level, r.chars) for r in got] == [("h2", -1, 1, 3)]
    ph = spark.createDataFrame([("P1",), ("P7",), (None,)], "project_id string")
    assert [r.project_id for r in graph.phase_stubs(ph, docs).collect()] == ["P7"]
    assert graph.property_keys({"D": docs.where("pdo_text IS NULL")}) == {"D": ["document_hash", "project_id"]}


def test_layer_and_html(spark, tmp_path):
    ops = spark.createDataFrame([("P1", "One & two", "Land"), ("P2", "Two", None)], "project_id string, name string, country string")
    fin = spark.createDataFrame([("ida", "P1"), ("ida", "P1"), ("gone", "P1"), ("ida", "P9")], "name_norm string, project_id string")
    orgs = spark.createDataFrame([("ida", "IDA"), ("x", "X")], "name_norm string, name string")
    nodes, edges = graph.operations_layer(ops, fin, orgs)
    assert {(r.src, r.type, r.dst) for r in edges.collect()} == {("o:P1", "LOCATED_IN", "l:Land"), ("g:ida", "FINANCES", "o:P1")}
    assert write_html(nodes, edges, str(tmp_path / "g.html")) == 4 and "One &amp; two" in (tmp_path / "g.html").read_text()


def test_checks(spark):
    parts = spark.createDataFrame([("d", "g", 4.0), ("d", "g", 5.0)], "doc_id string, `group` string, amount_millions double")
    groups = spark.createDataFrame([("d", "g", 9.5), ("d", "h", 1.0)], "doc_id string, `group` string, amount_millions double")
    total = spark.createDataFrame([("d", 10.5)], "doc_id string, total_millions double")
    assert [(r.check, r.expected, r.found) for r in facts.financing_checks(parts, groups, total).collect()] == [("group g", 9.5, 9.0)]
    rows = spark.createDataFrame([("d", 1, "Water (P123456)"), ("d", 2, "Water (P123456)"), ("d", 3, "Other (P999999)")], "doc_id string, page int, text string")
    r = facts.running_header(rows).first()
    assert (r.name, r.project_id) == ("Water", "P123456")


def test_runner_and_filters():
    got = evaluate.run_questions([{"id": "a"}, {"id": "b"}], lambda q: {"x": 1} if q["id"] == "a" else 1 / 0)
    assert got[0]["payload"] == {"x": 1} and got[1]["payload"]["error"].startswith("ZeroDivisionError")
    assert evaluate.oracle_filters({"expect_ids": ["P123456", "P654321", "x"], "expect_section_types": ["risks"]}) == {"k": 8, "project_ids": ["P123456", "P654321"], "per_project_k": 4, "section_types": ["risks"]}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("h", "P1"), ("e", "P2")], "document_hash string, project_id string")
    secs = spark.createDataFrame([("h", 2, "b"), ("h", 1, "a")], "document_hash string, order int, title string")
    rows = {r.document_hash: json.loads(r.json) for r in sinks.documents_json(docs, secs).collect()}
    assert [s["title"] for s in rows["h"]["sections"]] == ["a", "b"] and "sections" not in rows["e"]
    sinks.write_documents(docs, secs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    hit = {"rank": 1, "project_id": "P1", "section_path": "A", "matched_by": ["vector"], "score": 0.1, "text": "x " * 300}
    page = sinks.markdown_hits({"question": "q?", "expansions": {"A": ["b"]}, "hits": [hit] * 6})
    assert page.startswith("## q?") and "… 2 more hits" in page and sinks.markdown_hits({"error": "e"}) == "**error:** e\n"
    assert sinks.markdown_rows({"columns": ["a"], "rows": [{"a": "x|y"}] * 12, "row_count": 12}).endswith("… 2 more rows\n")


def test_config_files_and_manifest(spark, tmp_path):
    import hashlib

    from opgraph.session import Folders
    from opgraph.sources.readers import fetch_files, load_aliases, load_countries

    (tmp_path / "a.json").write_text(json.dumps({"organizations": {"Fund (F)": ["F", "the  fund"], "Bank": ["B"]}}))
    assert load_aliases(tmp_path / "a.json") == {"fund f": "Fund (F)", "f": "Fund (F)", "the fund": "Fund (F)", "bank": "Bank", "b": "Bank"}
    (tmp_path / "b.json").write_text(json.dumps({"organizations": {"X": ["same"], "Y": ["Same"]}}))
    with pytest.raises(ValueError):
        load_aliases(tmp_path / "b.json")
    (tmp_path / "c.json").write_text(json.dumps({"countries": {"Türland": {"iso2": "TL", "region": "R", "aliases": ["Republic of Türland"], "api_codes": ["3T"]}}}))
    assert {r.name_norm for r in load_countries(spark, tmp_path / "c.json").collect()} == {"turland", "republic of turland", "tl", "3t"}
    entry = {"filename": "x.pdf", "url": "u", "sha256": hashlib.sha256(b"good").hexdigest()}
    assert fetch_files([entry], tmp_path, lambda u: b"bad") == {"x.pdf": "missing"} and not list(tmp_path.glob("*.part"))
    assert fetch_files([entry], tmp_path, lambda u: b"good") == {"x.pdf": "fetched"} and fetch_files([entry], tmp_path, lambda u: 1 / 0) == {"x.pdf": "ok"}
    (tmp_path / "x.pdf").write_bytes(b"other")
    assert fetch_files([entry], tmp_path, lambda u: b"", check_only=True) == {"x.pdf": "changed"} and Folders("/r/").tables == "/r/tables"


def test_cover_amounts_and_conflicts_of_records(spark):
    form = [["Operation ID", "Financing Instrument"], ["P123456", "Investment Project Financing"], [None], ["Operation Name", "Country"], ["Water", "Land"], ["Borrower: Land"], ["Implementing Agency: Roads (R)"], ["International Development Association (IDA)", "411.00"], ["Counterpart Funding", "5.00"]]
    parsed = facts.parse_sheets(spark.createDataFrame([("d", form)], "doc_id string, rows array<array<string>>"))
    head = spark.createDataFrame([("d", "P123456")], "doc_id string, header_id string")
    none = spark.createDataFrame([], "name_norm string, canonical string, iso2 string, region string")
    api = spark.createDataFrame([("P123456", "R", "Active", "ok")], "project_id string, region string, status string, api_status string")
    done = facts.complete_operations(parsed, head, none, api, "2024-01-01")
    page = spark.createDataFrame([("d", 1, 0, "PROPOSED CREDIT IN THE AMOUNT OF EUR 350 MILLION (US$411 MILLION EQUIVALENT) AND A PROPOSED GRANT IN THE AMOUNT OF US$9 MILLION TO X")], "doc_id string, page int, row_no int, text string")
    r = facts.with_cover_amounts(done, facts.cover_facts(page)).first()
    assert [(f.source, f.orig_currency, f.orig_millions, f.orig_from) for f in r.financing] == [("IDA", "EUR", 350.0, "cover"), (None, "USD", 5.0, "datasheet")]
    assert {f.kind for f in r.flags} >= {"cover_amount_unmatched", "country_unmapped"} and (r.region, r.region_source) == ("R", "api")
    other = spark.createDataFrame([("P123456", "WATER!", "Sea", "Investment Project Financing", ["roads r"], 400_000_000.0)], "project_id string, name string, country string, instrument string, implementing_agencies array<string>, ida_commitment_usd double")
    assert {(c.field, c.own) for c in facts.record_conflicts(done, other).collect()} == {("country", "Land"), ("ida_commitment_usd", "411000000")}
    assert facts.api_practice_area(F.lit("<GP_PRACTICE_NAME><![CDATA[Water]]")) is not None
    assert spark.range(1).select(facts.api_practice_area(F.lit("x <GP_PRACTICE_NAME><![CDATA[Water]] cut")).alias("a")).first().a == "Water"


def test_traces_passes_changes_and_pages(spark, tmp_path):
    from opgraph.operators.retrieve import forget_maps, cached_map

    n = evaluate.save_trace(str(tmp_path / "q1.jsonl"), "Why?", ['{"type": "x", "text": "a@b.org secretkey"}'], {"KEY": "secretkey"})
    text = (tmp_path / "q1.jsonl").read_text().splitlines()
    assert n == 2 and json.loads(text[0]) == {"question": "Why?"} and "secretkey" not in text[1] and "[email redacted]" in text[1]
    lines = spark.createDataFrame([("q1.jsonl", 0, text[0]), ("e2.jsonl", 0, '{"type": "system"}')], "file string, line int, value string")
    known = spark.createDataFrame([("e2", "How?")], "id string, question string")
    assert {r.file: r.question for r in evaluate.read_trace(lines, known).collect()} == {"q1.jsonl": "Why?", "e2.jsonl": "How?"}
    s = spark.createDataFrame([("graph", True, 0.5), ("graph", False, None), ("edge", True, 1.0)], "category string, passed boolean, cost double")
    assert {tuple(r) for r in evaluate.passes(s).collect()} == {("graph", 2, 1, 0.5), ("edge", 1, 1, 1.0), (None, 3, 2, 1.5)}
    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, v int"), spark.createDataFrame([("x", 1), ("y", 9), ("w", 4)], "k string, v int")
    assert {r.change: r.n for r in graph.changes(a, b, "k").collect()} == {"same": 1, "changed": 1, "created": 1, "gone": 1} and graph.changes(None, b, "k").first().n == 3
    page = sinks.results_page([{"id": "r1", "topic": "t", "mode": "m", "passed": True, "recall": None, "joint_rank": 2}, {"id": "r2", "mode": "m", "passed": False, "recall": 0.5, "joint_rank": None}])
    assert "| r1 | t | m | pass@2 | n/a |" in page and "m: 1/2 passed, MRR 0.25" in page
    defines = spark.createDataFrame([("A", "x", "d")], "acronym string, expansion string, document string")
    assert cached_map(defines, "v1").count() == 1 == cached_map(defines.limit(0), "v1").count()
    forget_maps()
    assert cached_map(defines.limit(0), "v1").count() == 0


def test_pool_limits_rankings_before_the_filters(spark):
    from opgraph.operators.retrieve import search

    rows = [(f"c{i}", "P1" if i else "P2", None, "risks", None, "main", "text", "water " * (9 - i), [1.0, i / 10], "Land", "LD") for i in range(5)]
    c = spark.createDataFrame(rows, "chunk_id string, project_id string, phase_project_id string, type string, subtype string, scope string, kind string, text string, embedding array<double>, country string, country_iso2 string")
    ids = lambda **o: sorted(r.id for r in search(c, "water", [1.0, 0.0], project_ids=["P1"], **o).collect())
    assert ids() == ["c1", "c2", "c3", "c4"] and ids(pool=2) == ["c1"]
    assert sorted(r.id for r in search(c, "water", project_ids=["P1"], countries=["LÁND"]).collect()) == ["c1", "c2", "c3", "c4"]
