import json
import time

import pytest
from pyspark.sql import functions as F

from opgraph.operators import evaluate, facts, index, retrieve
from opgraph.sources import readers
from opgraph.streaming.ingest import hits_per_window, ingest, read_stream

CONTEXT = "chunk_id string, text string, embedding array<float>, kind string, project_id string, phase_project_id string, type string, subtype string, scope string, path string, name string, country string, country_iso2 string"


def context(spark):
    rows = [
        ("c1", "water tariffs rise", [1.0, 0.0], "text", "P1", None, "context", "country_context", "main", "p", "One", "Land", "LA"), ("c2", "roads", [0.9, 0.1], "text", "P1", "P2", "risks", "key_risks", "phase", "p", "One", "Land", "LA"),
        ("c3", "water", [0.0, 1.0], "text", "P2", None, "context", None, "main", "p", "Two", None, None), ("c4", "water water", None, "text", "P3", None, "front_matter", None, "main", "p", "Three", "Sea", "SE"),
        ("c5", "IDA: water", [0.5, 0.5], "glossary", "P3", None, "front_matter", None, "main", "p", "Three", "Sea", "SE"), ("c6", "water", [0.1, 0.1], "text", "P4", None, None, None, "main", "p", "Four", "Sea", "SE"),
    ]
    return spark.createDataFrame(rows, CONTEXT)


def ids(df):
    return [r.chunk_id for r in df.orderBy("chunk_id").collect()]


def test_filters(spark):
    c = context(spark)
    f = retrieve.context_filter
    assert ids(c.where(f())) == ["c1", "c2", "c3", "c5"]
    assert ids(c.where(f(include_front_matter=True))) == ["c1", "c2", "c3", "c4", "c5", "c6"]
    assert ids(c.where(f(countries=["land", "se"]))) == ["c1", "c2", "c5"]
    assert ids(c.where(f(project_ids=["P2"]))) == ["c2", "c3"] and ids(c.where(f(types=["key_risks"], scope="phase"))) == ["c2"]


def test_fusion_order_and_grouping(spark):
    c = context(spark)
    hits = retrieve.search(c, "water tariffs", [1.0, 0.0]).collect()
    assert hits[0].id == "c1" and hits[0].matched_by == ["vector", "fulltext"] and {h.id for h in hits} == {"c1", "c2", "c3", "c5"}
    g = retrieve.search(c, "water", [1.0, 0.0], 4, 2, ["P2", "P1"]).collect()
    assert [h.group for h in g] == ["P2", "P2", "P1", "P1"] and sum(h.id == "c2" for h in g) == 2
    tie = index.fuse(spark.createDataFrame([("v", 1.0, 1)], "id string, score double, rank int"), spark.createDataFrame([("t", 1.0, 1)], "id string, score double, rank int"), 2).collect()
    assert [r.id for r in tie] == ["v", "t"]


def test_payload(spark):
    c = context(spark)
    out = retrieve.retrieve(c, "What about water in IDA?", [1.0, 0.0], project_ids=["P1", "P9"], per_project_k=2, known=spark.createDataFrame([("IDA", ["Int Dev"])], "acronym string, expansions array<string>"))
    assert out["expansions"] == {"IDA": ["Int Dev"]} and out["projects_without_results"] == ["P9"] and [h["rank"] for h in out["hits"]] == [1, 2]
    assert "error" in retrieve.retrieve(c, "x", scope="nope") and "error" in retrieve.retrieve(c, "x", per_project_k=1)
    assert len(retrieve.retrieve(c, "water", k=99)["hits"]) == 3


def test_terms_and_empty_corpus(spark):
    assert index.query_terms("What is the IDA tariff of it?") == ["ida", "tariff"]
    assert index.bm25(context(spark).limit(0), ["water"], "chunk_id").collect() == []
    assert retrieve.search(context(spark).where(F.lit(False)), "water", [1.0, 0.0]).collect() == []


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([("a", "water board"), ("b", "water board"), ("c", "roads")], "chunk_id string, embed_text string")
    cache = spark.createDataFrame([], "key string, embedding array<float>")
    out, first = index.embed_with_cache(chunks, cache)
    rows = {r.chunk_id: r.embedding for r in out.collect()}
    assert rows["a"] == rows["b"] != rows["c"] and first.count() == 2 and abs(sum(x * x for x in rows["a"]) - 1) < 1e-5
    _, kept = index.embed_with_cache(chunks.where("chunk_id = 'a'"), first)
    assert kept.count() == 2  # nothing was computed, nothing is pruned
    assert index.embed_with_cache(chunks.where("chunk_id = 'a'").unionByName(spark.createDataFrame([("d", "new")], chunks.schema)), first)[1].count() == 2


def test_scores(spark):
    hits = spark.createDataFrame([(1, 1, "P1", "context", None, "main"), (1, 2, "P2", "risks", None, "main"), (2, 1, "P9", "x", None, "main")], "question_id int, rank int, project_id string, type string, subtype string, scope string")
    exp = spark.createDataFrame([(1, ["P1", "P2"], ["risks"], "main"), (2, ["P1"], [], None), (3, [], [], None)], "question_id int, projects array<string>, types array<string>, want_scope string")
    got = {r.question_id: r for r in evaluate.score_retrieval(hits, exp).collect()}
    assert (got[1].recall, got[1].joint_rank, got[1].passed) == (1.0, 2, True) and (got[2].recall, got[2].rr) == (0.0, 0.0) and got[3].recall is None
    assert evaluate.summary(evaluate.score_retrieval(hits, exp)).first().passed == 1
    a = spark.createDataFrame([(1, "The IDA gives 45 million to P1", ["graph_query"], 0, [["graph_query", "retrieve"]], ["p1"], [["45", "forty"], ["re:IDA"]], [["re:ida"]]), (2, "no", [], 1, [["x"]], [], [], [])], "question_id int, answer string, tools array<string>, errors int, expect_route array<array<string>>, expect_ids array<string>, expect_facts array<array<string>>, must_not array<array<string>>")
    assert [r.passed for r in evaluate.score_answers(a).orderBy("question_id").collect()] == [True, False]


def test_transcripts(spark, tmp_path):
    use = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "1", "name": "mcp__srv__retrieve", "input": {"q": 1}}]}}
    res = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": json.dumps({"error": "x"})}]}}
    two = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "2", "name": "retrieve", "input": {}}]}}
    (tmp_path / "t.jsonl").write_text("\n".join(["noise", json.dumps(use), "{broken", json.dumps(res), json.dumps(two)]))
    events = evaluate.parse_events(readers.read_lines(spark, str(tmp_path / "t.jsonl")))
    calls = evaluate.tool_calls(events)
    got = {r.id: r for r in calls.collect()}
    assert got["1"].tool == "retrieve" and got["1"].error and got["2"].output is None
    assert evaluate.routes(calls).first().route == "retrieve ×2"
    assert evaluate.scrub("key abcdef at /home/u a@b.co", {"KEY": "abcdef", "S": "at"}, "/home/u") == "key <KEY> at ~ [email redacted]"
    assert "1. retrieve" in evaluate.report("t", [{"tool": "retrieve", "input": {"a": 1}, "output": "x" * 400}], None)


def test_questions_and_manifest(spark, tmp_path):
    q = tmp_path / "q.jsonl"
    q.write_text('{"id":"a","question":"x","category":"graph","expect_facts":["45",["a","b"]]}\n\n{"id":"b","question":"y","expect_route":["r"]}\n')
    rows = {r.id: r for r in readers.read_questions(spark, str(q)).collect()}
    assert rows["a"].expect_facts == [["45"], ["a", "b"]] and rows["b"].expect_route == [["r"]] and rows["b"].expect_ids == []
    for bad in ('{"id":"a","question":"x"}\n{"id":"a","question":"y"}', '{"id":"a"}', '{"id":"a","question":"x","category":"zzz"}'):
        q.write_text(bad)
        with pytest.raises(ValueError):
            readers.read_questions(spark, str(q))
    (tmp_path / "f.bin").write_bytes(b"abc")
    m = spark.createDataFrame([("f.bin", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("g.bin", "x")], "filename string, sha256 string")
    assert {r.filename: r.status for r in readers.verify_manifest(spark, str(tmp_path / "*.bin"), m).collect()} == {"f.bin": "ok", "g.bin": "missing"}


def test_api_and_pairs(spark):
    idf, cache = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "project_id string"), spark.createDataFrame([("P1", "{}")], "project_id string, payload string")
    assert {r.project_id: r.how for r in readers.api_records(idf, cache).collect()} == {"P1": "cache", "P2": "not_found", "P3": "not_found"}
    got = {r.project_id: r for r in readers.api_records(idf, cache, lambda p: {"team_lead": "x", "a": 1} if p == "P2" else None).collect()}
    assert got["P2"].payload == '{"a": 1}' and got["P3"].how == "not_found"
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], "stem string, s int"), spark.createDataFrame([("x", 2), ("z", 2)], "stem string, d int")
    pairs, notes = readers.pair_extractions(a, b)
    assert [r.stem for r in pairs.collect()] == ["x"] and {(r.stem, r.note) for r in notes.collect()} == {("y", "no datasheet"), ("z", "no sections")}


def test_stream_upserts_are_idempotent(spark, tmp_path):
    src, root = tmp_path / "in", f"file://{tmp_path}/table"
    schema = "hit_id long, project_id string, rrf double, asked_at timestamp, loaded_at timestamp"
    ts = "2024-01-01 0{}:00:00"
    make = lambda rows: spark.createDataFrame(rows, "hit_id long, project_id string, rrf double, a string, l string").select("hit_id", "project_id", "rrf", F.col("a").cast("timestamp").alias("asked_at"), F.col("l").cast("timestamp").alias("loaded_at"))
    make([(1, "P1", 0.1, ts.format(0), ts.format(1)), (2, "P2", 0.2, ts.format(0), ts.format(1))]).coalesce(1).write.mode("append").parquet(str(src))
    for n in range(2):
        ingest(spark.readStream.schema(schema).parquet(str(src)), root, "hit_id", "loaded_at", str(tmp_path / f"cp{n}")).awaitTermination()
    make([(1, "P1", 0.9, ts.format(0), ts.format(5)), (2, "P2", 0.0, ts.format(0), ts.format(0))]).coalesce(1).write.mode("append").parquet(str(src))
    ingest(read_stream(spark, str(src), str(src)), root, "hit_id", "loaded_at", str(tmp_path / "cp1")).awaitTermination()
    assert {(r.hit_id, r.rrf) for r in readers.read_version(spark, root).collect()} == {(1, 0.9), (2, 0.2)}
    q = hits_per_window(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.project_id, r.hits) for r in spark.table("w").collect()} == {("P1", 1), ("P2", 1)}


SHEET = [
    ["Operation ID", "", "", "Financing Instrument", "", "Environmental and Social Risk Classification"], ["P123456", "", "Investment Project Financing", "", "Substantial", ""], ["Operation Name", "Country"], ["Water for All", "Land"],
    ["Implementation Modalities"], ["[✓] Multiphase Programmatic Approach (MPA) [ ] Series of Projects (SOP)"], ["[x] Fragile State(s) [ ] Small State"], ["Expected Approval Date", "Expected Closing Date"], ["1-Feb-2026", "30-Jun-2031"],
    ["Proposed Development Objective"], ["To improve water"], ["for all."], ["Organizations"], ["Borrower: Republic of Land"], ["Implementing Agency: Ministry of Water (MoW), Roads Agency (RA),"], ["Port Agency (PA)"],
    ["Total Project Cost", "110.00"], ["Total Financing", "110.00"], ["Financing Gap", "0.00"], ["International Development Association (IDA)", "100.00"], ["IDA Credit", "45.00"], ["IDA Grant", "55.00"], ["Counterpart Funding", "10.00"], ["Borrower/Recipient"], ["10.00"],
    ["1. Political and Governance", "High"], ["2. Macroeconomic", "Low"], ["Overall", "Substantial"],
]


def test_sheet(spark):
    r = facts.parse_sheets(spark.createDataFrame([("d", SHEET), ("e", None)], "doc_id string, rows array<array<string>>")).orderBy("doc_id").collect()
    d = r[0]
    assert (d.project_id, d.instrument, d.es_risk_rating, d.name, d.country) == ("P123456", "IPF", "Substantial", "Water for All", "Land")
    assert d.modalities == ["fragile_state", "mpa"] and (d.approval_date, d.closing_date) == ("2026-02-01", "2031-06-30") and d.pdo_text == "To improve water for all."
    assert [a.name for a in d.agencies] == ["Republic of Land", "Ministry of Water (MoW)", "Roads Agency (RA)", "Port Agency (PA)"]
    assert [(f.category, f.source, f.detail, f.amount_usd, f.balanced) for f in d.financing] == [("lender", "IDA", "IDA Credit", 45000000, True), ("lender", "IDA", "IDA Grant", 55000000, True), ("counterpart", "Republic of Land", "Borrower/Recipient", 10000000, True)]
    assert d.totals["total_financing"] == 110.0 and d.overall_risk == "Substantial" and [x.rating for x in d.risks] == ["High", "Low"]
    assert r[1].financing == [] and r[1].project_id is None


def test_amounts_conflicts_phases(spark):
    parts = spark.createDataFrame([("d", 1, 45.0), ("d", 2, 45.2), ("d", 3, 300.0)], "doc_id string, part int, amount_millions double")
    covers = spark.createDataFrame([("d", 0, 45.1), ("d", 1, 45.1), ("d", 2, 45.1), ("d", 3, 299.0)], "doc_id string, cover int, usd_millions double")
    assert {(r.part, r.cover) for r in facts.match_amounts(parts, covers).collect()} == {(1, 0), (2, 1), (3, 3)}
    a, b = spark.createDataFrame([("p", "X", None, "same")], "k string, f string, g string, h string"), spark.createDataFrame([("p", "Y", "z", "SAME")], "k string, f string, g string, h string")
    assert [(r.field, r.own, r.other) for r in facts.conflicts(a, b, "k", ["f", "g", "h"]).collect()] == [("f", "X", "Y")]
    assert facts.merge_api(a, b, "k", ["f", "g", "h"]).first().asDict() == {"k": "p", "f": "X", "g": "z", "h": "same", "api_status": "sparse"}
    ph = spark.createDataFrame([("m", 1, 1.0, None, 2.0), ("m", 3, 2.0, 5.0, None)], "program_id string, phase int, ibrd double, ida double, other double")
    r = facts.reconcile_phases(ph).first()
    assert (r.missing, r.ibrd, r.ida, r.other) == ([2], 3.0, 5.0, 2.0)


MORE = [
    ["Operation ID", "Financing Instrument", "Process"], ["P123456", "Investment Project Financing", "Urgent"], ["", "(IPF)", "Need"], [None], ["Practice Area (Lead)", "", "Contributing Practice Areas"], ["Water", "", "Energy;"], ["", "", "Health"],
    ["MPA Program Financing Envelope", "300.00"], ["of which Bank Financing (IDA)", "90.00"], ["Overall MPA Program", "High"],
    ["1", "Land; P123456", "Sequential", "aim", "IPF", "10.0", "80.0", "", "Sept-25", "High"], ["2", "Later", "Simultaneous", "aim", "P4R", "20.0", "5.0", "7.0"], ["2", "Again", "x", "IPF", "1.0"],
    ["World Bank Group Financing"], ["Trust Funds", "5.00"], ["Energy Fund (EF)", "5.00"],
]


def test_sheet_with_program(spark):
    df = spark.createDataFrame([("d", MORE)], "doc_id string, rows array<array<string>>")
    parsed = facts.parse_sheets(df, {"energy fund ef": "EF"})
    d = parsed.first()
    assert d.instrument_text == "Investment Project Financing (IPF)" and d.practice_area_lead == "Water" and d.practice_areas_contributing == ["Energy", "Health"]
    assert d.envelope_millions == 300.0 and d.envelope_breakdown.ida == 90.0 and [(r.category, r.scope) for r in d.risks] == [("Overall MPA Program", "mpa_program")]
    assert [(p.phase, p.project_id, p.label, p.instrument, p.ibrd, p.ida, p.estimated_approval, p.is_this_operation) for p in d.phases] == [(1, "P123456", "Land", "IPF", 10.0, 80.0, "Sept-25", True), (2, None, "Later", "PforR", 20.0, 5.0, None, False)]
    assert [(f.side, f.source, f.detail) for f in d.financing if f.label.startswith("Energy")] == [("World Bank Group", "EF", "Energy Fund (EF)")]
    assert {(m.field, m.kind) for m in d.missing} >= {("name", "absent"), ("pdo_text", "absent")}
    assert [(r.check, r.expected, r.found) for r in facts.program_checks(parsed).collect()] == [("ida", 90.0, 85.0)]
    head, land = spark.createDataFrame([("d", "P123456")], "doc_id string, header_id string"), spark.createDataFrame([("land", "Land", "LD", "R")], "name_norm string, canonical string, iso2 string, region string")
    api = spark.createDataFrame([("P123456", None, "Active", "ok")], "project_id string, region string, status string, api_status string")
    r = facts.complete_operations(parsed, head, land, api, "2024-01-01").first()
    assert (r.project_id_confirmed, r.status, r.status_source, r.region, r.country_iso2) == (True, "Active", "api", None, None)


def test_sheet_of_many_lines(spark):
    """400 lines took minutes when labels and sums were evaluated again for each line; sums are of whole dollars, so 39.99 is within 0.01 of 40."""
    lender = "International Development Association (IDA)"
    forms = [("d", [[lender, "400.00"], *[[f"Part {i}", "1.00"] for i in range(400)]]), ("e", [[lender, "40.00"], ["A", "2.063"], ["B", "9.365"], ["C", "28.582"]])]
    start = time.perf_counter()
    d, e = facts.parse_sheets(spark.createDataFrame(forms, "doc_id string, rows array<array<string>>")).orderBy("doc_id").collect()
    assert time.perf_counter() - start < 90
    assert len(d.financing) == 400 and all(f.balanced and f.source == "IDA" and f.amount_usd == 1_000_000 for f in d.financing)
    assert [(f.label, f.amount_usd, f.balanced) for f in e.financing] == [("A", 2_063_000, True), ("B", 9_365_000, True), ("C", 28_582_000, True)]


def test_sheet_fields(spark):
    df = spark.createDataFrame([("d", SHEET), ("e", None)], "doc_id string, rows array<array<string>>")
    some, whole = facts.parse_sheets(df, fields=["financing"]), facts.parse_sheets(df)
    assert some.columns == ["doc_id", "financing"] and some.schema["financing"] == whole.schema["financing"]
    assert sorted(some.collect()) == sorted(whole.select("doc_id", "financing").collect())


def test_sheet_rows_and_cover(spark):
    secs = spark.createDataFrame([("d", 3, "datasheet"), ("d", 5, "datasheet"), ("e", 1, "datasheet"), ("f", 1, "x")], "doc_id string, order int, subtype string")
    tabs = spark.createDataFrame([("d", 3, 1, [["b"]]), ("d", 3, 0, [["a"], ["c"]]), ("d", 5, 2, [["z"]])], "doc_id string, order int, table_no int, rows array<array<string>>")
    assert {r.doc_id: r.rows for r in facts.sheet_rows(secs, tabs).collect()} == {"d": [["a"], ["c"], ["b"]], "e": []}
    rows = spark.createDataFrame([("d", 1, 0, "Report No: PAD123"), ("d", 1, 1, "PROPOSED CREDIT IN THE AMOUNT OF EUR 350 MILLION (US$411 MILLION EQUIVALENT) TO X ON May 3, 2025")], "doc_id string, page int, row_no int, text string")
    r = facts.cover_facts(rows).first()
    assert r.report_number == "PAD123" and str(r.date) == "2025-05-03" and (r.amounts[0].currency, r.amounts[0].usd_millions) == ("EUR", 411.0)


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    from opgraph.sources.readers import bucket_paths, read_version
    from opgraph.streaming.ingest import upsert

    root = f"file://{tmp_path}/t"
    df = lambda rows: spark.createDataFrame(rows, "k long, v string, t int")
    assert upsert(df([]), root, "k", "t", 8) == 0 and read_version(spark, root) is None
    upsert(df([(i, "a", 1) for i in range(100)] + [(None, "n", 1)]), root, "k", "t", 8)
    before = bucket_paths(spark, root)
    assert len(before) == 8 and upsert(df([(7, "b", 2), (8, "old", 0)]), root, "k", "t", 8) <= 2
    after = bucket_paths(spark, root)
    assert sum(before[b] == after[b] for b in before) >= 6
    got = {r.k: r.v for r in read_version(spark, root).collect()}
    assert len(got) == 100 and got[7] == "b" and got[8] == "a"
