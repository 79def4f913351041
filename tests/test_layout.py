import random

import pytest
from pyspark.sql import functions as F

from opgraph.functions.vocab import SECTION_GROUPS, SECTION_TYPES
from opgraph.operators import glossary, layout
from opgraph.sources.readers import html_rows


def spans(spark, rows):
    return spark.createDataFrame([("d", p, x, y - 10, x + w, y, t, s, f) for p, x, y, w, t, s, f in rows], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, size double, flags int")


def rows(spark, lines, size=10.0):
    data = [("d", p, i, 0.0, float(i), 10.0, float(i) + 1, t, size, b) for i, (p, t, b) in enumerate(lines)]
    return spark.createDataFrame(data, layout.ROWS)


def test_rows_compare_with_the_first_span(spark):
    got = layout.page_rows(spans(spark, [(1, 0.0, 100.0, 20.0, "a", 10.0, 16), (1, 25.0, 101.5, 10.0, "b", 11.0, 16), (1, 40.0, 103.0, 10.0, "c", 10.0, 0), (1, 200.0, 100.0, 10.0, "far", 10.0, 0)])).orderBy("row_no").collect()
    assert [(r.text, r.size, r.bold) for r in got] == [("a b", 11.0, True), ("far", 10.0, False), ("c", 10.0, False)]


def test_boilerplate_threshold(spark):
    pages = [(p, t, False) for p in range(1, 11) for t in ([f"Page {p}"] + (["Footer"] if p <= 2 else []) + [f"body {'x' * p}"])]
    kept = [r.text for r in layout.drop_boilerplate(rows(spark, pages)).collect()]
    assert "Footer" in kept and not any(t.startswith("Page") for t in kept)


def test_tables(spark):
    t = spark.createDataFrame([("d", 0, 1, [0.0, 0.0, 10.0, 5.0], [["a", "b"], ["", None]], 2, 0), ("d", 1, 1, [0.0] * 4, [["a", "b"]], 1, 1), ("d", 2, 1, [0.0] * 4, [["a"]], 9, 9)], "doc_id string, table_no int, page int, bbox array<double>, rows array<array<string>>, h_rules int, v_rules int")
    real = layout.real_tables(t).collect()
    assert [r.table_no for r in real] == [0] and real[0].rows == [["a", "b"]]
    out = layout.outside_tables(rows(spark, [(1, "in", False), (2, "other page", False)]), t.where("table_no = 0")).collect()
    assert [r.text for r in out] == ["other page"]


def test_headings(spark):
    lines = [
        (1, "I. Context ........ 2", False), (1, "Special Topic ........ 3", False), (1, "II. Design ........ 4", False), (2, "DATASHEET", False), (2, "I. Context", True), (2, "A. Country", True), (2, "F. Late", True), (2, "A. Restart", True), (2, "B. After", True), (2, "Special Topic", True),
        (2, "plain text", False), (2, "Unlisted bold", True), (3, "II. Design", True), (3, "D. Results Chain", True), (3, "D. Results Chain. PDO: more", True), (3, "ANNEX 3.1. Detail", True), (3, "A. Under annex", True),
    ]
    got = {r.text: r.level for r in layout.detect_headings(rows(spark, lines)).where("level is not null").collect()}
    assert got == {"DATASHEET": 1, "I. Context": 1, "A. Country": 2, "F. Late": 2, "A. Restart": 3, "B. After": 3, "Special Topic": 4, "II. Design": 1, "D. Results Chain": 2, "ANNEX 3.1. Detail": 2, "A. Under annex": 3}


def test_sections_parents_types(spark):
    lines = [(1, "cover", False), (1, "I. Strategic Context", True), (1, "x", False), (1, "A. Country Context", True), (1, "y", False), (2, "B. Other", True), (2, "II. Key Risks", True), (2, "A. MPA Phase 2", True)]
    secs = layout.parents(layout.assemble(layout.detect_headings(rows(spark, lines))))
    typed = layout.assign_scope(layout.assign_types(secs, SECTION_TYPES, SECTION_GROUPS)).orderBy("order").collect()
    assert [(s.order, s.level, s.parent, s.type, s.subtype, s.inherited, s.scope) for s in typed] == [
        (0, 0, None, "front_matter", "front_matter", False, "main"), (1, 1, None, "context", "strategic_context", False, "main"), (2, 2, 1, "context", "country_context", False, "main"),
        (3, 2, 1, "context", "strategic_context", True, "main"), (4, 1, None, "risks", "key_risks", False, "main"), (5, 2, 4, "mpa", "mpa_phase", False, "phase")]
    assert typed[0].text == "cover" and typed[2].text == "y"


def test_table_owner(spark):
    s = spark.createDataFrame([("d", 0, 0, 1, 0.0), ("d", 1, 1, 1, 50.0), ("d", 2, 1, 2, 10.0), ("d", 3, 2, 2, 12.0)], "doc_id string, order int, level int, page int, top double")
    t = spark.createDataFrame([("d", 0, 1, 5.0, 9.0), ("d", 1, 1, 60.0, 70.0), ("d", 2, 2, 9.0, 30.0), ("d", 3, 3, 0.0, 1.0)], "doc_id string, table_no int, page int, top double, bottom double")
    assert {r.table_no: r.order for r in layout.table_owner(t, s).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_document_facts(spark):
    r = rows(spark, [(1, "PRO JECT PA PER", False), (1, "on (P123456)", False), (2, "(P123456) and (P999999)", False), (3, "x", False)])
    assert layout.document_types(r).first().doc_type == "project_paper" and layout.project_ids(r).first().project_id == "P123456"
    sizes = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 0.0, 0.0, "abcdef", 9.96, False), ("d", 1, 1, 0.0, 0.0, 0.0, 0.0, "abc", 12.0, False)], layout.ROWS)
    assert layout.body_size(sizes).first().body == 10.0


@pytest.mark.parametrize(("text", "want"), [
    ("ABBREVIATIONS\nIDA International Association\nAfDB\nAfrican Bank\nWater Board\nWB\nTABLE OF CONTENTS\nXX Later", [("IDA", "International Association"), ("AfDB", "African Bank"), ("WB", "Water Board")]),
    ("no list\nIDA x", []), ("ABBREVIATIONS\nIDA One\nEnd ........ 3\nWB Two", [("IDA", "One")]),
])
def test_glossary(spark, text, want):
    got = glossary.from_text(spark.createDataFrame([("d", text), ("n", None), ("e", "")], "id string, text string"), "id").orderBy("at").collect()
    assert [(r.acronym, r.expansion) for r in got] == want


def test_glossary_halves_as_a_fold(spark):
    rng = random.Random(2)
    words = {"a": "WB", "e": "Water Board", "f": "IDA International Association"}
    texts = ["".join(rng.choice("aaeef") for _ in range(rng.randint(0, 9))) for _ in range(120)]

    def fold(kinds):
        out, waiting = [], None
        for i, k in enumerate(kinds):
            if k == "f" or (waiting and waiting != k):
                out.append(i)
                waiting = None
            else:
                waiting = k
        return out

    df = spark.createDataFrame([(i, "\n".join(words[k] + (str(j) if k != "f" else "") for j, k in enumerate(t))) for i, t in enumerate(texts)], "id int, text string")
    got = {}
    for r in glossary.from_text(df, "id", needs_start=False).collect():
        got.setdefault(int(r.id), set()).add(r["at"])
    assert {i: set(fold(t)) for i, t in enumerate(texts) if fold(t)} == got


def test_glossary_merge(spark):
    t = spark.createDataFrame([("d", [["e-GP", "electronic Procurement"], ["a", "b", "c"], ["IDA", "From a table"]])], "id string, rows array<array<string>>")
    x = spark.createDataFrame([("d", "ABBREVIATIONS\nIDA International Association\nWB Water Board")], "id string, text string")
    got = glossary.merge(glossary.from_tables(t, "id").unionByName(glossary.from_text(x, "id"))).collect()
    assert {r.acronym: r.expansion for r in got} == {"e-GP": "electronic Procurement", "IDA": "From a table", "WB": "Water Board"}


def test_html_rows(spark):
    p = spark.createDataFrame([("1", "<title>t</title><h1>Head</h1><p>One <b>two</b></p><li>item</li>")], "id string, html string")
    assert [(r.text, r.bold) for r in html_rows(p, "id", "html").orderBy("row_no").collect()] == [("Head", True), ("One two", False), ("item", False)]


def test_validation(spark):
    s = spark.createDataFrame([(f"s{i}", "risks", "key_risks", False, c, "baseline targets indicator" if i == 0 else "target") for i, c in enumerate([10, 10, 10, 100])] + [("e", "x", None, False, 0, None)], "section_id string, type string, subtype string, inherited boolean, chars int, text string")
    assert [r.section_id for r in layout.size_flags(s).collect()] == ["s3"]
    assert [(r.section_id, r.n) for r in layout.results_words(s).collect()] == [("s0", 3)]
    d = spark.createDataFrame([("h", "main", "key_risks", False), ("h", "main", "datasheet", True)], "document_hash string, scope string, subtype string, inherited boolean")
    assert {r.subtype for r in layout.missing_core(d, ["key_risks", "datasheet"]).collect()} == {"datasheet"}
    assert layout.missing_core(d.where(F.lit(False)), ["a"]).collect() == []


def test_deep_levels_scope_and_ids(spark):
    secs = spark.createDataFrame([("d", i, i, f"T{i}" if i != 2 else "MPA Phase 2 Annex") for i in range(1, 13)] + [("d", 13, 2, "Other")], "doc_id string, order int, level int, title string")
    tree = layout.parents(secs)
    assert {r.order: r.parent for r in tree.collect()} == {1: None, **{i: i - 1 for i in range(2, 13)}, 13: 1}
    typed = tree.withColumn("subtype", F.when(F.col("order") == 2, "mpa_phase")).withColumn("inherited", F.lit(False))
    ids = spark.createDataFrame([("d", 2, "P222222")], "doc_id string, phase int, project_id string")
    got = {r.order: (r.scope, r.phase, r.phase_project_id) for r in layout.assign_scope(typed, ids).collect()}
    assert got[1] == got[13] == ("main", None, None) and {got[i] for i in range(2, 13)} == {("phase", 2, "P222222")}


def test_framework_tables_and_sizes(spark):
    secs = spark.createDataFrame([("d", 1, "mpa_framework", "s1", "abc"), ("d", 2, "key_risks", "s2", None)], "doc_id string, order int, subtype string, section_id string, text string")
    tabs = spark.createDataFrame([("d", 1, 0, "s1", [["1", "Land; P111111"], ["2", "none"], ["1", "P999999"], ["x", "P3"]]), *[("d", 2, i, "s2", [["ab", None]]) for i in range(3)]], "doc_id string, order int, table_no int, section_id string, rows array<array<string>>")
    assert [tuple(r) for r in layout.framework_ids(secs, tabs).collect()] == [("d", 1, "P111111")]
    assert [tuple(r) for r in layout.key_risk_tables(secs, tabs).collect()] == [("s2", 3)]
    assert {r.section_id: r.size for r in layout.section_sizes(secs, tabs).collect()} == {"s1": 3 + 1 + 13 + 1 + 4 + 1 + 7 + 1 + 2, "s2": 6}
    docs = spark.createDataFrame([("h", "a", "main", "x", False), ("g", "b", "main", "y", False)], "document_hash string, doc_type string, scope string, subtype string, inherited boolean")
    assert {tuple(r) for r in layout.missing_core(docs, {"default": ["x"], "b": ["z"]}).collect()} == {("g", "z")}
