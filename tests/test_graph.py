import datetime

import pytest
from pyspark.sql import functions as F

from opgraph.operators import chunking, graph
from opgraph.operators.patterns import to_sql
from opgraph.operators.query import Rejected, check, graph_query, to_json
from opgraph.plans.keys import salted_row_number, salted_running_sum


def nodes(spark, rows):
    return spark.createDataFrame(rows, "key string, name string, country string, stub boolean, seq int")


def test_staging(spark):
    got = graph.stage_nodes(nodes(spark, [("a", "A1", "X", False, 1), ("a", "A2", None, False, 2), ("a", "stub", "S", True, 9), ("b", "B", None, True, 1), ("c", "C", None, None, 1), (None, "n", None, False, 1)]), "key", "seq")
    assert {(r.key, r.name, r.country, r.stub) for r in got.collect()} == {("a", "A2", "X", False), ("b", "B", None, True), ("c", "C", None, False)}


def test_upsert_is_idempotent_and_null_never_erases(spark):
    cur = nodes(spark, [("a", "A", "X", False, 0), ("s", "old", None, True, 0)]).drop("seq")
    new = nodes(spark, [("a", None, "Y", False, 0), ("s", "full", "Z", False, 0), ("n", "N", None, True, 0)]).drop("seq")
    once = graph.upsert_nodes(cur, new, "key")
    twice = graph.upsert_nodes(once, new, "key")
    want = {("a", "A", "Y", False), ("s", "full", "Z", False), ("n", "N", None, True)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
    stub = graph.upsert_nodes(once, nodes(spark, [("a", "stub", "S", True, 0)]).drop("seq"), "key")
    assert {tuple(r) for r in stub.collect()} == want


def test_edges(spark):
    e = spark.createDataFrame([("o", "p", "d", 1, 5.0), ("o", "p", "d", 2, None), ("o", "p", "x", 1, 7.0)], "src string, dst string, detail string, seq int, amount double")
    staged = graph.stage_edges(e, ["src", "dst", "detail"], "seq")
    assert {(r.detail, r.amount) for r in staged.collect()} == {("d", None), ("x", 7.0)}
    cur = e.where("seq = 1").drop("seq")
    assert {(r.detail, r.amount) for r in graph.upsert_edges(cur, staged, ["src", "dst", "detail"]).collect()} == {("d", 5.0), ("x", 7.0)}
    n = spark.createDataFrame([("o",)], "id string")
    assert graph.resolve_ends(staged, n, "id", n.where("false"), "id").collect() == []


def test_stale_and_tree(spark):
    s = spark.createDataFrame([("h", "s1"), ("h", "s2"), ("other", "s3")], "document_hash string, section_id string")
    assert [r.section_id for r in graph.stale(s, s.where("section_id = 's1'")).collect()] == ["s2"]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = graph.descendants(e, spark.createDataFrame([("a",)], "id string")).collect()
    assert {(r.node, r.hops) for r in got} == {("a", 0), ("b", 1), ("c", 2)}


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO v VALUES (1)", "CREATE VIEW x AS SELECT 1", "EXECUTE IMMEDIATE 'drop table v'", "CALL p()", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM nowhere", "SET a = 1", "SHOW TABLES", "this is no query", "EXPLAIN SELECT 1"])
def test_guard_rejects(spark, sql):
    with pytest.raises(Rejected):
        check(spark, sql, {"v"})


def test_guard_passes_reads(spark):
    spark.range(500).createOrReplaceTempView("v")
    for sql in ("SELECT id FROM v WHERE id > 3 ORDER BY id LIMIT 2", "WITH w AS (SELECT id FROM v) SELECT count(*) FROM w", "SELECT a.id FROM v a JOIN v b ON a.id = b.id", "SELECT 'drop table v' AS x FROM v"):
        check(spark, sql, {"v"})
    got = graph_query(spark, "SELECT id FROM v WHERE id < :n", {"n": 250})
    assert got["row_count"] == 200 and "truncated" in got
    assert "error" in graph_query(spark, "DELETE FROM v") and "error" in graph_query(spark, "SELECT nope FROM v")


def test_patterns(spark):
    spark.createDataFrame([("ida", "IDA", False), ("x", "X", True)], "name_norm string, name string, is_category boolean").createOrReplaceTempView("Organization")
    spark.createDataFrame([("P1", "A"), ("P2", "B")], "project_id string, country string").createOrReplaceTempView("Operation")
    spark.createDataFrame([("ida", "P1", 5), ("ida", "P2", 6), ("x", "P1", 7)], "src string, dst string, amount_usd int").createOrReplaceTempView("FINANCES")
    got = graph_query(spark, "MATCH (g:Organization)-[f:FINANCES]->(o:Operation) WHERE NOT coalesce(g.is_category, false) RETURN g.name AS name, collect(DISTINCT o.project_id) AS ops, count(*) AS n")
    assert [(r["name"], sorted(r["ops"]), r["n"]) for r in got["rows"]] == [("IDA", ["P1", "P2"], 2)]
    got = graph_query(spark, "MATCH (o:Operation {project_id: $p})<-[:FINANCES]-(g:Organization) RETURN g.name_norm AS g ORDER BY g LIMIT 1", {"p": "P1"})
    assert got["rows"] == [{"g": "ida"}]
    spark.createDataFrame([("d",)], "hash string").createOrReplaceTempView("Document")
    spark.createDataFrame([("s1", "A"), ("s2", "B"), ("s3", "C")], "section_id string, title string").createOrReplaceTempView("Section")
    spark.createDataFrame([("d", "s1")], "src string, dst string").createOrReplaceTempView("HAS_SECTION")
    spark.createDataFrame([("s1", "s2"), ("s2", "s3")], "src string, dst string").createOrReplaceTempView("HAS_SUBSECTION")
    walk = lambda e: [r["t"] for r in graph_query(spark, f"MATCH (d:Document)-[:{e}]->(s:Section) RETURN s.title AS t ORDER BY t")["rows"]]
    assert (walk("HAS_SECTION"), walk("HAS_SECTION|HAS_SUBSECTION*"), walk("HAS_SECTION|HAS_SUBSECTION*2..3")) == (["A"], ["A", "B", "C"], ["B", "C"])
    got = graph_query(spark, "MATCH (s:Section {section_id: 's1'})-[:HAS_SUBSECTION*0..]->(t:Section) RETURN t.title AS t ORDER BY t")
    assert [r["t"] for r in got["rows"]] == ["A", "B", "C"]
    for bad in ("MATCH (a)-[:X]->(b) RETURN a", "MATCH (a:Nope) RETURN a", "MATCH (o:Operation)", "MATCH (o:Operation)--(p:Operation) RETURN o"):
        with pytest.raises(ValueError):
            to_sql(bad)
    rows = lambda q, **p: [tuple(r.values()) for r in graph_query(spark, q, p or None)["rows"]]
    assert rows("MATCH (g:Organization)-[f:FINANCES]->(o:Operation) WITH g, collect(DISTINCT o.project_id) AS ops, sum(f.amount_usd) AS usd WHERE size(ops) > 1 RETURN g.name, size(ops), usd") == [("IDA", 2, 11)]
    assert rows("MATCH (o:Operation) OPTIONAL MATCH (o)<-[f:FINANCES]-(g:Organization {name: 'X'}) WHERE f.amount_usd > 6 RETURN o.project_id AS p, count(g) AS n ORDER BY p") == [("P1", 1), ("P2", 0)]
    assert rows("MATCH (d:Document)-[:HAS_SECTION]->(top:Section) OPTIONAL MATCH (top)-[:HAS_SUBSECTION*]->(sub) RETURN top.title, count(sub.title) AS n") == [("A", 2)]
    assert rows("UNWIND [1, 2, 3] AS x RETURN x, [y IN range(1, x) WHERE y > 1 | y * 2] AS l, reduce(s = 0, y IN [1, 2] | s + y) AS t, [7, 8, 9][1..3] AS c, [7, 8][0] AS f ORDER BY x DESC LIMIT 1") == [(3, [4, 6], 3, [8, 9], 7)]
    assert rows("MATCH (o:Operation {project_id: $p}) RETURN labels(o), size(keys(o)), properties(o), o.project_id + ':' + toLower(o.country) AS t, CASE WHEN o.country = 'A' THEN 1 ELSE 2 END AS c", p="P1") == [(["Operation"], 2, {"project_id": "P1", "country": "A"}, "P1:a", 1)]
    assert rows("MATCH (g:Organization)-[f:FINANCES]->(o:Operation) WHERE g.name STARTS WITH 'I' AND o.country IN ['B'] AND NOT g.name =~ 'X.*' RETURN type(f), substring(g.name, 1, 2)") == [("FINANCES", "DA")]
    assert rows("UNWIND ['P1', 'P2'] AS p MATCH (o:Operation {project_id: p}) RETURN p, o.country ORDER BY o.country DESC SKIP 1") == [("P1", "A")]


def test_json():
    assert to_json([0.1] * 60) == "<vector of 60 floats>" and to_json("x" * 4005).endswith("… [5 more chars]") and to_json(datetime.date(2024, 1, 2)) == "2024-01-02"


def test_windows_and_packing():
    words = [f"w{i}" for i in range(1000)]
    got = chunking.windows(words)
    assert got[0] == (0, 400) and got[1][0] == 350 and got[-1][1] == 1000
    for back, end in ((99, 301), (100, 300), (101, 400)):
        w = list(words)
        w[400 - back - 1] = "end."
        assert chunking.windows(w)[0][1] == end
    assert chunking.windows(["a"] * 10) == [(0, 10)] and chunking.windows([]) == []
    assert chunking.windows(["x"] * 3, count=lambda w: 500) == [(0, 1), (1, 2), (2, 3)]
    assert chunking.pack([5, 5, 5, 20, 1], 10) == [(0, 2), (2, 3), (3, 4), (4, 5)] and chunking.pack([], 10) == []


def test_tables_as_markdown():
    rows = [["A", "", "B"], ["1", None, "2|3"], ["", "", ""]] + [[f"r{i} " + "x " * 50, "", "y"] for i in range(20)]
    pieces = chunking.markdown_pieces(rows)
    assert all(p.startswith("| A | B |\n| --- | --- |\n") for p in pieces) and len(pieces) > 1 and "2\\|3" in pieces[0]
    assert all(len(p.split()) <= 400 for p in pieces)
    wide = chunking.markdown_pieces([["h " * 120, "b"], ["1", "2"]])
    assert wide[0].startswith("| col 1 | col 2 |")
    assert chunking.markdown_pieces([]) == [] and chunking.markdown_pieces([["", None]]) == []


def test_chunks(spark):
    secs = spark.createDataFrame([("s1", "P1", "P9", "Land", "A > B", 3, "one two three"), ("g1", "P1", "P9", None, "Abbr", 1, "x")], "section_id string, project_id string, phase_project_id string, country string, path string, page int, text string")
    pairs = spark.createDataFrame([("g1", "WB", "Water Board"), ("g1", "AB", "A Bank")], "section_id string, acronym string, expansion string")
    tabs = spark.createDataFrame([("s1:t0", "s1", 3, [["h", "k"], ["1", "2"]])], "table_id string, section_id string, page int, rows array<array<string>>")
    got = {r.chunk_id: r for r in chunking.build_chunks(secs, pairs, tabs).collect()}
    assert set(got) == {"s1:c0", "g1:g0", "s1:t0:c0"}
    assert got["s1:c0"].embed_text.startswith("Land | P9 | A > B\n") and got["g1:g0"].text == "AB: A Bank\nWB: Water Board" and got["g1:g0"].embed_text.startswith("? | P1 | Abbr\n")
    assert (got["s1:c0"].order, got["s1:t0:c0"].order) == (0, 1)


def test_salted_numbers_and_sums(spark):
    df = spark.range(200).select(F.when(F.col("id") < 150, "hot").otherwise("cold").alias("g"), F.col("id").alias("k"), (F.col("id") % 7 + 1).alias("v"))
    n = salted_row_number(df, ["g"], "k", buckets=8).collect()
    assert sorted(r.rn for r in n if r.g == "hot") == list(range(150)) and sorted(r.rn for r in n if r.g == "cold") == list(range(50))
    s = sorted((r.at, r.v) for r in salted_running_sum(df, ["g"], "k", "v", "at", buckets=8).collect() if r.g == "hot")
    assert s[0][0] == 0 and all(a + v == b for (a, v), (b, _) in zip(s, s[1:]))


def test_buckets_grow_with_the_rows():
    from opgraph.plans.keys import buckets_for

    assert (buckets_for(0), buckets_for(32_000_000), buckets_for(10**12), buckets_for(5, 256)) == (64, 64, 2_000_000, 256)


def test_latest_of_wide_rows_equals_latest(spark, monkeypatch):
    from opgraph.plans import keys

    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", None), (None, "n", 1), ("c", "p", 5), ("c", "q", 5)], "k string, v string, t int")
    want = {("a", "y"), ("b", "z"), ("c", "q")}
    assert {tuple(r) for r in keys.latest(df, "k", ["v"], "t").collect()} == want == {tuple(r) for r in keys.latest_wide(df, "k", ["v"], "t").collect()}
    monkeypatch.setattr(keys, "MOST_REPEATED", 0)
    assert {tuple(r) for r in keys.latest_wide(df, "k", ["v"], "t").collect()} == want
    assert keys.latest_wide(df.limit(0), "k", ["v"], "t").collect() == []
