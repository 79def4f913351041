import random

from pyspark.sql import functions as F

from opgraph.llm.topn import best_hits, top_n

SCHEMA = "hit_id long, project_id string, rrf double, vector_rank int, loaded_at timestamp, grp string, item int"


def frame(spark, rows):
    import datetime

    return spark.createDataFrame([(h, p, s, v, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), "x", 0) for h, p, s, v, t in rows], SCHEMA)


def expected(rows, n):
    last = {}
    for h, p, s, v, t in rows:
        if h is not None and (h not in last or t > last[h][3]):
            last[h] = (p, s, v, t)
    groups = {}
    for h, (p, s, v, _) in last.items():
        if p is not None and s is not None and s == s:
            groups.setdefault(p, []).append((-s, v is None, v or 0, h))
    return {(p, h) for p, g in groups.items() for *_, h in sorted(g)[:n]}


def test_light_and_heavy_groups_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", "c", None]), rng.choice([0.1, 0.2, 0.3, None, float("nan"), float("inf")]), rng.choice([1, 2, None]), i) for i in range(900)]
    rows += [(i, "a", 0.9, 1, 5000 + i) for i in range(0, 900, 50)]  # corrected rows
    out = top_n(frame(spark, rows), "project_id", "rrf", "hit_id", 8, [F.asc_nulls_last("t_vector_rank")], "loaded_at", ["vector_rank"], heavy_rows=100, ranges=8, salts=3)
    got = out.collect()
    assert {(r.project_id, r.hit_id) for r in got} == expected(rows, 8)
    ranks = {}
    for r in got:
        ranks.setdefault(r.project_id, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_all_scores_equal_and_minus_infinity(spark):
    rows = [(i, "hot", 0.5, None, i) for i in range(300)] + [(1000 + i, "cold", float("-inf"), None, i) for i in range(3)]
    out = top_n(frame(spark, rows), "project_id", "rrf", "hit_id", 4, None, "loaded_at", [], heavy_rows=50)
    assert {(r.project_id, r.hit_id) for r in out.collect()} == {("hot", i) for i in range(4)} | {("cold", 1000 + i) for i in range(3)}


def test_empty(spark):
    assert best_hits(frame(spark, [])).collect() == []
