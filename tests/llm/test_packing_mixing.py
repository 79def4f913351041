import datetime
from collections import Counter

import numpy as np
import pytest

from opgraph.llm.mixing import allocate, mix, mixed_shares, permute
from opgraph.llm.packing import _intervals, fill_report, pack, plan_patterns

AT = datetime.datetime(2024, 1, 1)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, AT, 7, "x") for i, t, s in rows], "doc_id long, text string, source string, loaded_at timestamp, size int, container string")


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(1)
    histogram = Counter(int(x) for x in rng.integers(1, 101, size=3000))
    runs = plan_patterns(histogram, 100)
    assert all(sum(s * n for s, n in p) <= 100 for _, p in runs)
    used = Counter()
    for bins, p in runs:
        for s, n in p:
            used[s] += bins * n
    assert used == histogram
    bound = -(-sum(s * n for s, n in histogram.items()) // 100)
    assert sum(b for b, _ in runs) <= 1.02 * bound
    assert len(_intervals(runs)) == sum(len(p) for _, p in runs)


@pytest.mark.parametrize("strategy", ["patterns", "harmonic"])
def test_pack(spark, strategy):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(n), "a") for i, n in enumerate(rng.integers(1, 120, size=200))]
    rows += [(1000, "w " * 250, "a"), (1001, None, "a"), (1002, "", "a"), (1003, "   ", "a"), (None, "w", "a"), (3, rows[3][1], "a"), (1000, "w", "a")]
    out = pack(docs(spark, rows), capacity=100, strategy=strategy)
    got = out.collect()
    used = Counter()
    for r in got:
        used[r.container] += r["size"]
    assert max(used.values()) <= 100 and set(used) == set(range(len(used)))
    assert {r.doc_id for r in got} == set(range(200)) | {1000}
    parts = sorted((r.piece, r["size"]) for r in got if r.doc_id == 1000)
    assert parts == [(0, 100), (1, 100), (2, 50)]
    assert all(r.pieces == 1 for r in got if r.doc_id < 200 and len(rows[r.doc_id][1].split()) <= 100)
    report = fill_report(out, 100).first()
    assert report.containers == len(used) and (strategy == "harmonic" or report.containers <= 1.05 * report.bound)


def test_empty(spark):
    empty = docs(spark, [])
    assert pack(empty).collect() == [] and fill_report(pack(empty)).first().containers == 0
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixture, shares = mix(empty, targets)
    assert mixture.collect() == [] and shares.first().slots == 0
    assert mix(docs(spark, [(1, "w", "a")]), targets.limit(0))[0].collect() == []


def test_permute_is_a_bijection():
    for n in (1, 2, 3, 100, 1025):
        assert sorted(permute(np.arange(n), n, 5)) == list(range(n))
    assert list(permute(np.arange(100), 100, 5)) != list(permute(np.arange(100), 100, 6))


def test_allocation_respects_caps_and_totals():
    got = allocate({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100, "b": 2, "c": 100}, {"a": 1, "b": 2, "c": 1}, 50)
    assert got["b"] == 4 and sum(got.values()) == 50 and abs(got["a"] / got["c"] - 2.5) < 0.2
    assert allocate({"a": 1.0}, {"a": 3}, {"a": 2}, 50) == {"a": 6}


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["big", "Big ", "small-one", "SMALL ONE", None, "other"][i % 6]) for i in range(600)]
    rows += [(9000, None, "big"), (None, "w w", "big"), rows[0]]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.5, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixture, _ = mix(docs(spark, rows), targets, block=16, shard=8)
    got = mixture.collect()
    size = Counter()
    for r in got:
        size[r.slot] += r.doc_to - r.doc_from
    assert set(size.values()) == {16}
    uses = Counter((r.source, r.block) for r in {(r.slot, r.source, r.block): r for r in got}.values())
    assert all(n <= {"big": 1, "small_one": 2}[s] for (s, _), n in uses.items())
    rep = {r.source: r for r in mixed_shares(docs(spark, rows), targets, block=16, shard=8).collect()}
    assert rep["big"].counted_tokens == rep["big"].mixed_tokens and rep["big"].most_uses <= 1 and rep["none"].slots == 0
    assert abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-5
    assert mixture.select("slot", "source", "block").distinct().collect() != [] and sorted(r.slot for r in mix(docs(spark, rows), targets, block=16, shard=8)[0].collect()) == sorted(r.slot for r in got)
