import numpy as np
import pytest

from opgraph.llm import neighbours as N

SCHEMA = "chunk_id string, embedding array<float>, loaded_at timestamp, id int, vec string"


def frame(spark, rows):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, v, at, 1, "x") for i, v in rows], SCHEMA)


def brute(vectors, k, floor):
    ids = sorted(vectors)
    x = np.array([np.array(vectors[i], dtype=np.float32).astype(float) for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    out = {}
    for a, i in enumerate(ids):
        best = np.argsort(-s[a], kind="stable")[:k]
        out[i] = [(ids[b], s[a, b]) for b in best if s[a, b] >= floor]
    return out


def clustered(n, seed=0, dim=64, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6 + 1, dim))
    return {f"c{i:04d}": (centres[i // 6] + spread * rng.normal(size=dim) * np.sqrt(dim) / 8).tolist() for i in range(n)}


def test_equals_brute_force(spark):
    vectors = clustered(300)
    found = N.most_similar(frame(spark, vectors.items())).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append(r.neighbour)
    expected = {i: [b for b, _ in v] for i, v in brute(vectors, 5, 0.9).items() if v}
    pairs = {(a, b) for a, v in expected.items() for b in v}
    hit = {(a, b) for a, v in got.items() for b in v}
    assert len(pairs & hit) >= 0.99 * len(pairs) and not hit - pairs


def test_copies_ties_unusable_and_redelivered_rows(spark):
    one = [1.0] + [0.0] * 63
    rows = [(f"a{i}", one) for i in range(9)] + [("a0", one)]  # nine copies, one delivered twice
    rows += [("n", None), ("short", [1.0] * 63), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), (None, one), ("hole", [None] + [1.0] * 63), ("inf", [float("inf")] * 64)]
    found = N.most_similar(frame(spark, rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, []).append((r["rank"], r.neighbour, r.similarity))
    assert set(by) == {f"a{i}" for i in range(9)}
    assert [n for _, n, _ in sorted(by["a0"])] == ["a1", "a2", "a3", "a4", "a5"]
    assert [n for _, n, _ in sorted(by["a8"])] == ["a0", "a1", "a2", "a3", "a4"]
    assert all(s == 1.0 for v in by.values() for _, _, s in v)


def test_hot_buckets_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    vectors = {f"h{i:03d}": (base + 0.05 * rng.normal(size=64)).tolist() for i in range(120)}
    found = N.most_similar(frame(spark, vectors.items()), hot=8, block=32).collect()
    got = {(r.id, r.neighbour) for r in found}
    expected = {(a, b) for a, v in brute(vectors, 5, 0.9).items() for b, _ in v}
    assert len(got & expected) >= 0.95 * len(expected)


def test_empty_table(spark):
    assert N.most_similar(frame(spark, [])).collect() == []
    assert N.similar_pairs(frame(spark, [])).columns == ["chunk_id_a", "chunk_id_b"]


def test_stated_queries_against_all_rows(spark):
    vectors = {i: v for i, v in enumerate(clustered(60, 5).values())}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()] + [(99, None, "x"), (None, [1.0] * 64, "x")], "vec_id long, embedding array<float>, s string")
    got = {}
    for r in N.exact_neighbours(df.where("vec_id % 10 = 0"), df, "vec_id", "embedding", k=3, block=16).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    truth = brute(vectors, 3, -2)
    assert {i: [b for _, b in sorted(v)] for i, v in got.items()} == {i: [b for b, _ in truth[i]] for i in range(0, 60, 10)}


def test_substrings_cover_the_code_once_and_radius_grows():
    bits = N.substring_bits(12, 24)
    assert bits.shape == (24, 12) and len(set(bits[:10].ravel())) == 120
    assert N.hamming_radius(0.95, 0.8) < N.hamming_radius(0.9, 0.8) < N.hamming_radius(0.9, 0.55) <= N.BITS
    assert N.tables_for(0.9, 0.8, 8, 0.95) < N.tables_for(0.9, 0.8, 14, 0.95)
    assert N.learn_rotations(np.ones((1, 64)))[1].shape == (64, N.BITS)


@pytest.mark.parametrize("dim", [64])
def test_rotations_are_orthogonal(dim):
    _, p = N.learn_rotations(np.random.default_rng(0).normal(size=(200, dim)))
    assert np.allclose(p[:, :dim].T @ p[:, :dim], np.eye(dim), atol=1e-8)


def test_a_vector_asks_in_every_hot_bucket(spark):
    # 1 and 2 are near copies that share only the last of their eight hot buckets
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=64).tolist() for i in range(3, 60)}
    vectors[1] = rng.normal(size=64).tolist()
    vectors[2] = (np.array(vectors[1]) + 0.01).tolist()
    buckets = [[1 + key % 2, *range(3 + 3 * key, 6 + 3 * key)] for key in range(16)] + [[1, 2, 58, 59]]
    members = [(vid, key, len(b)) for key, b in enumerate(buckets) for vid in b]
    index = spark.createDataFrame(members, "vid long, key long, n long")
    reps = spark.createDataFrame(list(vectors.items()), "vid long, vec array<float>")
    for part in (index, index.where("key in (0, 16)")):  # searched bucket by bucket, or all members at once
        assert [tuple(r) for r in N._hot_pairs(part, reps, 5, 0.9, hot=3, block=2).distinct().collect()] == [(1, 2)]


def test_every_vector_gets_neighbours_without_a_floor(spark):
    rng = np.random.default_rng(4)
    vectors = {**clustered(90), **{f"r{i:03d}": rng.normal(size=64).tolist() for i in range(200)}}
    got = {}
    for r in sorted(N.most_similar(frame(spark, vectors.items()), floor=None).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append(r.neighbour)
    truth = brute(vectors, 5, -2)
    hit = sum(len(set(got[i]) & {b for b, _ in truth[i]}) for i in vectors)
    assert set(got) == set(vectors) and all(len(v) == 5 for v in got.values()) and hit >= 0.99 * 5 * len(vectors)
    few = frame(spark, list(vectors.items())[:3])
    assert len(N.most_similar(few, floor=None).collect()) == 6
