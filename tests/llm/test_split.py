import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opgraph.llm.split import choose_cuts, split_oversized, split_text
from opgraph.llm.textunits import TOKEN_RE


def rejoin(text, pieces):
    out = ""
    for a, b, _, shared in pieces:
        part = text[a:b]
        starts = [m.start() for m in TOKEN_RE.finditer(part)]
        out += part if shared == 0 else part[starts[shared] :] if shared < len(starts) else ""
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 12.,\n;é漢-", max_size=400), st.integers(3, 40), st.integers(0, 2))
def test_round_trip_and_limit(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    if pieces and TOKEN_RE.search(text):
        assert rejoin(text, pieces) == text
        assert all(t <= limit and len(TOKEN_RE.findall(text[a:b])) == t for a, b, t, _ in pieces)
        assert all(s == overlap for *_, s in pieces[1:])


def test_least_cost_against_all_choices():
    from itertools import combinations

    from opgraph.llm.split import BALANCE

    rng = np.random.default_rng(0)
    for n in (9, 12, 14):
        penalty = rng.choice([0.0, 0.15, 0.6, 2.0], size=n)
        limit, overlap = 6, 1

        def cost(cuts):
            total, last = 0.0, 0
            for c in [*cuts, n]:
                start = last - overlap if last else 0
                if not 0 < c - start <= limit or (last and c <= last):
                    return np.inf
                total += BALANCE * (1 - (c - start) / limit) ** 2 + (penalty[c - 1] if c < n else 0)
                last = c
            return total

        best = min(cost(c) for k in range(1, n) for c in combinations(range(overlap + 1, n), k))
        ranges = choose_cuts(penalty, limit, overlap)
        assert cost([b for _, b in ranges[:-1]]) == pytest.approx(best)


def test_boundaries_and_unbroken_text():
    text = "\n\n".join("word " * 200 + "end." for _ in range(3))
    assert all(text[:b].rstrip().endswith("end.") for _, b, _, _ in split_text(text))
    assert len(split_text("a-" * 2000)) > 9


def test_rows(spark):
    at = datetime.datetime(2024, 1, 1)
    over, exact = "word " * 401, "word " * 400
    data = [("over", over, 3), ("over", over, 9), ("exact", exact, 900), ("null", None, 1), ("empty", "", 1), (None, over, 1), ("long", "one two. " * 20000, 1)]
    df = spark.createDataFrame([(i, t, n, at + datetime.timedelta(seconds=k), "x", 1) for k, (i, t, n) in enumerate(data)], "chunk_id string, text string, tokens int, loaded_at timestamp, id string, piece int")
    out = split_oversized(df, "chunk_id").collect()
    assert {r.record_id for r in out} == {"over", "long"}
    assert sorted(r.piece for r in out if r.record_id == "over") == [0, 1]
    assert all(r.tokens <= 400 for r in out)
    assert split_oversized(df.limit(0), "chunk_id").collect() == []
    with pytest.raises(ValueError):
        split_oversized(df, "chunk_id", overlap=400)


def test_only_the_newest_text_counts(spark):
    at = datetime.datetime(2024, 1, 1)
    long, short = "word " * 900, "word " * 20
    rows = [("a", long, at), ("a", short, at + datetime.timedelta(1)), ("b", short, at), ("b", long, at + datetime.timedelta(1)), ("c", long, None), ("d", long, None), ("d", None, at), (None, long, at)]
    df = spark.createDataFrame(rows, "id string, text string, loaded_at timestamp")
    assert sorted({r.record_id for r in split_oversized(df, "id").collect()}) == ["b", "c"]
