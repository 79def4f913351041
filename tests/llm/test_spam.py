import math
from collections import Counter

import numpy as np
import pytest

from opgraph.llm.spam import CLASSES, CODE, STOP, UNIFORM, VOCABULARY, WORDS, Model, classes, predictability, score_pages, segments, spam_pages, trigrams

PROSE = [
    "The water board will inspect the pumps in the hill districts before the rains begin.", "A review of the fund in 2021 found that the costs of the scheme were met by the ministry.", "Households in the coastal strip depend on the market, and the council plans to map them.",
    "The grievance desk received 31 cases in 2019, mostly about the delay in the release of the budget.", "Under the second component, the agency has agreed to restore the canals at its own cost.",
]
SPAM = [
    "cheap loan, cheap loan, cheap loan, cheap loan, cheap loan, cheap loan, cheap loan, cheap loan, cheap loan", "#cheaploan #solarpump #watertank #lowrate #dripkit #farmcredit #cheaploan #solarpump #generator #lowrate", "Home | News | Jobs | cheap loan | Sitemap | Login | solar pump | Contact | Vendors | Tenders | cheap loan | Home",
    "[solar pump](/cheap-loan/1.html)\n[drip kit](/low-rate/2.html)\n[water tank](/cheap-loan/3.html)\n[low rate](/solar-pump/4.html)\n[drip kit](/low-rate/5.html)\n[solar pump](/low-rate/6.html)",
    "Looking for seed supplier? Our seed supplier is the seed supplier that seed supplier buyers call the best seed supplier. Looking for seed supplier? Our seed supplier is the seed supplier that seed supplier buyers call the top seed supplier.",
]
PLAIN = [
    "EWM: Early Warning Mast\nGD7: Grievance Desk\nLTO3: Land Tenure Office\nRRF - Rural Roads Fund\nSSS Seed Storage Scheme\nTCN Training Centre Network", "| Lot | Item | Cost |\n| --- | --- | --- |\n| Pumps | 12 | 3.4 |\n| Canals | 7 | 9.1 |\n| Roads | 8 | 1.1 |",
    "1. The water board will inspect the pumps in the hill districts.\n2. The council plans to map the market in the coastal strip.\n3. The agency has agreed to restore the canals at its own cost.",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, id string, flagged int")


def corpus():
    out = [(i, " ".join(PROSE[(i + k) % 5] for k in range(3))) for i in range(60)]
    out += [(100 + i, t) for i, t in enumerate(SPAM)] + [(200 + i, t) for i, t in enumerate(PLAIN)]
    return out + [(300, None), (301, ""), (302, "   \n "), (None, SPAM[0]), (100, SPAM[0]), (303, PROSE[0] + "\n" + SPAM[1] * 200)]


def test_spam_and_plain(spark):
    got = sorted(r.doc_id for r in spam_pages(frame(spark, corpus())).collect())
    assert got == [100, 101, 102, 103, 104, 303]


def test_empty_and_without_prose(spark):
    assert spam_pages(frame(spark, [])).collect() == []
    assert [r.is_spam for r in score_pages(frame(spark, [(1, SPAM[0])])).collect()] == [True]


def test_segments_and_classes():
    assert {k for k, _ in segments(PLAIN[0])} == {"aside"} and {k for k, _ in segments(PLAIN[1])} == {"aside"}
    codes, content, function = classes("The pump #tag https://x.example 12.5 is new.")
    tokens = [CLASSES[c] for c in codes]
    assert tokens[0] == "the" and "<url>" in tokens and "<tag>" in tokens and "<n>" in tokens and tokens[-1] == "." and function == 2 and "pump" in content


def test_model_equals_a_plain_sum():
    rng = np.random.default_rng(1)
    taught = [[0, 0, *rng.integers(1, 9, 6).tolist(), CODE[STOP]] for _ in range(40)]
    grams, _ = trigrams(np.array(sum(taught, []), dtype=np.int16))
    model = Model(*np.unique(grams, return_counts=True))
    tri, bi, uni = Counter(), Counter(), Counter()
    for s in taught:
        for a, b, c in zip(s, s[1:], s[2:]):
            tri[a, b, c] += 1
            bi[b, c] += 1
            uni[c] += 1
    ctx, after = Counter(), Counter()
    for (a, b, _), n in tri.items():
        ctx[a, b] += n
        after[b] += n

    def plain(s):
        cost = 0.0
        for a, b, c in zip(s, s[1:], s[2:]):
            p = 0.05 / (len(uni) + 1) + 0.1 * uni[c] / sum(uni.values()) + (0.35 * bi[b, c] / after[b] if after[b] else 0) + (0.5 * tri[a, b, c] / ctx[a, b] if ctx[a, b] else 0)
            cost -= math.log(p)
        return cost / (len(s) - 2)

    asked = [*taught[:3], [0, 0, 20, CODE[STOP]], [0, 0, 3, 8, 1, 30, CODE[STOP]]]
    got = model.surprise(np.array(sum(asked, []), dtype=np.int16), np.array([len(s) for s in asked]))
    assert np.allclose(got, [plain(s) for s in asked])


def test_predictability_leaves_each_word_out():
    once, twice = predictability([["a", "b", "c"], ["d", "e"], ["f", "g", "h"]]), predictability([["a", "b", "c"]] * 5 + [[]])
    assert once[0] == pytest.approx(math.log(VOCABULARY / UNIFORM)) and math.isnan(once[1])
    assert twice[0] == pytest.approx(twice[1]) and twice[0] == pytest.approx(-math.log(WORDS * 3 / 14 + UNIFORM / VOCABULARY)) and math.isnan(twice[5]) and predictability([]) == []


def test_phrases_repeated_across_segments(spark):
    once, several = "Cheap tractor loans in Quorania for farmers.", [f"Cheap tractor loans in Quorania for {x} farmers." for x in ("young", "hill", "dairy", "rice", "coastal", "new")]
    texts = [(i, t) for i, t in corpus() if i is not None and i < 100] + [(400, "\n".join([once] * 50)), (401, "\n".join(several * 4)), (402, once + " " + " ".join(PROSE))]
    assert sorted(r.doc_id for r in spam_pages(frame(spark, texts)).collect()) == [400, 401]


def test_bare_links_and_menus_are_not_set_aside():
    assert [k for k, _ in segments("[1] https://a.example/x\n\n| Home | News | Jobs |\n\nText.")] == ["text"]
    assert {k for k, _ in segments("[1] Water board, report, https://a.example/x\n| Lot | Cost |\n| Pumps | 12 |")} == {"aside"}
