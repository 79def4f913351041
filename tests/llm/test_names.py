from opgraph.llm.names import kind_word, link_names, parse, variant_pairs

PLACES = ["Haruvo", "Mesina Tola", "Kovadi", "Berusa", "Lofati Ruma", "Zemuko"]


def tables(spark, orgs, aliases=()):
    o = spark.createDataFrame([(n, t, c, cat, "x") for n, t, c, cat in orgs], "name_norm string, name string, country_iso2 string, is_category boolean, entity string")
    a = spark.createDataFrame(list(aliases), "canonical string, variant string")
    return o, a


def base():
    kinds = ["Land Registration Office", "Rural Electrification Agency", "Municipal Council"]
    return [(f"{p} {k} [qa]".lower(), f"{p} {k}", "QA", False) for p in PLACES for k in kinds]


def entities(spark, extra, aliases=()):
    got = {r.name_norm: r.entity for r in link_names(*tables(spark, base() + extra, aliases)).collect()}
    return got


def test_variants_of_one_office(spark):
    names = ["Haruvo Land Reg Office", "Land Registration Office, Haruvo", "Haruvo Land Registratoin Office", "Haruvu Land Registration Office", "LRO Haruvo", "Bureau d'Enregistrement Foncier de Haruvo", "HARUVO LANDREGISTRATION OFFICE", "Haruvo Land Registration Office (HLRO)", "M/s Haruvo Land Registration Office S.A."]
    got = entities(spark, [(f"v{i} [qa]", n, "QA", False) for i, n in enumerate(names)] + [("v9", "Haruvo Land Registration Office", None, False)])
    home = got["haruvo land registration office [qa]"]
    assert [n for i, n in enumerate(names) if got[f"v{i} [qa]"] != home] == [] and got["v9"] == home


def test_others_stay_apart(spark):
    got = entities(spark, [("a", "Haruvo Land Registration Office", "QB", False), ("b", "Mesina Land Registration Office", "QA", False), ("b2", "Mesina Rava Land Registration Office", "QA", False), ("c", "Other Sources", None, True), (None, "x", None, False), ("d", None, None, None), ("e", "", None, False)])
    home = got["haruvo land registration office [qa]"]
    assert got["a"] != home and got["b"] != got["mesina tola land registration office [qa]"]
    assert got["haruvo municipal council [qa]"] != home and "c" not in got and got["d"] != got["e"]


def test_bodies_by_alias_order_and_acronym(spark):
    alias = [("Northern Lights Education Alliance (NLEA)", "NLEA"), ("Northern Lights Education Alliance (NLEA)", "Lumen Pact")]
    names = ["Northern Lights Education Alliance (NLEA)", "NLEA", "Alliance of Northern Lights for Education", "Northern Lights Alliance", "Lumen Pact", "Northern Lights Educaton Alliance"]
    got = entities(spark, [(f"f{i}", n, None, False) for i, n in enumerate(names)], alias)
    assert len({got[f"f{i}"] for i in range(len(names))}) == 1


def test_pairs_and_empty(spark):
    o, a = tables(spark, [("b", "Haruvo Fund", None, False), ("a", "Haruvo  Fund", None, False), ("a", "Haruvo  Fund", None, False)])
    assert [(r.name_norm_a, r.name_norm_b) for r in variant_pairs(o, a).collect()] == [("a", "b")]
    assert variant_pairs(o.limit(0), a).collect() == []


def test_words():
    assert kind_word("registratian") == [("registration",)] and kind_word("deve10pment") == [("development",)] and kind_word("haruvo") == []
    assert parse("Kovadi University (KU)", "x")["proper"] == ["kovadi"]


def test_shortened_places_join_the_only_longer_one(spark):
    extra = [("s1", "Lofati Municipal Council", "QA", False), ("s2", "Lofati Municipal Council", "QB", False), ("s3", "Lofati Rural Electrification Agency", None, False), ("s4", "Lofa Land Registration Office", "QA", False), ("s5", "Lofati Mun Cncl", "QA", False)]
    got = entities(spark, extra)
    home = lambda kind: got[f"lofati ruma {kind} [qa]"]
    assert got["s1"] == got["s5"] == home("municipal council") and got["s2"] != got["s1"] and got["s3"] == home("rural electrification agency") and got["s4"] != home("land registration office")


def test_rarity_and_written_out_forms_decide_between_readings(spark):
    from opgraph.llm.names import rarity

    scores = rarity(["committee", "commission"], {"committee": 9, "commission": 1})
    assert scores["committee"] < scores["commission"]
    rows = [(f"{p} development committee [qa]".lower(), f"{p} Development Committee", "QA", False) for p in PLACES[:5]] + [(f"{p} development commission [qb]".lower(), f"{p} Development Commission", "QB", False) for p in PLACES[:3]]
    rows += [("x", "Haruvo Dev Comm", "QB", False), ("y", "Kovadi Dev Comm", "QA", False), ("z", "Tola Mesina Development Committee", "QA", False)]
    got = {r.name_norm: r.entity for r in link_names(*tables(spark, rows)).collect()}
    assert got["x"] == got["haruvo development commission [qb]"] and got["y"] == got["kovadi development committee [qa]"] and got["z"] == got["mesina tola development committee [qa]"]


def test_chains_of_shortened_bodies_are_followed_to_the_end(spark):
    full = "Silverleaf Orchard Seed Storage Partnership (SOSSP)"
    names = [full, "Silverleaf Orchard Seed Storage Partnership", "Silverleaf Orchard Seed Partnership", "Silverleaf Seed Partnership", "SOSSP"]
    got = entities(spark, [(f"c{i}", n, None, False) for i, n in enumerate(names)])
    assert len({got[f"c{i}"] for i in range(len(names))}) == 1
