import datetime

import pytest
from pyspark.sql import functions as F

from opgraph.functions import text as T
from opgraph.functions.vocab import SECTION_GROUPS, SECTION_TYPES


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("r")).first().r


def one(spark, fn, v):
    return spark.createDataFrame([(v,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("given", "want"), [("Türkiye – Élan", "turkiye elan"), ("ﬁscal ½ A²", "fiscal 1 2 a2"), ("Ａｂｃ", "abc"), ("ĲR", "ijr"), (None, ""), ("", "")])
def test_name_norm(spark, given, want):
    assert one(spark, T.name_norm, given) == want


@pytest.mark.parametrize(("given", "want"), [("II. Project Description", "project-description"), ("A. Country Context", "country-context"), ("ANNEX 3.1. Results", "results"), ("...", "untitled"), ("x" * 70, "x" * 60)])
def test_heading_slug(spark, given, want):
    assert one(spark, T.heading_slug, given) == want


@pytest.mark.parametrize(("given", "want"), [("AfDB", True), ("PforR", True), ("COVID-19", True), ("ÖBA", True), ("Gender-Based", False), ("Turkiye", False), ("a1B2", False), ("CALM2", True)])
def test_acronym_token(spark, given, want):
    assert one(spark, T.is_acronym_token, given) is want


@pytest.mark.parametrize(("given", "want"), [("IDA International Development Association", ("IDA", "International Development Association")), ("AfDB", ("AfDB", None)), ("African Development Bank", (None, "African Development Bank")), ("AFE WASH", ("AFE WASH", None)), ("AFE WASH IDA", (None, "AFE WASH IDA"))])
def test_split_acronym(spark, given, want):
    assert tuple(one(spark, T.split_acronym, given)) == want


@pytest.mark.parametrize(("given", "want"), [("1-Feb-2026", "2026-02-01"), ("March 5, 2024", "2024-03-05"), ("MARCH 5 2024", "2024-03-05"), ("2024-07-09", "2024-07-09"), ("3/4/2024 11:05:00 PM", "2024-03-04"), ("2023-01-02T10:00:00Z", "2023-01-02"), ("soon", None), (None, None)])
def test_iso_date(spark, given, want):
    assert one(spark, T.iso_date, given) == (datetime.date.fromisoformat(want) if want else None)


@pytest.mark.parametrize(("given", "want"), [("1,234.50", 1234.5), ("(12.0)", -12.0), ("-3", -3.0), ("about 3", None), ("", None), (None, None)])
def test_amount(spark, given, want):
    assert one(spark, T.amount, given) == want


def test_usd_rounds_half_to_even(spark):
    assert value(spark, T.usd(F.col("x")), x=0.0000025) == 2
    assert value(spark, T.usd(F.col("x")), x=1.25) == 1250000


def test_redaction(spark):
    assert one(spark, T.redact_text, "a.b@c.org or +1 234 567 890 x") == "[email redacted] or [phone redacted] x"
    rows = [["Contact:", "Ann"], ["", "x@y.org"], ["Total", "1"], [None, "Tel", "+44 20 7946 0000"]]
    got = spark.createDataFrame([(rows,)], "r array<array<string>>").select(T.redact_rows(F.col("r")).alias("r")).first().r
    assert got == [["Total", "1"]]


def test_clean_text_and_cells(spark):
    assert one(spark, T.clean_text, "  a \n\nIntro ........ 3\nBASIC_INFO_TABLE\nb@c.de") == "a\n[email redacted]"
    got = spark.createDataFrame([([["", "a", ""], ["", "", ""], ["", "b|c"]],)], "r array<array<string>>").select(T.drop_empty(F.col("r")).alias("d")).select("d", T.md_row(F.get("d", 1)).alias("m")).first()
    assert got.d == [["a"], ["b|c"]] and got.m == "| b\\|c |"


def test_classify_and_phase(spark):
    kinds = {t: one(spark, lambda c: T.classify(c, SECTION_TYPES), t) for t in ("II. Project Description", "B. Results Framework", "ANNEX 2: Implementation Support Plan", "Nothing", "E. Key Risks")}
    assert list(kinds.values()) == ["description", "results_framework", "implementation_support", None, "key_risks"]
    assert sorted(x for g in SECTION_GROUPS.values() for x in g) == sorted(SECTION_TYPES)
    assert [one(spark, T.phase_number, t) for t in ("MPA Phase IV", "phase 2 of", "Phased")] == [4, 2, None]


def test_cover(spark):
    text = "Report No: PAD123 ON A PROPOSED LOAN IN THE AMOUNT OF EUR 350 MILLION (US$ 411.0 MILLION EQUIVALENT) AND A PROPOSED GRANT IN THE AMOUNT OF US$1.5 BILLION FROM THE GREEN FUND TO THE REPUBLIC March 3, 2024"
    got = one(spark, T.cover_amounts, text)
    assert [(a.kind, a.currency, a.amount_millions, a.usd_millions, a.source) for a in got] == [("loan", "EUR", 350.0, 411.0, None), ("grant", "USD", 1500.0, 1500.0, "GREEN FUND")]
    assert one(spark, T.cover_date, text) == datetime.date(2024, 3, 3)


def test_present_status_and_cosine(spark):
    assert [one(spark, T.present, v) for v in (None, "", "0", "False", "x")] == [False, False, False, False, True]
    df = spark.createDataFrame([(datetime.date(2025, 1, 1), None), (datetime.date(2020, 1, 1), datetime.date(2021, 1, 1)), (datetime.date(2020, 1, 1), None), (None, None)], "a date, b date")
    assert [r.s for r in df.select(T.derive_status(F.col("a"), F.col("b"), "2024-01-01").alias("s")).collect()] == ["Pipeline", "Closed", "Active", None]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.c and round(r.c, 6) for r in v.select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, None]
