import datetime
import random
import re
import string

import pyarrow as pa
import pytest

from opgraph.llm import residue
from opgraph.llm.residue import find_residue, judge, residue_records

CASES = [
    "The loan with [Insert closing date here] was signed.", "Progress reached {{ indicator }} hectares.", "Contact: ${loan_number}, the unit.", "[TO BE CONFIRMED: province]", "US$ [●] million", "with ____________ (country) to",
    "with «name_of_borrower» was", "[% baseline_value %]", "@@ACCOUNT@@ was", "#project_title# was", "Click here to enter text.", "Choose an item.", "[À compléter par l'équipe]", "DRAFTING NOTE – fill in after negotiations", "Guidance: replace this paragraph with the diagnosis.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing.", "asdf qwer foo blah asdf qwer foo", "This is dummy text.", "Texte provisoire.", "Please enable JavaScript in your browser to view this document.", "Votre navigateur bloque JavaScript; activez-le pour lire le texte.",
    "502 Bad Gateway", "HTTP 403 – Forbidden", "Page introuvable.", "Your session has expired.", "The annex viewer timed out.", "No se pudo cargar la página solicitada (código 12).", "The content host could not be reached.",
]
PROSE = [
    "Scripts for the radio campaign are required in 3 languages before broadcasting is enabled.", "Questions can be sent to [email redacted] or [phone redacted] during office hours.", "The earlier study [12] and the tracer survey [7] reach the same view.",
    "The amount was changed from US$3.1 million [sic] to US$3.4 million [emphasis added].", "The server room will be moved, because service was unavailable on 4 days in 2030.", "A placeholder budget line of US$3.0 million was confirmed in 2021.", "The tariff is [(a + b) / 2] per unit, where a is the lifeline block.",
    "Applicants had to enable JavaScript to use the online form, which excluded older phones in the hill districts.", "The complaints portal returned an error page in 92 percent of sessions, so the tax office replaced the server.", "The budget code is stored as {region}-{year}-{lot}, for example {1}-{2}-{3}.",
    "If the indicator is x < 80 and y > 5, the health directorate opens a new site page.", "The implementing agency will insert pressure valves in 12 schemes and name each operator in the contract.", "",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert judge(text)[0]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert judge(text)[0] is None


def rows(spark, items, schema="chunk_id string, text string, title string, loaded_at timestamp, host string, reason string"):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t, "Title", at + datetime.timedelta(seconds=s), "x", "y") for i, t, s in items], schema)


def test_anywhere_latest_and_odd_rows(spark):
    long = " ".join(f"Plain prose about the water of district {i} and its people." for i in range(4000)) + " "
    df = rows(spark, [("h:a#0:c0", long + "Choose an item.", 0), ("h:a#0:c1", long, 0), ("h:b", None, 0), ("h:c", "", 0), (None, "Choose an item.", 0), ("h:d", "Click here to enter text.", 0), ("h:d", "Plain prose.", 9), ("h:e", "Choose an item.", 0), ("h:e", "Choose an item.", 5)])
    found = {r.record_id for r in find_residue(df, "chunk_id").collect()}
    assert found == {"h:a#0:c0", "h:e"}


def test_host_evidence_needs_several_documents(spark):
    text = "Download session request, page 12."
    many = rows(spark, [(f"h{i}:slug#0:c0", text, 0) for i in range(4)])
    few = rows(spark, [(f"h1:slug#{i}:c0", text, 0) for i in range(4)])
    named = rows(spark, [(f"h{i}:download-session#0:c0", text, 0) for i in range(4)])
    assert find_residue(many, "chunk_id").count() == 4
    assert find_residue(few, "chunk_id").count() == 0
    assert find_residue(named, "chunk_id").count() == 0


def test_host_evidence_follows_footers_to_messages_of_any_wording(spark):
    footer, prose = "Go up | Imprint", "The council met in June and agreed on the plan for the canals."
    known = [(f"h{i}:slug#0:c0", f"502 Bad Gateway\n{footer}", 0) for i in range(4)]
    unknown = [(f"k{i}:slug#0:c0", f"Bah, no luck today.\n{footer}", 0) for i in range(3)]
    alone = [(f"m{i}:slug#0:c0", "Bah, no luck today.", 0) for i in range(3)]
    clean = [(f"p{i}:slug#0:c0", prose, 0) for i in range(9)] + [("q:slug#0:c0", f"{prose}\nChoose an item.", 0)]
    got = {r.record_id: r.reasons for r in find_residue(rows(spark, known + unknown + alone + clean), "chunk_id").collect()}
    assert {i[0] for i in got} == {"h", "k", "m", "q"} and len(got) == 11
    assert got["k0:slug#0:c0"] == ["repeated on several hosts"] == got["m2:slug#0:c0"]


def test_segment_hosts_count_documents(spark):
    df = rows(spark, [("a:s#0", "Water 12 rises.\nWater 13 rises.", 0), ("a:s#1", "Water 1 rises.", 0), ("b:s#0", "Water 9 rises.", 0), ("c:rises#0", "Water 9 rises.", 0)])
    seen = residue.scan([residue.table_rows(df, "chunk_id", version_col=None)])
    assert [(r.hosts, r.apart) for r in residue.segment_hosts(seen).collect()] == [(3, 2)]


@pytest.mark.parametrize("n", [40, 400])
def test_low_information_at_any_length(n):
    assert judge(" ".join(["water pumps and", "pumps of water"][i % 2] for i in range(n)))[0] == "filler"
    assert judge(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)))[0] is None


def test_empty(spark):
    c = rows(spark, [])
    s = c.withColumnRenamed("chunk_id", "section_id")
    assert residue_records(c, s).collect() == []


MISSED = [
    "405 Method Not Allowed", "501 Not Implemented", "400 Bad Request", "Note to editor: shorten the second part.", "Task team will complete before appraisal.", "Section to be filled in by the author.",
    "La base n'est plus accessible.", "Connection closed.", "The quick brown fox jumps over the lazy dog.", "Página no encontrada", "water pumps water pumps water pumps water pumps water pumps water pumps",
]


def scanned(text):
    batch = pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in ("h:a#0", "", None, text)], ["id", "ver", "title", "text"])
    return [row for out in residue._scan(iter([batch])) for row in out.to_pylist()][0]


@pytest.mark.parametrize("text", CASES + MISSED)
def test_scan_passes_over_no_segment_that_judge_flags(text):
    prose = "The council of the hill district met in June and agreed on the plan for the canals."
    assert judge(text)[0] and judge(text)[0] in scanned(f"{prose}\n{text}\n{prose}")["reasons"]


def test_scan_keeps_weak_segments():
    assert judge("Please try again in a moment, the page is loading.") == (None, True)
    assert scanned("Please try again in a moment, the page is loading.")["bits"] == [residue.WEAK | residue.FREE]


def draw(items, rng):
    """A string that a parsed pattern may match."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "BRANCH":
            out += draw(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += draw(arg[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(draw(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
        elif name == "IN":
            members = [c for c in string.ascii_letters + string.digits + " _.:●…•-[]()" if re.fullmatch(rebuilt(arg), c)]
            out += rng.choice(members) if members else chr(next(a for o, a in arg if str(o) == "LITERAL"))
        elif name in ("ANY", "NOT_LITERAL"):
            out += "q"
    return out


def rebuilt(members):
    kinds = {"CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_DIGIT": r"\d"}
    part = {"NEGATE": lambda a: "^", "LITERAL": lambda a: re.escape(chr(a)), "RANGE": lambda a: f"{re.escape(chr(a[0]))}-{re.escape(chr(a[1]))}", "CATEGORY": lambda a: kinds[str(a)]}
    return "[" + "".join(part[str(o)](a) for o, a in members) + "]"


@pytest.mark.parametrize("bit, name", [(0, "PLACEHOLDER"), (1, "INSTRUCTION"), (2, "FILLER"), (4, "FAULT"), (8, "SCRIPT")])
def test_literals_stand_in_every_match(bit, name):
    pattern, rng, met = getattr(residue, name), random.Random(5), 0
    tree = residue._parser.parse(pattern, re.IGNORECASE if bit else 0)
    for _ in range(4000):
        text = draw(tree, rng)
        text = rng.choice((text, text.upper(), text.replace("i", "ı"), text.replace("s", "ſ"), text.replace("i", "İ"))) if bit else text
        if re.search(pattern, text, re.IGNORECASE if bit else 0):
            met += 1
            assert residue.kinds_of(text) & bit if bit else residue._PUNCTUATION.search(text), text
    assert met > 500
