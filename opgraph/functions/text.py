"""Text, date and number functions, Column to Column, built from JVM expressions.

Only :func:`name_norm` leaves the JVM (NFKD has no built-in), in Arrow batches, and only for
values that hold a character outside ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values ---------------------------------------------------------------------------------
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"
PHONE = r"\+[0-9][0-9\s-]{6,}[0-9]"
CONTACT_LABEL = r"(?i)^\s*(contact|title|telephone no\.?|tel\.?|email|e-mail)\s*:?\s*$"
LEADER = r"\.{4,}|(?:\. ){3,}"
NUMBERING = r"(?i)^(?:[ivx]+\.|[a-h]\.|annex\b\s*(?:\d+(?:\.\d+)*)?\s*[.:]?)\s*"
TEMPLATE_MARK = r"@#&OPS~Doctype~OPS\^dynamics\s*@\s*\w+\s*#\s*doctemplate|\bRESULT[_ ]FRAME[_ ]TBL[_ ]\w+|\bBASIC[_ ]INFO[_ ]TABLE\b|\b(?:SUMMARY|DETAILS)\s*-\s*NewFin\w*|\b(?:PDO )?Table SPACE\b"
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_FORMATS = ("d-MMM-yyyy", "MMMM d, yyyy", "MMMM d yyyy", "yyyy-MM-dd", "M/d/yyyy h:mm:ss a")
COVER_AMOUNT = (
    r"(?i)PROPOSED\s+(LOAN|CREDIT|GRANT)S?\s+IN THE AMOUNT OF\s+(US\$|EUR|SDR|€|[A-Z]{3})\s*([\d.,]+)\s*(MILLION|BILLION)"
    r"(?:\s*\(\s*US\$\s*([\d.,]+)\s*(MILLION|BILLION)\s+EQUIVALENT\s*\))?(?:\s+EQUIVALENT)?"
    r"(?:\s+FROM\s+(?:THE\s+)?(.+?))?(?=\s+(?:AND\s+(?:A\s+)?PROPOSED|TO\s+|FOR\s+(?:THE|AN?)\b|ON\s+)|$)"
)
# ---------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def _fold_ascii(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def name_norm(c: Column) -> Column:
    """NFKD without combining marks, lower case, runs outside a-z0-9 as one space; null gives ''."""
    return _fold_ascii(_decomposed(F.coalesce(c, F.lit(""))))


def name_norm_latin(c: Column) -> Column:
    """The same for text without compatibility characters, wholly in the JVM (Latin letters with marks)."""
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    return _fold_ascii(F.translate(F.lower(F.coalesce(c, F.lit(""))), marked, plain))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm(c: Column) -> Column:
    return F.lower(collapse(c))


def clean(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def strip_numbering(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), NUMBERING, "")


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_numbering(c)), "[^a-z0-9]+", "")


def heading_slug(c: Column, fold=name_norm) -> Column:
    cut = F.regexp_replace(F.substring(F.replace(fold(strip_numbering(c)), F.lit(" "), F.lit("-")), 1, 60), "-+$", "")
    return F.when(cut == "", "untitled").otherwise(cut)


def boilerplate_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\d\s]+", " ")))


def is_toc_line(c: Column) -> Column:
    return c.contains("....") | c.contains(". . .")


def phase_number(c: Column) -> Column:
    """The number after "phase": digits, or a roman numeral up to X."""
    raw = F.upper(F.regexp_extract(c, r"(?i)\bphase\s+([ivx]+|[0-9]+)\b", 1))
    roman = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    return F.when(raw == "", None).otherwise(F.coalesce(raw.try_cast("int"), F.try_element_at(roman, raw)))


def is_acronym_token(c: Column) -> Column:
    """Two capitals or more in one token that is no hyphenated compound of capitalised words."""
    parts = F.split(c, "-")
    compound = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(r"^\p{Lu}\p{Ll}+$"))
    return c.rlike(r"(?U)^[^\W_][\w&/\-.']{0,19}$") & c.rlike(r"^[\p{Lu}\p{Nd}]") & (F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) >= 2) & ~compound


def split_acronym(line: Column) -> Column:
    """struct(acronym, expansion) of a line of an abbreviation list; one side may be null."""
    tokens = F.split(collapse(line), " ")
    flags = F.transform(tokens, is_acronym_token)
    stop = F.array_position(flags, F.lit(False))
    lead = F.when(stop == 0, F.size(tokens)).otherwise(stop - 1).cast("int")
    whole = F.array_join(tokens, " ")
    acronym = F.when(lead == 0, None).when(lead == F.size(tokens), F.when(lead <= 2, whole)).otherwise(F.array_join(F.slice(tokens, F.lit(1), lead), " "))
    expansion = F.when(lead == 0, whole).when(lead == F.size(tokens), F.when(lead > 2, whole)).otherwise(F.array_join(F.slice(tokens, lead + 1, F.size(tokens) - lead), " "))
    return F.struct(acronym.alias("acronym"), expansion.alias("expansion"))


def plausible_pair(acronym: Column, expansion: Column) -> Column:
    return (F.length(acronym) > 1) & (F.length(acronym) <= 25) & (F.length(expansion) >= 3) & ~expansion.rlike(LEADER) & (acronym != expansion)


def md_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def org_key(folded: Column, iso2: Column, is_global: Column) -> Column:
    return F.when(is_global | iso2.isNull() | (iso2 == ""), folded).otherwise(F.concat(folded, F.lit(" ["), F.lower(iso2), F.lit("]")))


def short_org(name: Column) -> Column:
    tail = F.regexp_extract(name, r"\(([A-Z][A-Za-z0-9&-]+)\)\s*$", 1)
    return F.when(tail != "", tail).otherwise(F.substring(name, 1, 30))


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != "")


def matches(text: Column, pattern: str) -> Column:
    """``re:`` patterns are case-sensitive regular expressions, others case-insensitive substrings."""
    return text.rlike(pattern[3:]) if pattern.startswith("re:") else F.lower(text).contains(pattern.lower())


def redact_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[email redacted]"), PHONE, "[phone redacted]")


def is_contact_row(cells: Column) -> Column:
    full = F.filter(cells, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.get(full, 0).rlike(CONTACT_LABEL), F.lit(False)) | F.exists(full, lambda x: x.rlike(EMAIL) | x.rlike(PHONE))


def redact_rows(rows: Column) -> Column:
    return F.filter(rows, lambda r: ~is_contact_row(r))


def clean_text(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(redact_text(F.regexp_replace(x, TEMPLATE_MARK, ""))))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(LEADER)), "\n")


def clean_cells(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda x: clean(F.regexp_replace(F.coalesce(x, F.lit("")), TEMPLATE_MARK, ""))))


def non_empty_cells(cells: Column) -> Column:
    return F.filter(cells, lambda x: x.isNotNull() & (F.trim(x) != ""))


def drop_empty(rows: Column) -> Column:
    """Rows padded to one width; all-empty rows and columns removed."""
    text = F.transform(rows, lambda r: F.transform(r, lambda x: F.coalesce(F.trim(x), F.lit(""))))
    full = F.filter(text, lambda r: F.exists(r, lambda x: x != ""))
    width = F.array_max(F.transform(full, F.size))
    at = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(full, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    return F.when(F.size(full) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(full, lambda r: F.transform(at, lambda i: F.coalesce(F.get(r, i), F.lit("")))))


def classify(title: Column, types: dict[str, list[str]]) -> Column:
    """The first subtype, in the order of ``types``, one of whose patterns matches the bare title; null if none."""
    bare = F.regexp_replace(norm(strip_numbering(title)), r"\s*-\s*", "-")
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for subtype, patterns in types.items():
        chain = chain.when(bare.rlike("|".join(f"(?:{p})" for p in patterns)), subtype)
    return chain.otherwise(None)


def iso_date(c: Column) -> Column:
    """A date in one of five written forms, or the part before a T; null if none fits."""
    text = F.initcap(F.lower(collapse(c)))
    plain = collapse(c)
    tries = [F.expr("null").cast("date")]
    for form in DATE_FORMATS:
        source = text if "MMM" in form else F.upper(plain)
        source = F.regexp_replace(source, r"^(\d{1,2})-(\w{3})-", r"$1-$2-") if form.startswith("d-") else source
        tries.append(F.try_to_date(source, form) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(source, F.lit(form))))
    tries.append(F.to_date(F.try_to_timestamp(F.regexp_extract(plain, r"^(\d{4}-\d{2}-\d{2})T", 1), F.lit("yyyy-MM-dd"))))
    return F.coalesce(*tries)


def derive_status(approval: Column, closing: Column, as_of: str) -> Column:
    day = F.lit(as_of).cast("date")
    return F.when(approval.isNull(), None).when(approval > day, "Pipeline").when(closing < day, "Closed").otherwise("Active")


def amount(c: Column) -> Column:
    """A written amount as a number; brackets or a leading minus make it negative; null for other text."""
    raw = F.trim(c)
    value = F.regexp_replace(raw, "[(),-]", "").try_cast("double")
    return F.when(raw.rlike(r"^\(?-?[0-9,]+(?:\.[0-9]+)?\)?$"), F.when(raw.startswith("(") | raw.startswith("-"), -value).otherwise(value))


def usd(millions: Column) -> Column:
    """US$ millions to whole dollars, halves to even."""
    return F.bround(millions * 1_000_000, 0).cast("long")


def present(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).isin("", "[]", "{}", "0", "0.0", "N/A", "false", "False")


def first_money(*columns: Column) -> Column:
    return F.coalesce(*[F.regexp_replace(c, ",", "").try_cast("double") for c in columns])


def cover_amounts(c: Column) -> Column:
    """array(struct(kind, currency, amount_millions, usd_millions, source)) of the amounts proposed on a cover."""
    text = clean(c)
    groups = [F.regexp_extract_all(text, F.lit(COVER_AMOUNT), F.lit(i)) for i in range(1, 8)]
    zipped = F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups, 1)])

    def number(value: Column, unit: Column) -> Column:
        return F.regexp_replace(value, ",", "").try_cast("double") * F.when(F.upper(unit) == "BILLION", 1000).otherwise(1)

    def one(z: Column) -> Column:
        raw = F.upper(z["g2"])
        currency = F.when(raw == "US$", "USD").when(raw == "€", "EUR").otherwise(raw)
        value = number(z["g3"], z["g4"])
        dollars = F.when(z["g5"] != "", number(z["g5"], z["g6"])).when(currency == "USD", value)
        source = F.when(z["g7"] != "", z["g7"])
        return F.struct(F.lower(z["g1"]).alias("kind"), currency.alias("currency"), value.alias("amount_millions"), dollars.alias("usd_millions"), source.alias("source"))

    return F.transform(zipped, one)


def cover_date(c: Column) -> Column:
    return iso_date(F.regexp_extract(c, rf"(?i)\b((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b", 1))


def clip(c: Column, most: int) -> Column:
    """At most ``most`` characters, with how many were cut."""
    more = F.length(c) - most
    return F.when(more > 0, F.concat(F.substring(c, 1, most), F.lit("… ["), more.cast("string"), F.lit(" more chars]"))).otherwise(c)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double; null if either has no length."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(square(a) * square(b))
    return F.when(size > 0, dot / size)
