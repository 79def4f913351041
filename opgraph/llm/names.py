"""Problem 5 - variant spellings of organization names, by canonical rewriting.

Each name is rewritten to every canonical form (kind of body, proper part) that it can stand for: case and accents folded,
noise words and legal forms dropped, abbreviations, acronyms and translated words expanded, joined and misspelt kind
words repaired, known nicknames (the alias table) replaced, word order ignored. The forms are exploded and equi-joined with the forms that
other names write out. Of a name's forms the one is kept that is written out for the same place and country; among
those, and without any, the least rare rewriting: the rarity of a reading is how seldom its kind is written out among the
kinds that the same words may mean. Misspelt proper parts meet by equi-joining their single-character
deletions, reordered ones by their sorted words, and shortened ones meet the beginnings of longer ones where only one fits. Forms point to the most frequent form they can be rewritten to, and pointers
are followed to the root. No step compares all rows of a block.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opgraph.plans.materialize import materialize

# ---- fixed values: words of names of public bodies --------------------------------------------------
STOP = frozenset("of the and for to in on at de d des du la le l les et el los las do da dos das e y a an".split())
ARTICLES = frozenset("de d des du la le les l del do da dos das".split())
NOISE = frozenset("govt government hq piu ltd limited inc plc sa llc gmbh headquarters province region".split())
LEGAL_TAILS = (("s", "a"), ("p", "l", "c"), ("m", "s"))
KIND_WORDS = (
    "academy administration agency agricultural alliance association authority bank board bureau centre chamber college commission committee company cooperative "
    "corporation council credit department development directorate disaster district education electrification energy environment facility federation finance fisheries forests foundation fund health "
    "highways hospital housing initiative institute irrigation irrigants labour land livestock management marketing ministry municipal national network office organisation partnership planning police port ports postal power programme protection "
    "provincial public railway reform registration regional research revenue roads rural sanitation school secretariat sewerage service social society standards state statistics supply support survey tourism trade training transport treasury trust union "
    "university urban users utility vocational water window works youth"
).split()
#: Abbreviation, other spelling or translation -> kind words it may stand for.
REWRITE = {
    "prov": "provincial", "dept": "department", "dep": "department", "hlth": "health", "agric": "agricultural", "agri": "agricultural", "ag": "agency|agricultural", "agcy": "agency", "res": "research", "ctr": "centre", "center": "centre", "cen": "centre",
    "mgmt": "management", "mgt": "management", "mgmnt": "management", "cttee": "committee", "ctte": "committee", "cmte": "committee", "comm": "committee|commission", "univ": "university", "u": "university", "uni": "university", "elec": "electrification", "electrif": "electrification", "rur": "rural", "rds": "roads", "rd": "roads", "road": "roads", "forest": "forests",
    "dev": "development", "devt": "development", "devpt": "development", "devel": "development", "auth": "authority", "authy": "authority", "mun": "municipal", "munic": "municipal", "cncl": "council", "coun": "council", "voc": "vocational", "trg": "training", "trng": "training", "tr": "training", "prog": "programme", "progr": "programme", "program": "programme",
    "irrig": "irrigation", "irr": "irrigation", "org": "organisation", "organization": "organisation", "orgn": "organisation", "soc": "social|society", "prot": "protection", "fd": "fund", "reg": "registration|regional", "regn": "registration", "off": "office|authority", "ofc": "office", "wtr": "water", "wat": "water", "sew": "sewerage", "bd": "board", "brd": "board", "coop": "cooperative",
    "cr": "credit", "cred": "credit", "min": "ministry", "minist": "ministry", "min.": "ministry", "fin": "finance", "st": "state", "dir": "directorate", "co": "company", "corp": "corporation", "inst": "institute", "assoc": "association", "assn": "association", "natl": "national", "nat": "national", "dist": "district", "comp": "company", "mgr": "management", "labor": "labour",
    "agence": "agency", "rurale": "rural", "bureau": "office|bureau", "enregistrement": "registration", "foncier": "land", "fonciere": "land", "centre": "centre", "recherche": "research", "recherches": "research", "agricole": "agricultural", "conseil": "council|board", "municipale": "municipal", "eau": "water", "eaux": "water", "assainissement": "sewerage|sanitation",
    "comite": "committee", "gestion": "management", "catastrophes": "disaster", "direction": "department|directorate", "provinciale": "provincial", "provincial": "provincial", "sante": "health", "etat": "state", "forets": "forests", "fonds": "fund", "sociale": "social", "formation": "training", "professionnelle": "vocational", "universite": "university", "universidad": "university",
    "ministere": "ministry", "finances": "finance", "societe": "company|society", "portuaire": "port", "ports": "port", "banque": "bank", "cooperative": "cooperative", "developpement": "development", "routes": "roads", "office": "office|authority", "irrigants": "irrigation+users", "usagers": "users", "electricite": "electrification", "programme": "programme", "autorite": "authority",
    "mdtf": "multi+donor+trust+fund", "agencia": "agency", "banco": "bank", "ministerio": "ministry", "consejo": "council|board", "fondo": "fund", "centro": "centre", "salud": "health", "agua": "water",
}
# -----------------------------------------------------------------------------------------------------
LEXICON = frozenset(KIND_WORDS)
#: Kinds written out with at least this many proper parts (by their first letters) are established; other names are bodies of their own.
ESTABLISHED = 3
#: Least letters of a shortened proper part, and of what was cut off it.
SHORTENED, REST = 5, 3
#: Kinds and acronyms that are read on the driver, at most; they grow with the language of names, not with their number. More raise.
MOST_KINDS = 200_000


def fold(text: str | None) -> list[str]:
    flat = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return re.findall(r"[a-z0-9]+", re.sub(r"\bco-op\b\.?", "coop", flat.replace("’", "'")))


def deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return min(row[-1], most + 1)


def _abbreviates(acronym: str, words: list[str]) -> bool:
    """Most letters of the acronym are initials of the words, in order."""
    initials = iter(w[0] for w in words if w not in STOP or w in acronym)
    return len(words) >= 2 and sum(c in initials for c in acronym) >= max(2, 0.6 * len(acronym))


def _misspelt_index() -> dict[str, set[str]]:
    index: dict[str, set[str]] = {}
    for word in [*KIND_WORDS, *(w for w in REWRITE if len(w) >= 6)]:
        if len(word) >= 4:
            for form in {word} | deletions(word):
                index.setdefault(form, set()).add(word)
    return index


_INDEX = _misspelt_index()
_LEET = str.maketrans("01345", "oleas")


def kind_word(token: str) -> list[tuple[str, ...]]:
    """The readings of a token as kind words; empty if it is none. Misspellings of long words are repaired."""
    for word in dict.fromkeys((token, token.translate(_LEET), token.translate(str.maketrans("01", "oi")))):
        if word in REWRITE:
            return [tuple(alt.split("+")) for alt in REWRITE[word].split("|")]
        if word in LEXICON:
            return [(word,)]
        if len(word) >= 4:
            near = set().union(*(_INDEX.get(form, set()) for form in {word} | deletions(word)))
            near = {w for w in near if len(w) >= 4 and _distance(word, w, 2) <= (1 if min(len(w), len(word)) < 8 else 2) and (len(w) > 5 or (len(w) > 4 and len(word) > 4) or (word[0] == w[0] and not _syllables(word)))}
            if near:
                best = min(near, key=lambda w: (_distance(word, w, 2), w))
                return [tuple(alt.split("+")) for alt in REWRITE.get(best, best).split("|")]
    return []


def _syllables(word: str) -> bool:
    """Consonants and vowels alternate, as in many proper names that resemble short words."""
    return re.fullmatch(r"(?:[^aeiou][aeiou])+", word) is not None


def _unjoin(token: str, loose: bool) -> list[str]:
    """A token written together from two words, of which both are kind words or, if ``loose``, at least one."""
    if len(token) < 7 or kind_word(token):
        return [token]
    best: tuple[int, list[str]] | None = None
    for i in range(2, len(token) - 1):
        left, right = token[:i], token[i:]
        known_left = left in LEXICON or (left in REWRITE and len(left) >= 6) or left in ("of", "and")
        known_right = right in LEXICON or (right in REWRITE and len(right) >= 6) or right in ("of", "and")
        both = (known_left and (known_right or (len(right) >= 4 and bool(kind_word(right))))) or (known_right and len(left) >= 4 and bool(kind_word(left)))
        one = (known_right and len(right) >= 4 and i >= 4) or (known_left and len(left) >= 4 and len(right) >= 4) or (left == "of" and len(right) >= 6) or (right == "of" and len(left) >= 6)
        weight = 100 if both else (len(right) if known_right else len(left)) if one and loose else 0
        if weight and (best is None or weight > best[0]):
            best = (weight, [left, right])
    return best[1] if best else [token]


def parse(name: str | None, name_norm: str) -> dict:
    """Tokens of a name by role: proper words, readings of its kind, the written-out order for acronyms."""
    text = name if name else re.sub(r" \[[a-z0-9]{2}\]$", "", name_norm)
    tail = re.search(r"\(([A-Z][A-Z0-9&-]{1,9})\)\s*$", name or "")
    acronym = ""
    if tail and _abbreviates("".join(fold(tail[1])), fold(text[: tail.start()])):
        acronym, text = "".join(fold(tail[1])), text[: tail.start()]
    tokens = fold(text)
    if tokens[:2] == ["m", "s"]:
        tokens = tokens[2:]
    for legal in LEGAL_TAILS:
        if len(tokens) > len(legal) and tuple(tokens[-len(legal) :]) == legal:
            tokens = tokens[: -len(legal)]
    tokens = [t for t in tokens if t not in NOISE or len(tokens) < 2]
    strict, loose = ([part for t in tokens for part in (_unjoin(t, wide) if t not in STOP else [t])] for wide in (False, True))
    main = _roles(strict)
    return {"acronym": acronym, **main, "loose": _roles(loose) if loose != strict else None, "exact": _roles(strict, repair=False) if main["repaired"] else None}


def _roles(tokens: list[str], repair: bool = True) -> dict:
    proper, readings, order, repaired = [], [()], [], False
    translated = any(t in ARTICLES for t in tokens)
    for t in tokens:
        if t in STOP:
            continue
        # a word of both languages is ambiguous only beside articles of the other
        found = [(t,)] if t in LEXICON and not translated else kind_word(t) if repair or t in REWRITE or t in LEXICON else []
        repaired |= bool(found) and t not in REWRITE and t not in LEXICON
        if found:
            # as sets of words, so that their number is bounded by the fixed table of ambiguous words
            readings = list(dict.fromkeys(tuple(sorted(a + b)) for a, b in product(readings, found)))
            order.append(found[0] if len(found) == 1 else ())
        else:
            proper.append(t)
    plain = len(readings) == 1 and all(t in LEXICON or t in STOP or t not in REWRITE for t in tokens)
    return {
        "repaired": repaired, "proper": proper, "kinds": sorted({" ".join(sorted(r)) for r in readings}), "plain": plain, "initials": "".join(w[0] for r in order for w in r) if plain else "",
        "words": [w for t in tokens if t not in STOP for w in ([t] if t in LEXICON else (kind_word(t) or [(t,)])[0])],
    }


_PARSED = "name_norm string, country string, proper array<string>, kinds array<string>, plain boolean, initials string, acronym string, words array<string>, proper2 array<string>, kinds2 array<string>, proper3 array<string>, kinds3 array<string>"


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for n, t, c in zip(pdf.name_norm, pdf.name, pdf.country):
            p = parse(t, n)
            loose, exact = p.pop("loose"), p.pop("exact")
            rows.append({"name_norm": n, "country": c, **p, "proper2": loose and loose["proper"], "kinds2": loose and loose["kinds"], "proper3": exact and exact["proper"], "kinds3": exact and exact["kinds"]})
        yield pd.DataFrame(rows, columns=["name_norm", "country", "proper", "kinds", "plain", "initials", "acronym", "words", "proper2", "kinds2", "proper3", "kinds3"])


def _completed(kind: str, proper: list[str], established: list[tuple[str, frozenset[str]]]) -> tuple[str, list[str]]:
    """A kind that lacks words: the missing word stands misspelt in the proper part, or only one known kind fits."""
    have = frozenset(kind.split())
    fits = [(k, words - have) for k, words in established if have < words]
    for k, missing in fits:
        if len(missing) == 1 and len(proper) > 1:
            (word,) = missing
            rest = [t for t in proper if _distance(t, word, 1) > 1]
            if len(rest) == len(proper) - 1:
                return k, rest
    return (fits[0][0], proper) if len(fits) == 1 and len(have) >= 2 else (kind, proper)


def rarity(options: list[str], kinds: dict[str, int]) -> dict[str, float]:
    """How rare each reading of the same words is: minus the log of its share among the written-out kinds."""
    total = sum(kinds.get(k, 0) + 1 for k in options)
    return {k: -math.log((kinds.get(k, 0) + 1) / total) for k in options}


def _resolve(kinds: dict[str, int], acronyms: dict[str, str]):
    """Canonical form of every parsed name: (kind, proper part), and whether that kind is established."""
    established = [(k, frozenset(k.split())) for k, n in kinds.items() if n >= ESTABLISHED]

    def least_rare(options, supported: frozenset[str]) -> str:
        rare = rarity(list(options), kinds)
        return max(options, key=lambda k: (k in supported, -rare[k], k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, c, proper, options, words, acronym, proper2, options2, proper3, options3, s1, s2, s3 in zip(pdf.name_norm, pdf.country, pdf.proper, pdf.kinds, pdf.words, pdf.acronym, pdf.proper2, pdf.kinds2, pdf.proper3, pdf.kinds3, pdf.s1, pdf.s2, pdf.s3):
                known, known2, known3 = (frozenset(x) if x is not None else frozenset() for x in (s1, s2, s3))
                proper, best = list(proper), least_rare(options, known)
                if options2 is not None and len(proper2) and best not in known:
                    wide = least_rare(options2, known2)
                    if wide in known2 or kinds.get(wide, 0) >= max(ESTABLISHED, kinds.get(best, 0)):
                        proper, best = list(proper2), wide
                if options3 is not None and kinds.get(best, 0) < ESTABLISHED:
                    # a proper word that only resembles a kind word
                    narrow = least_rare(options3, known3)
                    if narrow in known3 or kinds.get(narrow, 0) >= ESTABLISHED or (not narrow and any(t in acronyms for t in proper3)):
                        proper, best = list(proper3), narrow
                if kinds.get(best, 0) < ESTABLISHED:
                    # an acronym in place of the kind, beside the proper part
                    hits = [t for t in [*proper, *([acronym] if acronym else [])] if t in acronyms] if not best else []
                    if hits and (len(proper) > 1 or hits[0] == acronym):
                        best = acronyms[hits[0]]
                        proper = [t for t in proper if t != hits[0]]
                    elif best and proper:
                        best, proper = _completed(best, proper, established)
                elif len(proper) > 1:
                    # an acronym of the whole name that was typed without brackets
                    proper = [t for t in proper if not _spells(t, best, acronyms)] or proper
                out.append((n, c, best, "".join(proper), " ".join(sorted(proper)), " ".join(words), acronym, kinds.get(best, 0) >= ESTABLISHED and bool(proper)))
            yield pd.DataFrame(out, columns=["name_norm", "country", "kind", "place", "sorted", "words", "acronym", "established"])

    return run


def _spells(token: str, kind: str, acronyms: dict[str, str]) -> bool:
    """A short token that ends in an acronym of the kind, after at most two letters of the proper part."""
    return 2 <= len(token) <= 7 and any(acronyms.get(token[i:]) == kind for i in range(3) if len(token) - i >= 2)


def _written_out(parsed: DataFrame, stats: DataFrame) -> DataFrame:
    """``parsed`` with the kinds among its readings that other names write out for the same proper words and country (s1, s2, s3).

    Every reading of every name is a row; they meet the written-out forms in an equi-join. A name without a country looks in all.
    """
    key = lambda c: F.concat_ws(" ", F.sort_array(c))
    own = stats.select("kind", key(F.col("proper")).alias("at"), F.coalesce("country", F.lit("")).alias("c")).distinct()
    known = own.unionByName(own.select("kind", "at", F.lit("").alias("c"))).distinct()
    rows = None
    for i, (proper, kinds) in enumerate((("proper", "kinds"), ("proper2", "kinds2"), ("proper3", "kinds3")), 1):
        part = parsed.where(F.size(kinds) > 0).select("name_norm", F.lit(i).alias("i"), F.explode(kinds).alias("kind"), key(F.col(proper)).alias("at"), F.coalesce("country", F.lit("")).alias("c"))
        rows = part if rows is None else rows.unionByName(part)
    met = rows.join(known, ["kind", "at", "c"], "left_semi").groupBy("name_norm").agg(*[F.collect_set(F.when(F.col("i") == i, F.col("kind"))).alias(f"s{i}") for i in (1, 2, 3)])
    return parsed.join(met, "name_norm", "left")


def link_names(organizations: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(name_norm, entity)``: rows of one entity share it; categories and null names are no rows of it.

    Names are matched within a country. A name without a country joins the only country in which its form
    is known, else only other names without one. ``aliases`` (canonical, variant) links spellings that no rule
    explains. Repeated rows count once; a null ``name`` is read from ``name_norm``; null ``is_category`` is false;
    names without letters form entities of their own. Empty tables give an empty result.
    """
    rows = organizations.where(F.col("name_norm").isNotNull() & ~F.coalesce(F.col("is_category"), F.lit(False)))
    rows = rows.groupBy("name_norm").agg(F.max("name").alias("name"), F.max("country_iso2").alias("country"))
    known = aliases.where(F.col("canonical").isNotNull() & F.col("variant").isNotNull())
    known = known.select(F.lower(F.trim(F.regexp_replace("variant", r"\s+", " "))).alias("v"), F.col("canonical").alias("name"))
    # a spelling of the alias table is read as its canonical name; the table is small by contract, the join is not hinted
    spelt = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    one = known.groupBy("v").agg(F.min("name").alias("canonical"))
    rows = rows.withColumn("v", spelt).join(one, "v", "left").select("name_norm", F.coalesce("canonical", "name").alias("name"), "country")
    # the alias table's own spellings join as rows without a country, so that they can explain others
    extra = known.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).select(F.concat(F.lit("\u0000"), F.col("name")).alias("name_norm"), "name", F.lit(None).cast("string").alias("country"))
    parsed = materialize(rows.unionByName(extra).mapInPandas(_parse_all, _PARSED), "names-parsed")

    stats = parsed.where(F.col("plain") & (F.size("proper") > 0) & F.col("proper2").isNull()).select(F.element_at("kinds", 1).alias("kind"), "initials", F.concat_ws("", "proper").alias("place"), "proper", "country")
    counts = stats.where("kind != ''").groupBy("kind").agg(F.countDistinct(F.substring("place", 1, 3)).alias("n"))
    kinds = {r.kind: r.n for r in _bounded(counts)}
    spelled = stats.where(F.length("initials") >= 2).groupBy("initials", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("initials").orderBy(F.desc("n"), "kind")
    spelled = spelled.withColumn("rn", F.row_number().over(top)).where((F.col("rn") == 1) & (F.col("n") >= ESTABLISHED))
    acronyms = {r.initials: r.kind for r in _bounded(spelled) if kinds.get(r.kind, 0) >= ESTABLISHED}
    forms = _written_out(parsed, stats).mapInPandas(_resolve(kinds, acronyms), "name_norm string, country string, kind string, place string, sorted string, words string, acronym string, established boolean")
    forms = materialize(forms, "names-forms")

    placed = forms.where("established").select("name_norm", F.concat_ws("\u0001", F.lit("k"), "kind").alias("kind"), "place", "sorted", "country")
    funds = _bodies(forms.where("not established"))
    linked = _roots(placed.unionByName(funds))
    return linked.where(~F.startswith("name_norm", F.lit("\u0000"))).select("name_norm", "entity")


def _bounded(rows: DataFrame) -> list:
    """The rows, of which there are at most MOST_KINDS."""
    found = rows.limit(MOST_KINDS + 1).collect()
    if len(found) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of bodies")
    return found


def _follow(up: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` of pointers without cycles, each round reaching twice as far, until nothing moves."""
    while True:
        step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = materialize(up.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), name)
        up = after.select("node", "root")
        if after.where("moved").isEmpty():
            return up


def _bodies(forms: DataFrame) -> DataFrame:
    """Bodies without an established kind: shortened, reordered and abbreviated names join the fullest form."""
    w = F.filter(F.array_distinct(F.split("words", " ")), lambda x: x != "")
    body = forms.select("name_norm", "country", w.alias("w"), F.when(F.col("acronym") != "", F.col("acronym")).alias("acronym"), F.concat_ws("", F.split("words", " ")).alias("joined"))
    body = body.withColumn("bag", F.concat_ws(" ", F.sort_array("w")))
    sizes = body.groupBy("bag").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w"), F.max("acronym").alias("acronym"))
    # misspelt words meet the words of fuller names by their deletions
    vocab = sizes.select(F.explode("w").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") >= 4)
    cut = lambda c: F.array_union(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))
    shapes = vocab.withColumn("form", F.explode(cut(F.col("word"))))
    a, b = shapes.alias("a"), shapes.alias("b")
    fixes = a.join(b, "form").where((F.col("a.word") != F.col("b.word")) & ((F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.word") < F.col("a.word")))) & (F.levenshtein("a.word", "b.word") <= F.when(F.length("a.word") >= 6, 2).otherwise(1)))
    fixes = fixes.groupBy(F.col("a.word").alias("word")).agg(F.max_by("b.word", F.struct("b.n", "b.word")).alias("right"))
    words = sizes.select("bag", "n", "acronym", F.posexplode("w").alias("at", "word")).join(fixes, "word", "left")
    fixed = words.groupBy("bag", "n", "acronym").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("right", "word").alias("w")))).alias("p")).select("bag", "n", "acronym", F.array_distinct(F.col("p.w")).alias("w"))
    fixed = materialize(fixed.withColumn("key", F.concat_ws(" ", F.sort_array("w"))), "names-fixed")
    grown = fixed.groupBy("key").agg(F.sum("n").alias("n"), F.min_by("w", F.struct(F.when(F.col("acronym").isNotNull(), 0).otherwise(1), F.col("bag"))).alias("w"), F.max("acronym").alias("acronym"))
    grown = materialize(grown, "names-grown")
    parent = grown.where(F.size("w") >= 3).select(F.col("key").alias("pkey"), F.col("w").alias("pw"), F.col("n").alias("pn"), F.element_at("w", 1).alias("head"), F.col("acronym").alias("pacr"))
    # a child holds the head word of its parent and no, or fewer than half, other words. A child all of whose words the parent
    # has meets it on its rarest word; one of m words that shares at least 3 and half of them meets it on one of its
    # m - max(3, m / 2) + 1 rarest (prefix filtering): no such parent is passed over, and common words bring no pairs together
    common = grown.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    each = grown.select("key", "n", "w", F.explode("w").alias("word")).join(common, "word")
    m = F.size("w")
    prefix = F.greatest(F.lit(1), m - F.greatest(F.lit(3), F.ceil(m / 2).cast("int")) + 1)
    child = each.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("df", "word"))).where(F.col("rn") <= prefix).select("key", "n", "w", m.alias("m"), "word")
    owner = parent.withColumn("word", F.explode("pw"))
    shared = F.size(F.array_intersect("w", "pw"))
    larger = (F.size("pw") > F.col("m")) | ((F.size("pw") == F.col("m")) & (F.struct("pn", "pkey") > F.struct(F.col("n").alias("pn"), F.col("key").alias("pkey"))))  # an order, so that pointers never close a ring
    whole, most = (shared == F.col("m")) & (F.size("pw") > F.col("m")), (shared >= 3) & (shared * 2 >= F.col("m")) & F.col("pacr").isNotNull()
    sub = child.join(owner, "word").where(F.array_contains("w", F.col("head")) & (F.col("key") != F.col("pkey")) & larger & (whole | most)).select("key", "pkey", "pn", shared.alias("shared")).distinct()
    # an acronym alone: the initials of a fuller name, or what stands in brackets after one
    initials = F.concat_ws("", F.transform("pw", lambda x: F.substring(x, 1, 1)))
    short = grown.where(F.size("w") <= 2).select("key", F.concat_ws("", "w").alias("a"))
    named = parent.select("pkey", "pn", F.explode(F.array_distinct(F.array(initials, F.coalesce("pacr", initials)))).alias("a"))
    spelt = short.join(named, "a").where(F.col("key") != F.col("pkey")).select("key", "pkey", "pn", F.lit(99).alias("shared"))
    up = sub.unionByName(spelt).groupBy("key").agg(F.max_by("pkey", F.struct("shared", "pn", "pkey")).alias("up"))
    top = _follow(materialize(up.select(F.col("key").alias("node"), F.col("up").alias("root")), "names-bodies"), "names-bodies")
    keys = fixed.join(top.withColumnRenamed("node", "key"), "key", "left").select("bag", F.coalesce("root", "key").alias("place"))
    out = body.join(keys, "bag").select("name_norm", F.lit("b").alias("kind"), "place", F.col("place").alias("sorted"), "country")
    return out.where("place != ''").unionByName(body.where("bag = ''").select("name_norm", F.lit("x").alias("kind"), F.col("name_norm").alias("place"), F.col("name_norm").alias("sorted"), "country"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(name_norm, entity)``: every form follows its pointers to the most frequent form it can be rewritten to."""
    forms = materialize(forms.withColumn("country", F.coalesce("country", F.lit(""))), "names-placed")
    nodes = forms.groupBy("kind", "place", "country").agg(F.count(F.lit(1)).alias("n"), F.min("sorted").alias("sorted"))
    nodes = nodes.withColumn("node", F.concat_ws("\u0001", "kind", "place", "country"))
    cut = F.transform(F.sequence(F.lit(1), F.length("place")), lambda i: F.concat(F.substring(F.col("place"), F.lit(1), i - 1), F.substring(F.col("place"), i + 1, F.length("place"))))
    # bodies were repaired word by word: only their equal forms meet; reordered proper parts meet on their sorted words
    typed = F.when(F.startswith("kind", F.lit("k")) & (F.length("place") >= 5), F.array_union(F.array("place"), cut)).otherwise(F.array("place"))
    shapes = nodes.withColumn("form", F.explode(F.concat(typed, F.when(F.contains("sorted", F.lit(" ")) & F.startswith("kind", F.lit("k")), F.array(F.concat(F.lit("\u0001"), "sorted"))).otherwise(F.array().cast("array<string>")))))
    shapes = materialize(shapes.select("kind", "form", "country", "node", "place", "sorted", "n"), "names-shapes")
    a = shapes.select("kind", "form", F.col("country").alias("ac"), F.col("node").alias("an"), F.col("place").alias("ap"), F.col("sorted").alias("asort"), F.col("n").alias("nn"))
    b = shapes.select("kind", "form", F.col("country").alias("bc"), F.col("node").alias("bn"), F.col("place").alias("bp"), F.col("sorted").alias("bsort"), F.col("n").alias("bm"))

    def near(pairs: DataFrame) -> DataFrame:
        far = F.when(F.col("asort") == F.col("bsort"), 0).otherwise(F.levenshtein("ap", "bp"))
        close = pairs.withColumn("far", far).where((F.col("an") != F.col("bn")) & (F.col("far") <= F.when(F.least(F.length("ap"), F.length("bp")) >= 7, 2).otherwise(1)))
        return close.select("an", "bn", "bc", "nn", "bm", "far").distinct()

    # the country is part of the key: a form that every country uses brings no pairs of different countries together
    home = near(a.join(b.withColumn("ac", F.col("bc")), ["kind", "form", "ac"]))
    # without a country: the only country at the least distance, or none
    abroad = near(a.where("ac = ''").drop("ac").join(b.where("bc != ''"), ["kind", "form"]))
    nearest = Window.partitionBy("an").orderBy("far")
    abroad = abroad.withColumn("r", F.rank().over(nearest)).where("r = 1").groupBy("an").agg(F.max_by("bn", F.struct("bm", "bn")).alias("up"), F.count_distinct("bc").alias("c")).where("c = 1").select("an", "up")
    home = home.where((F.col("bm") > F.col("nn")) | ((F.col("bm") == F.col("nn")) & (F.col("bn") < F.col("an"))))
    home = home.groupBy("an").agg(F.max_by("bn", F.struct(-F.col("far"), F.col("bm"), F.col("bn"))).alias("up"))
    up = nodes.select(F.col("node").alias("an")).join(abroad, "an", "left").join(home.withColumnRenamed("up", "up2"), "an", "left")
    up = materialize(up.select(F.col("an").alias("node"), F.coalesce("up", "up2", "an").alias("root")), "names-up")
    up = _follow(up, "names-up")
    up = _follow(materialize(_lengthened(nodes, up), "names-long"), "names-long")
    return forms.withColumn("node", F.concat_ws("\u0001", "kind", "place", "country")).join(up, "node").select("name_norm", F.col("root").alias("entity"))


def _lengthened(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """``(node, root)`` where roots whose proper part is the beginning of a longer one point to that.

    Cutting a name short is the rarest rewriting to undo: it counts only if exactly one root of the kind and country (of the kind, for
    names without a country) begins so. Beginnings meet shortened parts in an equi-join.
    """
    roots = up.select(F.col("root").alias("node")).distinct().join(nodes, "node").where(F.startswith("kind", F.lit("k")))
    longer = roots.where(F.length("place") >= SHORTENED + REST).select("kind", F.col("country").alias("lc"), F.col("node").alias("long"), F.explode(F.transform(F.sequence(F.lit(SHORTENED), F.length("place") - REST), lambda n: F.substring(F.col("place"), F.lit(1), n))).alias("place"))
    at_home = roots.where("country != ''").join(longer.withColumn("country", F.col("lc")), ["kind", "place", "country"]).select("node", "long")
    anywhere = roots.where("country = ''").join(longer, ["kind", "place"]).select("node", "long")
    only = at_home.unionByName(anywhere).groupBy("node").agg(F.min("long").alias("long"), F.count_distinct("long").alias("n")).where("n = 1").select(F.col("node").alias("root"), "long")
    return up.join(only, "root", "left").select("node", F.coalesce("long", "root").alias("root"))


def variant_pairs(organizations: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(name_norm_a, name_norm_b)``, a < b: all pairs of rows that name the same organization."""
    linked = materialize(link_names(organizations, aliases), "names-linked")
    a, b = linked.select("entity", F.col("name_norm").alias("name_norm_a")), linked.select("entity", F.col("name_norm").alias("name_norm_b"))
    return a.join(b, "entity").where(F.col("name_norm_a") < F.col("name_norm_b")).select("name_norm_a", "name_norm_b")
