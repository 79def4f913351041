"""Problem 3 - template residue, filler, error pages and script notices in place of content.

Every whole text is met once, in Arrow batches, and cut into lines and sentences. Two kinds of evidence are combined.

1. Detectors judge a segment by itself: placeholder syntax, author instructions, filler and low information, and the
   grammar of fault messages and script notices. A pattern is tried where a literal stands that all its matches need.
2. Host evidence needs no word of the message. Every segment, masked for numbers, is counted by the documents (hosts) that
   hold it and compared with the terms of address slug, title and the rest of the body. A segment that stands in
   several documents, mostly shares no term with them, and in at least half of them stands beside other residue is
   a response of the host (an error line of any wording, its footer, its code), and makes residue of every record
   that holds it; that spreads until no further segment joins. Segments whose words are mostly about pages and servers need no such company.

Long sentences that only speak of servers, errors or scripts have a low share of such words and do not count.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opgraph.plans.materialize import materialize

try:
    from re import _parser
except ImportError:  # without it every pattern is tried on every segment
    _parser = None
try:
    import ahocorasick
except ImportError:  # the automaton only speeds up what the patterns below decide
    ahocorasick = None

# ---- fixed values: patterns and word lists -------------------------------------------------------
#: Editorial marks in brackets, which are no placeholders.
EDITORIAL = r"sic|emphasis|redacted|email|phone|e-mail|translat|inaudible|illegible|citation|quotation|original|note|see|annex|figure|table|ibid|omitted|italics|internal|footnote|source|ref|blank page|end|laughter|applause|unofficial"
#: Names of HTML elements, which are no placeholders between angle brackets.
HTML = r"a|abbr|article|b|body|br|button|code|div|em|footer|form|h[1-6]|head|header|hr|html|i|img|input|li|main|nav|ol|p|pre|section|small|span|strong|sub|sup|table|tbody|td|th|thead|title|tr|u|ul"
PLACEHOLDER = "|".join((
    r"\{\{[^{}\n]{0,80}\}\}", r"\$\{[^{}\n]{1,80}\}", r"<<[^<>\n]{1,80}>>", r"«[^«»\s]+»", r"%%\w+%%", r"@@\w+@@",
    r"\[%[^\[\]\n]{1,80}%\]", r"__[A-Z][A-Z_]*[A-Z]__", r"(?<![\w&])#[a-z]+(?:_[a-z]+)*#", r"_{4,}", r"(?<![-/_])\{[a-z]{3,}(?:[ _][a-z]+)*\}(?![-/_]\{)",
    r"<(?!(?:" + HTML + r")>)[a-z]{2,}(?:[ _-][a-z]+)*>",
    r"\[\s*(?:[xX]{2,}|[●•○◦■□]+|…|\.{2,}|_+|-{2,}|\?+|TB[ACD]|tb[acd])\s*\]",
    r"(?i:[\[(]\s*(?:insert|enter|type|fill in|add|provide|specify|state|name of|date of|amount of|to be (?:completed|confirmed|determined|inserted|filled|added|decided)|tb[cd]|(?:à|a) (?:compléter|completar|preencher|insérer|insertar|inserir))\b[^\[\]()\n]{0,80}[\])])",
    r"(?i:\[[^\[\]\n]{1,60}[–:-]\s*(?:to be (?:completed|confirmed|determined|inserted|filled in|added)|tb[cd])\s*\])",
    r"\[(?!(?i:" + EDITORIAL + r"))[a-z]{3,}(?: [a-z]+){0,4}(?<!redacted)(?<!added)(?<!omitted)(?<!supplied)\](?!\()",
    r"(?i:\[(?:task team|author|editor|section|text|table|figure|map|chart|picture|photo|describe|explain|summari[sz]e|list|discuss|indicate|paste|placeholder|country team|team|drafting|no text)\b[^\[\]\n]{12,120}\]?)",
    r"(?i:<<<[^<>\n]{1,80}>>>)",
))
INSTRUCTION = "|".join((
    r"\bclick (?:or tap )?here to (?:enter|add|insert|edit)", r"^\W*choose an? (?:item|option|date)\W*$", r"^\W*(?:type|enter|write|insert|add) your (?:\w+ ){1,3}here\b",
    r"^\W*your (?:\w+ ){1,3}(?:appears?|goes|will appear|comes) here\W*$", r"\b(?:text|content|title|heading|narrative|image|body) (?:goes|comes|appears) here\b",
    r"\bdelete this (?:note|text|paragraph|instruction|box|line|section)\b", r"\breplace this (?:text|paragraph|section|note|sentence|line|box)\b", r"\binstructions? (?:to|for) (?:the )?authors?\b\s*:",
    r"^\W*drafting note\b", r"^\W*guidance\s*:", r"^\W*(?:note|instruction) to (?:drafter|editor|author|task team|ttl)\b", r"\b(?:task )?team (?:to|will|should) complete\b(?= (?:before|this|after|by))", r"\bsection under construction\b",
    r"\bfill in (?:after|before|once|here|this|the blanks?)\b", r"\bpaste (?:the )?(?:\w+ ){0,3}here\b", r"\bremove (?:when|once|after|before) (?:done|complete|submission|finished)",
    r"^\W*(?:à compléter|a completar|para completar|por completar|à remplir|a preencher)\b", r"\bto be (?:completed|drafted|written|filled in) by (?:the )?(?:task team|author|team|ttl)\b", r"^\W*(?:tbd|tbc|todo|to do|xxx+)\W*$",
))
FILLER = "|".join((
    r"\b(?:dummy|sample|filler|placeholder|example|mock|specimen) (?:text|content|copy|paragraph|body)\b(?! (?:was|were|of the))", r"\btexte (?:provisoire|factice|d'exemple|de remplissage)\b", r"\btexto (?:provisional|provisorio|provisório|de ejemplo|de exemplo|de relleno|simulado)\b",
    r"\blorem ipsum\b", r"\bthe quick brown fox\b",
))
#: Words of the usual pseudo-Latin filler, and of keyboard filler.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
LATIN_ONLY = "lorem ipsum consectetur adipiscing eiusmod incididunt aliqua nostrud veniam ullamco dolore amet tempor labore enim elit quis minim".split()
KEYBOARD = "asdf asdfg asdfgh qwer qwert qwerty zxcv zxcvb blah foo bar baz xxx xxxx zzz zzzz tttt aaa aaaa test testing hjkl yada".split()
STATUS = r"bad request|unauthori[sz]ed|forbidden|not found|method not allowed|request time-?out|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out|temporarily unavailable|moved permanently"
FAULT = "|".join((
    r"^\W*(?:http|error|erreur|código|code|status)?\W*[45]\d\d\W+(?:error\W+)?(?:" + STATUS + r")\b", r"^\W*(?:http|error|erreur|error code)\W*[45]\d\d\b", r"^\W*(?:" + STATUS + r")\W*$",
    r"\b(?:is|are|was) (?:currently |temporarily )?(?:not available|unavailable|down for maintenance|offline|under maintenance|denied|forbidden)\b", r"\bno longer (?:exists?|available)\b",
    r"\b(?:has |have )?timed out\b", r"\b(?:ended|stopped|closed|terminated) unexpectedly\b",
    r"\b(?:cannot|can't|can not|could not|couldn't) be (?:found|reached|displayed|loaded|opened|delivered|shown|retrieved|read|processed|completed)\b", r"\bdid not (?:answer|respond|load|reply)\b", r"\bdoes not (?:exist|respond|load)\b", r"\bhas (?:moved|expired|been removed|been moved)\b",
    r"\bfailed to (?:load|open|connect|fetch|render)\b", r"\b(?:connection|request|login|upload|download) (?:failed|refused|reset|closed|expired)\b", r"\bunhandled (?:exception|error)\b", r"\bnull (?:reference|pointer)\b", r"\bsomething went wrong\b", r"\btoo many requests\b", r"\bpage not found\b", r"\baccess (?:to this \w+ )?(?:is |was )?denied\b", r"\bstack ?trace\b|\bsegmentation fault\b|\bfatal error\b",
    r"\bne répond (?:pas|plus)\b", r"\bintrouvable\b", r"\bn'est (?:plus|pas) (?:disponible|accessible)\b", r"\bn'a pas pu être (?:chargée?|affichée?|trouvée?)\b", r"\bno se (?:pudo|puede|encontró|encuentra)\b.{0,40}\b(?:página|documento|archivo|servidor|cargar)\b", r"\bno (?:está|esta) disponible\b", r"\bnão (?:foi possível|está disponível|encontrad[ao])\b", r"\b(?:page|página) (?:introuvable|no encontrada|não encontrada)\b",
))
SCRIPT = r"\b(?:java ?script|noscript|scripting|client-side scripts?|cookies)\b"
SCRIPT_NEED = r"\b(?:enable[ds]?|enabling|allow(?:ed)?|activate|turn(?:ed)?|switch(?:ed)?|must|has to|have to be|requires?|required|needs?|off|on|disabled|blocked|bloque|bloqueado|active[rz]?|activez|activar?|active|habilit\w+|désactivé|requiert|nécessite|unsupported|support)\b"
SCRIPT_PLACE = r"\b(?:browser|viewer|page|app|application|content|document|site|reload|loading|seconds|happens|navigateur|navegador|texte|text|lire|leer|ler|contenu|contenido|conteúdo|view|shown|run)\b"
#: Words that pages about faults and notices are made of.
FAULT_WORDS = "page pages server serveur servidor gateway host service browser session account file document request requests content connection database download upload site url link website error erreur exception code id retry reload refresh loading try again later sorry unavailable available expired denied access forbidden exist exists found loaded displayed maintenance timed timeout sign login administrator javascript scripting scripts cookies script enable página código solicitada cargar documento archivo disponible introuvable demandé réessayez navegador navigateur servidor indisponível encontrada invalid refused failed".split()
#: A superset of how placeholders begin.
TRIGGER_PUNCTUATION = r"[{}●«»\[]|<[<a-z]|\(\s*(?i:insert|enter|type|fill|add|provide|specify|state|name|date|amount|to be|tb[cd]|à|a )|%%|@@|__|#[a-z]+[_#]"
# -------------------------------------------------------------------------------------------------
SEGMENT = re.compile(r"\s(?:(?<=[.!?…]\s)|(?<=\n))\s*")
HYPHENATED = re.compile(r"-\n(?<=[^\W\d_A-Z]-\n)(?=[^\W\d_A-Z])")
WRAPPED = re.compile(r"\n(?:(?:(?<=[^\W\d_]\n)|(?<=[,;]\n))(?=[^\W\d_A-Z])|[ \t]+(?=\S))")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
DIGIT = re.compile(r"\d")
MASK = re.compile(r"[0-9a-f]*\d[0-9a-f]*")
#: A segment of more words than this that speaks of faults is no message by itself; host evidence decides on it.
MOST_WORDS = 14
#: A segment of LOW_LEAST or more words is low in information with at most LOW_RICHNESS distinct words a square root of all.
LOW_RICHNESS, LOW_LEAST = 1.75, 12
#: Documents that must hold a masked segment before its repetition is evidence; the share of them that must hold other residue, and that must not share its terms.
HOSTS, BESIDE, APART = 3, 0.5, 0.5
#: Share of words about pages and servers from which a segment needs no residue beside it.
ABOUT = 0.3

_PLACEHOLDER = re.compile(PLACEHOLDER)
_INSTRUCTION, _FILLER, _FAULT, _SCRIPT, _NEED, _PLACE = (re.compile(p, re.IGNORECASE) for p in (INSTRUCTION, FILLER, FAULT, SCRIPT, SCRIPT_NEED, SCRIPT_PLACE))
_PUNCTUATION = re.compile(TRIGGER_PUNCTUATION)
_LATIN, _LATIN_ONLY, _KEYBOARD, _FAULT_SET = map(frozenset, (LATIN, LATIN_ONLY, KEYBOARD, FAULT_WORDS))
#: Letters that a pattern without case takes for i and s, though lower() does not make them so.
_PLAIN = str.maketrans("\u0130\u0131\u017f", "iis")
#: Most literals kept for one place of a pattern.
MOST_LITERALS = 64


def _literals(items) -> tuple[set[str] | None, set[str] | None]:
    """Of a parsed pattern, in lower case: (all strings it can match, strings of which every match holds one); None if not known."""
    run, best, whole = {""}, None, True

    def consider(found: set[str] | None) -> None:
        nonlocal best
        if found and "" not in found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in items:
        name, exact, needed = str(op), None, None
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            exact = {chr(c).lower() for _, c in arg}
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):  # they take no characters
            exact = {""}
        elif name == "SUBPATTERN":
            exact, needed = _literals(arg[3])
        elif name == "BRANCH":
            parts = [_literals(x) for x in arg[1]]
            exact = set().union(*(x for x, _ in parts)) if all(x is not None for x, _ in parts) else None
            needed = set().union(*(y for _, y in parts)) if all(y for _, y in parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            one, must = _literals(inner)
            exact = {"", *one} if one is not None and (low, high) == (0, 1) else None
            needed = must if low else None
        consider(needed)
        if exact is not None and len(run) * len(exact) <= MOST_LITERALS:
            run = {x + y for x in run for y in exact}
        else:
            consider(run)
            run, whole = exact or {""}, False
    consider(run)
    return (run if whole else None), best


def _kinds():
    """A test for the detectors (as bits) whose patterns can match in a text: every match of a pattern holds one of its literals."""
    bits: dict[str, int] = {}
    for bit, pattern in ((1, INSTRUCTION), (2, FILLER), (4, FAULT), (8, SCRIPT)):
        needed = _literals(_parser.parse(pattern, re.IGNORECASE))[1] if _parser else None
        if not needed:
            return lambda segment: 15
        for word in needed:
            bits[word] = bits.get(word, 0) | bit
    if ahocorasick is None:
        any_of = [(bit, re.compile("|".join(re.escape(w) for w, b in bits.items() if b & bit))) for bit in (1, 2, 4, 8)]
        search = lambda low: sum(bit for bit, p in any_of if p.search(low))
    else:
        automaton = ahocorasick.Automaton()
        for word, bit in bits.items():
            automaton.add_word(word, bit)
        automaton.make_automaton()

        def search(low: str) -> int:
            found = 0
            for _, bit in automaton.iter(low):
                found |= bit
            return found

    return lambda segment: search(segment.lower() if segment.isascii() else segment.translate(_PLAIN).lower())


kinds_of = _kinds()


def judge(segment: str, words: list[str] | None = None) -> tuple[str | None, bool]:
    """(reason why this line or sentence is residue, or None; whether repetition on several hosts alone would make it so)."""
    words = WORD.findall(segment.lower()) if words is None else words
    n = len(words)
    kinds = kinds_of(segment)
    if _PUNCTUATION.search(segment) and _PLACEHOLDER.search(segment):
        return "placeholder", False
    if kinds & 1 and _INSTRUCTION.search(segment):
        return "instruction", False
    if kinds & 2 and _FILLER.search(segment):
        return "filler", False
    if n >= 2 and not _LATIN_ONLY.isdisjoint(words) and sum(w in _LATIN for w in words) >= 0.6 * n:
        return "filler", False
    if n >= 3 and not _KEYBOARD.isdisjoint(words) and sum(w in _KEYBOARD for w in words) >= 0.6 * n:
        return "filler", False
    if n >= LOW_LEAST and len(set(words)) <= LOW_RICHNESS * math.sqrt(n) and not _tabular(segment, words):
        return "filler", False
    if not n:
        return None, False
    about = sum(w in _FAULT_SET for w in words) / n
    if n <= MOST_WORDS:
        if kinds & 8 and _SCRIPT.search(segment) and _NEED.search(segment) and (n <= 7 or _PLACE.search(segment)):
            return "script notice", False
        if kinds & 4 and (n <= 7 or about >= 0.2) and _FAULT.search(segment):
            return "error message", False
    return None, n >= 3 and about >= ABOUT


def _tabular(segment: str, words: list[str]) -> bool:
    """A table row, or a segment that is mostly numbers."""
    return segment.startswith("|") or 2 * sum(w.isdigit() for w in words) > len(words)


def _mask(segment: str) -> int:
    """64 bits of a segment without its numbers and case."""
    low = segment.lower()
    if DIGIT.search(low):
        low = MASK.sub("0", low)
    return int.from_bytes(hashlib.blake2b(low.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


#: Bits of a segment: the detectors flag it; its words alone make it suspect; it shares no term with slug, title and the rest of the body.
SEED, WEAK, FREE = 1, 2, 4
_SEEN = pa.schema([("id", pa.string()), ("ver", pa.string()), ("host", pa.string()), ("reasons", pa.list_(pa.string())), ("masks", pa.list_(pa.int64())), ("bits", pa.list_(pa.int8()))])
_SEEN_DDL = "id string, ver string, host string, reasons array<string>, masks array<long>, bits array<tinyint>"


def _segments(seen: DataFrame, *columns: str | Column) -> DataFrame:
    """One row a segment: ``columns``, mask, seed, weak, apart."""
    has = lambda bit: F.col("s.bits").bitwiseAND(F.lit(bit).cast("tinyint")) != 0
    rows = seen.select(*columns, F.explode(F.arrays_zip("masks", "bits")).alias("s"))
    return rows.select(*[c for c in rows.columns if c != "s"], F.col("s.masks").alias("mask"), has(SEED).alias("seed"), has(WEAK).alias("weak"), has(FREE).alias("apart"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per record what the detectors say, and its masked segments with what host evidence needs."""
    for batch in batches:
        out: list[tuple] = []
        for key, ver, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            segments = [x.strip() for x in SEGMENT.split(text)]
            segments = [x for x in segments if x]
            words = {x: WORD.findall(x.lower()) for x in segments}
            content = [{w for w in found if len(w) > 3} for found in words.values()]
            host, _, path = key.partition(":")
            terms = set(WORD.findall(f"{path.partition('#')[0]} {title or ''}".lower()))
            once: set[str] = set()
            again = set(terms)
            for own in content:
                again |= once & own
                once |= own
            reasons: set[str] = set()
            masks, bits = [], []
            for (segment, found), own in zip(words.items(), content):
                reason, weak = judge(segment, found)
                if reason:
                    reasons.add(reason)
                masks.append(_mask(segment))
                bits.append((SEED if reason else 0) | (WEAK if weak else 0) | (FREE if again.isdisjoint(own) else 0))
            unwrapped = WRAPPED.sub(" ", HYPHENATED.sub("", text))
            if unwrapped != text:  # sentences that extraction broke over lines are judged whole as well
                for x in dict.fromkeys(SEGMENT.split(unwrapped)):
                    if x.strip() and x.strip() not in words:
                        reason, _ = judge(x.strip())
                        if reason:
                            reasons.add(reason)
            if len(segments) >= 3 and 2 * len(words) < len(segments) and not any(_tabular(x, found) for x, found in words.items()):
                reasons.add("repetition")
            out.append((key, ver, host, sorted(reasons), masks, bits))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEEN)], schema=_SEEN)


def table_rows(df: DataFrame, id_col: str, text_col: str = "text", title_col: str | None = None, kind: str = "record", version_col: str | None = "loaded_at") -> tuple[str, DataFrame]:
    """(kind, the columns that the scan reads) of a table of records."""
    title = F.col(title_col) if title_col else F.lit(None)
    ver = F.col(version_col).cast("string") if version_col else F.lit("")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(ver, F.lit("")).alias("ver"), title.cast("string").alias("title"), F.col(text_col).alias("text"))
    return kind, rows.where(F.col("id").isNotNull())


def segment_hosts(seen: DataFrame) -> DataFrame:
    """``(mask, hosts, apart, weak)`` of every masked segment: documents that hold it, and those of them whose record shares no term with it.

    A segment that a third of all records hold reaches the shuffle once per host and task.
    """
    by_host = _segments(seen, "host").groupBy("mask", "host").agg(F.max("apart").alias("apart"), F.max("weak").alias("weak"))
    return by_host.groupBy("mask").agg(F.count(F.lit(1)).alias("hosts"), F.count_if("apart").alias("apart"), F.max("weak").alias("weak"))


def host_evidence(seen: DataFrame) -> DataFrame:
    """``(kind, id, ver, mask)`` of the records whose segments are responses of several hosts; see the module's text, 2."""
    spread = segment_hosts(seen).where((F.col("hosts") >= HOSTS) & (F.col("apart") >= APART * F.col("hosts")))
    spread = materialize(spread.select("mask", "hosts", "weak"), "residue-spread")
    record = F.xxhash64("kind", "id", "ver").alias("record")
    parts = _segments(seen, record, "host").select("record", "host", "mask", "seed")
    held = materialize(parts.join(spread, "mask").select("record", "host", "mask", "seed", "weak", "hosts"), "residue-held")
    # records known to hold residue, and segments that joined; each round looks only at the holders of what joined last
    known = materialize(seen.where(F.size("reasons") > 0).select(record).distinct(), "residue-known")
    joined = materialize(held.where("weak AND NOT seed").select("mask").distinct(), "residue-joined")
    everything = joined
    while True:
        fresh = materialize(held.join(joined, "mask", "left_semi").select("record").distinct().join(known, "record", "left_anti"), "residue-fresh")
        known = materialize(known.unionByName(fresh), "residue-known")
        beside = held.where("NOT seed").join(known, "record", "left_semi").groupBy("mask", "host").agg(F.max("hosts").alias("hosts")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.max("hosts").alias("hosts"))
        more = beside.where((F.col("n") >= HOSTS) & (F.col("n") >= BESIDE * F.col("hosts"))).select("mask").join(everything, "mask", "left_anti")
        joined = materialize(more, "residue-joined")
        if joined.isEmpty():
            break
        everything = materialize(everything.unionByName(joined), "residue-masks")
    exploded = seen.select("kind", "id", "ver", F.explode("masks").alias("mask"))
    return exploded.join(everything, "mask", "left_semi")


def find_residue(df: DataFrame, id_col: str, text_col: str = "text", title_col: str | None = None, kind: str = "record", version_col: str | None = "loaded_at") -> DataFrame:
    """``(record_kind, record_id, reasons)`` of the records whose text holds residue anywhere, once each.

    ``id_col`` is an address ``host:slug/path#n``; ids of another form have themselves as host and no slug. Null
    ids, and null or empty texts, are no case. Whole texts are read. Of a re-delivered id only the rows of the latest
    version count (of rows of equal version any). An empty table gives an empty result; other columns are ignored.
    """
    return _residue([table_rows(df, id_col, text_col, title_col, kind, version_col)])


def scan(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """What the scan says of every record, written once: ``kind, id, ver, host, reasons, segments``."""
    seen = None
    for kind, rows in tables:
        part = rows.where(F.col("text") != "").mapInArrow(_scan, _SEEN_DDL).withColumn("kind", F.lit(kind))
        seen = part if seen is None else seen.unionByName(part)
    return materialize(seen, "residue")


def _residue(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    seen = scan(tables)
    found = seen.where(F.size("reasons") > 0).select("kind", "id", "ver", F.explode("reasons").alias("reason"))
    found = found.unionByName(host_evidence(seen).select("kind", "id", "ver", F.lit("repeated on several hosts").alias("reason")))
    found = found.groupBy("kind", "id", "ver").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    newest = None
    for kind, rows in tables:
        last = rows.groupBy("id").agg(F.max("ver").alias("ver")).withColumn("kind", F.lit(kind))
        newest = last if newest is None else newest.unionByName(last)
    return found.join(newest, ["kind", "id", "ver"], "left_semi").select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "reasons")


def residue_records(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """The residue of both record kinds; their host evidence is counted together."""
    return _residue([table_rows(chunks, "chunk_id", kind="chunk"), table_rows(sections, "section_id", title_col="title", kind="section")])
