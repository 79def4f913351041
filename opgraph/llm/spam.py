"""Problem 8 - keyword-stuffed and link-list pages, by perplexity under a prose-trained n-gram model.

1. Every line and sentence becomes, once, a sequence of numbers: function words (kept as they are) and word classes
   (case, ending, digits, links, tags, separators). The sequences are written; all that follows reads them, not the texts.
2. Class trigrams of prose-like sentences are counted over all documents. The alphabet of classes is fixed,
   so the table of counts has a bound that does not grow with the data; it is the model.
3. The model has a document part: content words are predicted from the rest of the same document (a cache of its words, with
   absolute discounting). A segment is not prose if its class sequence is abnormally improbable (lists, menus, tags:
   perplexity too high) or if its content words are abnormally predictable (repeated keywords and phrases, within a
   segment or across segments: perplexity too low). Both limits come from the distribution over all prose-like sentences.
4. A document is flagged if such segments hold most of its words. Table rows, abbreviation lists and numbered
   references are set aside and count neither way.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opgraph.plans.materialize import materialize

# ---- fixed values: function words of the four languages, separators --------------------------------
FUNCTION_WORDS = frozenset((
    "the of in to and a an for is was are were by with on at as from that this it be or not which will has have had its their they who but if than when until before after since so may must can more most no each both into over under about also been would should there these those between during without within against "
    "le la les l des du de d et un une pour par que qu qui dans au aux sur est sont a été ont s se en ce cette ces il elle ils ne pas plus ou mais avec sous entre comme leur leurs son sa ses y selon alors faut dont "
    "el los las del y con para una su es o al por lo como más pero sus fue están si no hay sin sobre entre cuando porque desde hasta ya "
    "do da dos das os as no na nos nas um uma com ao à às pelo pela são foi mas se em entre sobre até também não ser tem que"
).split())
ENDINGS = ("tion", "ment", "ing", "ness", "ción", "ção", "eur", "ous", "ive", "ate", "ise", "ize", "ed", "er", "ly", "al", "ar", "ir", "es", "s", "e", "a", "o")
SEPARATORS = frozenset("|·•»›>/;,-–—")
# ----------------------------------------------------------------------------------------------------
TOKEN = re.compile(r"https?://\S+|www\.\S+|\]\([^)\s]*\)|#\w+|[^\W\d_]+|\d+(?:[.,]\d+)*\w*|\S")
SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")
NUMBERED = re.compile(r"^\s*(?:\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
#: Sentences that extraction broke over lines.
HYPHENATED = re.compile(r"-\n(?<=[^\W\d_A-Z]-\n)(?=[^\W\d_A-Z])")
WRAPPED = re.compile(r"\n(?:(?:(?<=[^\W\d_A-Z]\n)|(?<=[,;]\n))(?=[^\W\d_A-Z])|[ \t]+(?=\S))")
REFERENCE = re.compile(r"^\s*\[\d+\]\s(?!\s*(?:https?://\S+|www\.\S+)\s*$)")
#: A row of cells without figures and rules, as menus have them.
MENU = re.compile(r"[^\d]*[^\W\d_][^\d]*")
ACRONYM = re.compile(r"^\s*([A-Z][A-Z0-9]{1,9})\s*(?:[:–—-]\s*|\s)(.+)$")
#: Least words of a segment that is scored by itself; shorter ones are joined with their neighbours.
LEAST_WORDS = 5
#: Share of function words from which a sentence counts as prose-like for training.
PROSE_SHARE = 0.15
#: How far above the prose median, in median deviations, a segment's log-perplexity is abnormally high; how far below the median its predictability, on a log scale, is abnormally low.
HIGH, LOW = 8.0, 5.0
#: Words of the segments that are flagged, of all scored words, from which a document is flagged.
MOST = 0.5
#: Least content words of a segment whose predictability from its document is judged.
LEAST_CONTENT = 3
#: Weights of the document's words and of the uniform part in the prediction, and the vocabulary of the latter.
WORDS, UNIFORM, VOCABULARY = 0.8, 0.2, 20_000
#: Taken off every count of the document: what stands once more elsewhere in it does not yet make a word predictable.
DISCOUNT = 1
#: Lower limit where a table has no prose.
LOWEST = 5.0
START, STOP, URL, TAG, NUMBER, OTHER = "<s>", "</s>", "<url>", "<tag>", "<n>", "<x>"
ENDS = ".?!:"
CLASSES = [START, *sorted(FUNCTION_WORDS), STOP, URL, TAG, NUMBER, OTHER, *ENDS, *sorted(SEPARATORS), *(f"{case}~{e}" for case in "wCU" for e in ("", *ENDINGS))]
CODE = {c: i for i, c in enumerate(CLASSES)}
K = len(CLASSES)
#: Codes up to this one are function words.
FUNCTION = len(FUNCTION_WORDS)


def class_of(token: str) -> tuple[int, str | None]:
    """(class, content word or None) of a token as it stands."""
    if token.isalpha():
        low = token.lower()
        shout = token.isupper() and len(token) > 1
        if low in FUNCTION_WORDS and not shout:
            return CODE[low], None
        ending = next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "")
        return CODE[("U" if shout else "C" if token[0].isupper() else "w") + "~" + ending], low
    if len(token) > 1 and token[0] == "#":
        return CODE[TAG], token.lower()
    if token.startswith(("http://", "https://", "www.", "](")):
        return CODE[URL], None
    if token[0].isdigit():
        return CODE[NUMBER], None
    if token in SEPARATORS or token in ENDS:
        return CODE[token], None
    return CODE["." if token == "…" else OTHER], None


class _Known(dict):
    """Classes of the tokens met so far; past a bound they are worked out anew."""

    def __missing__(self, token: str) -> tuple[int, str | None]:
        found = class_of(token)
        if len(self) < 200_000:
            self[token] = found
        return found


def classes(segment: str, known: dict | None = None) -> tuple[list[int], list[str], int]:
    """(class codes, content words, function words) of a segment."""
    look = class_of if known is None else known.__getitem__
    found = [look(t) for t in TOKEN.findall(segment)]
    codes = [c for c, _ in found]
    return codes, [w for _, w in found if w is not None], len([c for c in codes if 0 < c <= FUNCTION])


def segments(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the parts of a document: ``aside`` for tables, abbreviations and references, else ``text``.

    Lines are cut into sentences; neighbouring short lines (menus, link lists) are joined until they can be scored.
    """
    out: list[tuple[str, str]] = []
    pending: list[str] = []
    size = 0
    lines = [x.strip() for x in WRAPPED.sub(" ", HYPHENATED.sub("", text)).split("\n")]
    tables = _tables(lines)
    for at, line in enumerate(lines):
        if not line:
            continue
        cells = at in tables
        acronym = ACRONYM.match(line)
        if cells or REFERENCE.match(line) or (acronym and _expands(acronym[1], acronym[2])):
            out.append(("aside", line))
            continue
        for part in SENTENCE.split(NUMBERED.sub("", line)):
            words = len(part.split())
            if pending or words < LEAST_WORDS:
                pending.append(part)
                size += words
                if size >= 3 * LEAST_WORDS:
                    out.append(("text", "\n".join(pending)))
                    pending, size = [], 0
            else:
                out.append(("text", part))
    if pending:
        out.append(("text", "\n".join(pending)))
    return out


def _tables(lines: list[str]) -> set[int]:
    """Lines that are rows of tables; a row of words that stands alone or is only repeated is a menu."""
    out: set[int] = set()
    block: list[int] = []
    for at, line in enumerate([*lines, "."]):
        if line.startswith("|") and line.endswith("|") and line.count("|") > 2:
            block.append(at)
        elif line:
            if len({lines[i] for i in block}) > 1 or (block and not MENU.fullmatch(lines[block[0]])):
                out.update(block)
            block = []
    return out


def _expands(acronym: str, expansion: str) -> bool:
    """The capitals of the expansion spell most of the acronym, in order."""
    letters = re.sub(r"\d", "", acronym).lower()
    words = re.findall(r"[^\W\d_]+", expansion)
    if not letters or not 2 <= len(words) <= 14 or len(words) > 2 * len(letters) + 2:
        return False
    initials = iter(w[0].lower() for w in words)
    return sum(c in initials for c in letters) >= max(2, 0.6 * len(letters))


def predictability(parts: list[list[str]]) -> list[float]:
    """Per segment the mean surprise of its content words, predicted from the rest of the document; NaN for too few words.

    Each word counts without its own occurrence, so a word that stands once or twice is predicted by the uniform part only.
    """
    number = defaultdict(count().__next__)
    words = np.fromiter((number[w] for part in parts for w in part), dtype=np.int64)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    out = np.full(len(parts), np.nan)
    if not len(words):
        return out.tolist()
    others = np.bincount(words)[words] - 1
    p = WORDS * np.maximum(others - DISCOUNT, 0) / max(len(words) - 1, 1) + UNIFORM / VOCABULARY
    total = np.concatenate(([0.0], np.cumsum(-np.log(p))))
    end = np.cumsum(sizes)
    enough = sizes >= LEAST_CONTENT
    out[enough] = (total[end] - total[end - sizes])[enough] / sizes[enough]
    return out.tolist()


_TOKENS = pa.schema([("id", pa.int64()), ("codes", pa.list_(pa.int16())), ("sizes", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("prose", pa.list_(pa.bool_())), ("teaches", pa.list_(pa.bool_())), ("own", pa.list_(pa.float64()))])
_TOKENS_DDL = "id long, codes array<short>, sizes array<int>, words array<int>, prose array<boolean>, teaches array<boolean>, own array<double>"


def sequences(text: str, known: dict | None = None) -> tuple[list[int], list[int], list[int], list[bool], list[bool], list[float]]:
    """(codes, sizes, words, prose, teaches, own) of the scored segments of a document; codes run on, each segment between two starts and a stop.

    ``prose`` marks the sentences that set the limits, ``teaches`` those that the trigrams are counted in: a repeated line teaches once a document.
    """
    codes, sizes, words, prose, teaches, contents = [], [], [], [], [], []
    seen: set[str] = set()
    for kind, part in segments(text):
        if kind == "aside":
            continue
        own, content, function = classes(part, known)
        n = len(content) + function
        size = n + own.count(CODE[URL]) + own.count(CODE[NUMBER])
        if not size:
            continue
        sentence = n >= LEAST_WORDS and function >= PROSE_SHARE * n and CLASSES[own[-1]] in ".?!"
        codes += [0, 0, *own, CODE[STOP]]
        sizes.append(len(own) + 3)
        words.append(size)
        prose.append(sentence)
        teaches.append(sentence and part not in seen and len(set(content)) > 0.6 * len(content))
        contents.append(content)
        seen.add(part)
    return codes, sizes, words, prose, teaches, predictability(contents)


def _sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Known()
    for batch in batches:
        rows = [sequences(text, known) for text in batch.column(1).to_pylist()]
        columns = zip(*rows) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(_TOKENS)[1:]))], schema=_TOKENS)


def trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all trigrams that do not end in a start, places of their last elements)."""
    wide = codes.astype(np.int64)
    at = np.flatnonzero(wide[2:] != 0) + 2
    return (wide[at - 2] * K + wide[at - 1]) * K + wide[at], at


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, at = trigrams(_flat(batch, "codes"))
        taught = np.repeat(_flat(batch, "teaches").astype(bool), _flat(batch, "sizes"))[at]
        values, counts = np.unique(grams[taught], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["gram", "n"])


class Model:
    """Interpolated class trigrams; unseen ones fall back to bigrams, single classes and a uniform floor."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.tri = grams[order], n[order].astype(np.float64)
        a, b, c = self.grams // (K * K), self.grams // K % K, self.grams % K
        self.uni, self.ctx, self.bi, self.after = np.zeros(K), np.zeros(K * K), np.zeros(K * K), np.zeros(K)
        np.add.at(self.uni, c, self.tri)
        np.add.at(self.ctx, a * K + b, self.tri)
        np.add.at(self.bi, b * K + c, self.tri)
        np.add.at(self.after, b, self.tri)
        self.total, self.kinds = max(1.0, self.tri.sum()), np.count_nonzero(self.uni) + 1

    def surprise(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mean negative log probability per class of every segment: the log of its perplexity."""
        grams, at = trigrams(codes)
        b, c = grams // K % K, grams % K
        place = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        tri = np.where(self.grams[place] == grams, self.tri[place], 0.0) if len(self.grams) else np.zeros(len(grams))
        p = 0.05 / self.kinds + 0.1 * self.uni[c] / self.total
        p += 0.35 * self.bi[b * K + c] / np.maximum(self.after[b], 1) + 0.5 * tri / np.maximum(self.ctx[grams // K], 1)
        cost = np.zeros(len(codes) + 1)
        cost[at + 1] = -np.log(p)
        total, end = np.cumsum(cost), np.cumsum(sizes)
        return (total[end] - total[end - sizes]) / (sizes - 2)


def _measure(model: Model):
    """Log-perplexity of every segment of every document."""
    parts = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _flat(batch, "sizes").astype(np.int64)
            surprise = model.surprise(_flat(batch, "codes"), sizes) if len(sizes) else np.zeros(0)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in batch.column(batch.schema.get_field_index("sizes"))])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(surprise)).cast(parts)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "words", "prose", "own")]
            yield pa.RecordBatch.from_arrays([*keep, lists], ["id", "words", "prose", "own", "surprise"])

    return run


def score_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", high: float = HIGH, low: float = LOW) -> DataFrame:
    """``(id, flagged, scored, surprise, is_spam)`` of every document with text, from whole texts.

    Null and empty texts, and texts without words, are never spam; null ids are dropped; repeated ids are scored
    row by row. Counts and the limits come from all documents; with no prose at all there is no upper limit and the lower
    one is that of a document of unrelated words. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where((F.col("text") != "") & F.col("id").isNotNull())
    tokens = materialize(rows.mapInArrow(_sequence, _TOKENS_DDL), "spam-tokens")
    grams = tokens.select("codes", "sizes", "teaches").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most K ** 3 rows of the fixed alphabet
    model = Model(grams.column("gram").to_numpy(), grams.column("n").to_numpy())
    # few numbers a segment are written, and both the limits and the verdict read them
    scored = materialize(tokens.select("id", "codes", "sizes", "words", "prose", "own").mapInArrow(_measure(model), "id long, words array<int>, prose array<boolean>, own array<double>, surprise array<double>"), "spam-scored")
    parts = scored.select("id", F.arrays_zip("words", "prose", "own", "surprise").alias("parts"))
    prose = parts.select(F.explode(F.filter("parts", lambda p: p["prose"])).alias("p"))
    at = lambda c: F.least(F.lit(1999), F.floor(c * 100)).cast("int")
    both = prose.select(F.lit(True).alias("high"), at(F.col("p.surprise")).alias("bin")).unionByName(prose.where(~F.isnan("p.own")).select(F.lit(False).alias("high"), at(F.log("p.own")).alias("bin")))
    bins = both.groupBy("high", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4,000 rows
    upper = threshold({r.bin / 100: r.n for r in bins if r.high}, high, math.inf)
    lower = math.exp(threshold({r.bin / 100: r.n for r in bins if not r.high}, -low, math.log(LOWEST)))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda s, p: s + p["words"])
    odd = lambda p: (p["surprise"] > upper) | (~F.isnan(p["own"]) & (p["own"] < lower))
    flagged, words = total(F.filter("parts", odd)), total(F.col("parts"))
    mean = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["surprise"] * p["words"])
    out = parts.select("id", flagged.cast("long").alias("flagged"), words.cast("long").alias("scored"), F.when(words > 0, mean / words).otherwise(0.0).alias("surprise"))
    return out.withColumn("is_spam", (F.col("scored") > 0) & (F.col("flagged") >= MOST * F.col("scored")))


def threshold(histogram: dict[float, int], deviations: float, without: float) -> float:
    """Median plus ``deviations`` median absolute deviations of a histogram; ``without`` if it is empty."""

    def median(weights: dict[float, int]) -> float:
        half, seen = sum(weights.values()) / 2, 0
        for value in sorted(weights):
            seen += weights[value]
            if seen >= half:
                return value
        return 0.0

    if not histogram:
        return without
    middle = median(histogram)
    spread: Counter[float] = Counter()
    for value, n in histogram.items():
        spread[abs(value - middle)] += n
    return middle + deviations * max(0.05, median(spread))


def spam_pages(df: DataFrame) -> DataFrame:
    """``(doc_id)`` of the flagged documents, once each."""
    return score_pages(df).where("is_spam").select(F.col("id").alias("doc_id")).distinct()
