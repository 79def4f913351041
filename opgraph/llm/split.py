"""Problem 4 - splitting oversized texts at natural boundaries, by dynamic programming.

A text of more than ``limit`` tokens becomes pieces of at most ``limit`` tokens of which neighbours share
``overlap`` tokens. Where the pieces end is chosen by dynamic programming over boundary positions: the sum
of a cut penalty (paragraph < line < sentence < clause < word < inside a word run) and a size-imbalance term
is minimal. Token counting and the choice of texts run in the JVM; only texts over the limit reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opgraph.llm.textunits import TOKEN_RE, at_least_tokens, count_tokens
from opgraph.plans.keys import latest

LIMIT = 400
OVERLAP = 50
#: Penalty of a cut after a token, by what follows it.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 0.0, 0.05, 0.15, 0.6, 2.0, 6.0
#: Weight of the squared unused share of a piece.
BALANCE = 0.5
#: Where natural boundaries are further apart than this many tokens, all positions between them are tried.
GAP = 40

_SENTENCE_END = regex.compile(r"[.!?…。][\"'”’)\]]*$")
_CLAUSE_END = set(",;:|)]–—")


def cut_penalties(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Penalty of ending a piece after each token (its gap to the next token decides)."""
    out = np.full(len(starts), WORD)
    glued = ends[:-1] == starts[1:]
    out[:-1][glued] = INSIDE
    for i in np.flatnonzero(~glued):
        end = int(ends[i])
        gap = text[end : int(starts[i + 1])]
        last = text[end - 1]
        if "\n" in gap:
            out[i] = PARAGRAPH if gap.count("\n") > 1 else LINE
        elif _SENTENCE_END.search(text, max(0, end - 4), end):
            out[i] = SENTENCE
        elif last in _CLAUSE_END:
            out[i] = CLAUSE
    return out


def choose_cuts(penalty: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges (start, end) of the pieces of least total cost; one range if the text fits.

    Every piece but the first starts ``overlap`` tokens before its predecessor's end, and every
    piece brings at least one new token.
    """
    n = len(penalty)
    if n <= limit:
        return [(0, n)]
    natural = np.flatnonzero(penalty[:-1] < WORD) + 1
    bounds = np.concatenate(([0], natural, [n]))
    spots = [natural]
    for left, right in zip(bounds[:-1], bounds[1:]):
        if right - left > min(GAP, (limit - overlap) // 2):
            spots.append(np.arange(left + 1, right))
    at = np.unique(np.concatenate(spots))
    at = at[(at > overlap) & (at < n)]
    ends = np.concatenate((at, [n]))
    cost = np.full(len(ends), np.inf)
    back = np.full(len(ends), -1)
    price = np.concatenate((penalty[at - 1], [0.0]))
    step = limit - overlap
    lowest = np.searchsorted(ends, ends - step)
    for j, end in enumerate(ends):
        if end <= limit:
            cost[j] = price[j] + BALANCE * (1 - end / limit) ** 2
        low = lowest[j]
        if low < j:
            sizes = end - ends[low:j] + overlap
            total = cost[low:j] + BALANCE * (1 - sizes / limit) ** 2
            best = int(np.argmin(total))
            if total[best] + price[j] < cost[j]:
                cost[j], back[j] = total[best] + price[j], low + best
    cuts, j = [], len(ends) - 1
    while j >= 0:
        cuts.append(int(ends[j]))
        j = int(back[j])
    cuts.reverse()
    return [(0 if i == 0 else cuts[i - 1] - overlap, end) for i, end in enumerate(cuts)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(char_start, char_end, tokens, shared) of every piece; white space between tokens stays with the left one.

    The first piece without, and every later piece after, its ``shared`` first tokens give the text again.
    """
    spans = [m.span() for m in TOKEN_RE.finditer(text)]
    starts, ends = np.array([s for s, _ in spans], dtype=np.int64), np.array([e for _, e in spans], dtype=np.int64)
    pieces = choose_cuts(cut_penalties(text, starts, ends) if spans else np.zeros(0), limit, overlap)
    out = []
    for i, (a, b) in enumerate(pieces):
        begin = 0 if i == 0 else int(starts[a])
        finish = len(text) if b == len(spans) else int(starts[b])
        out.append((begin, finish, b - a, 0 if i == 0 else pieces[i - 1][1] - a))
    return out


_PIECES = "record_kind string, record_id string, piece int, pieces int, text string, tokens int, shared int, char_start long, char_end long, boundary string"


def _split(limit: int, overlap: int):
    def boundary(text: str, end: int) -> str:
        tail = text[max(0, end - 80) : end]
        body = tail.rstrip()
        if end == len(text):
            return "end"
        if "\n" in tail[len(body) :]:
            return "paragraph" if tail[len(body) :].count("\n") > 1 else "line"
        if _SENTENCE_END.search(body):
            return "sentence" if len(body) < len(tail) else "inside"
        if len(body) == len(tail):
            return "inside"
        return "clause" if body and body[-1] in _CLAUSE_END else "word"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _PIECES.split(", ")]
        for batch in batches:
            rows = []
            for kind, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = split_text(text, limit, overlap)
                rows += [(kind, key, i, len(pieces), text[a:b], t, s, a, b, boundary(text, b)) for i, (a, b, t, s) in enumerate(pieces)]
            if rows:
                cols = list(zip(*rows))
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def split_oversized(
    df: DataFrame, id_col: str, text_col: str = "text", kind: str = "record", version_col: str | None = "loaded_at",
    limit: int = LIMIT, overlap: int = OVERLAP,
) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens: kind, id, piece number, text, sizes, offsets, boundary.

    Whole texts are counted, whatever a size column says. Null and empty texts, null ids and texts of at most
    ``limit`` tokens give no piece. A re-delivered id counts once, with its latest ``version_col``: an id whose newest text
    fits gives no piece whatever older texts were (of several long texts of the newest version the greatest counts). A text without any boundary is cut between tokens, never inside
    one. ``overlap`` must be less than ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(version_col).alias("ver") if version_col else F.lit(0).alias("ver"))
    # 128 bits stand for an id, as ids are long; versions and long texts meet without another shuffle
    rows = rows.where(F.col("id").isNotNull()).withColumn("key", F.struct(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(7), F.col("id")).alias("h2")))
    newest = rows.groupBy("key").agg(F.max("ver").alias("newest"))
    long = rows.where(at_least_tokens(F.col("text"), limit + 1)).where(count_tokens(F.col("text")) > limit)
    long = latest(long.withColumn("at", F.col("ver")), "key", ["at", "id", "text"], "ver").join(newest, "key")
    long = long.where(F.col("at").eqNullSafe(F.col("newest"))).select(F.lit(kind).alias("record_kind"), "id", "text")
    # cutting costs far more than its bytes tell: a fixed number of partitions, which are not coalesced
    long = long.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return long.mapInArrow(_split(limit, overlap), _PIECES).where(F.col("pieces") > 1)


def split_records(chunks: DataFrame, sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of all chunks (of every kind) and sections over the limit."""
    return split_oversized(chunks, "chunk_id", kind="chunk", limit=limit, overlap=overlap).unionByName(
        split_oversized(sections, "section_id", kind="section", limit=limit, overlap=overlap))


def oversized_records(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """``(record_kind, record_id)`` of every record that :func:`split_records` cuts, once."""
    return split_records(chunks, sections).where(F.col("piece") == 0).select("record_kind", "record_id")
