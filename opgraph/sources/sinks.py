"""Sinks for people and for files: nested JSON per document, question-and-answer pages, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents_json(docs: DataFrame, sections: DataFrame, key: str = "document_hash") -> DataFrame:
    """``(key, json)``: a document with its sections, in order, as one JSON text. Sections of a document are bounded by the document."""
    inner = F.struct(*[F.col(c) for c in sections.columns if c != key])
    nested = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("order").alias("_o"), inner.alias("s")))).alias("l"))
    out = docs.join(nested.select(key, F.transform("l", lambda x: x["s"]).alias("sections")), key, "left")
    return out.select(key, F.to_json(F.struct(*out.columns)).alias("json"))


def write_documents(docs: DataFrame, sections: DataFrame, path: str) -> None:
    documents_json(docs, sections).select(F.col("json").alias("value")).write.mode("errorifexists").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Data sheet records as JSON lines, one a document."""
    records.write.mode("errorifexists").json(path)


def results_page(scores: list[dict], title: str = "Results") -> str:
    """Scores of questions as a readable page: a line each, then the totals. ``scores``: id, passed, recall, joint_rank, and any of mode, topic."""
    modes = sorted({s.get("mode", "") for s in scores})
    lines = [f"# {title}", "", "| id | topic | mode | result | recall |", "| --- | --- | --- | --- | --- |"]
    shown = lambda s: f"pass@{s['joint_rank']}" if s["passed"] else "fail"
    lines += [f"| {s['id']} | {s.get('topic') or ''} | {s.get('mode', '')} | {shown(s)} | {'n/a' if s['recall'] is None else format(s['recall'], '.2f')} |" for s in scores]
    for mode in modes:
        mine = [s for s in scores if s.get("mode", "") == mode]
        rr = sum(1 / s["joint_rank"] for s in mine if s["joint_rank"]) / len(mine)
        lines += ["", f"{mode or 'all'}: {sum(s['passed'] for s in mine)}/{len(mine)} passed, MRR {rr:.2f}"]
    return "\n".join(lines) + "\n"


def summary(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Counts and filled columns per group: the console summary of an extraction."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns]).orderBy(by)


def markdown_hits(payload: dict, most: int = 4, chars: int = 280) -> str:
    """A retrieval payload as a readable page: question, expansions, the first hits with clipped text."""
    if "error" in payload:
        return f"**error:** {payload['error']}\n"
    cut = lambda s: s if len(s) <= chars else f"{s[:chars]}…"
    lines = [f"## {payload['question']}", ""]
    lines += [f"*{a}*: {', '.join(e)}" for a, e in payload.get("expansions", {}).items()]
    for h in payload["hits"][:most]:
        lines += ["", f"{h['rank']}. **{h['project_id']}** {h.get('section_path') or ''} ({', '.join(h['matched_by'])}, {h['score']})", "", f"   {cut(' '.join((h['text'] or '').split()))}"]
    hidden = len(payload["hits"]) - most
    return "\n".join([*lines, "", f"… {hidden} more hits" if hidden > 0 else ""]).rstrip() + "\n"


def markdown_rows(result: dict, most: int = 10) -> str:
    """A query result as a table of at most ``most`` rows."""
    if "error" in result:
        return f"**error:** {result['error']}\n"
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    shown = [line(result["columns"]), line(["---"] * len(result["columns"])), *[line(r.values()) for r in result["rows"][:most]]]
    more = result["row_count"] - most
    return "\n".join([*shown, *([f"… {more} more rows"] if more > 0 else [])]) + "\n"
