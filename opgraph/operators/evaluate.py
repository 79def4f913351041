"""Evaluation of retrieval and of transcripts."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opgraph.functions.text import EMAIL, PHONE


def score_retrieval(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Per question: recall of expected projects, type hit, rank of the first hit right in all respects, reciprocal rank, pass.

    ``hits``: question_id, rank, project_id, type, subtype, scope. ``expected``: question_id, projects (array), types (array), scope.
    Recall is null without expected projects; empty arrays and a null scope ask for nothing.
    """
    j = expected.join(hits, "question_id", "left")
    right_project = (F.size("projects") == 0) | F.array_contains("projects", F.col("project_id"))
    right_type = (F.size("types") == 0) | F.array_contains("types", F.col("type")) | F.array_contains("types", F.col("subtype"))
    right_scope = F.col("want_scope").isNull() | (F.col("scope") == F.col("want_scope"))
    j = j.withColumn("joint", F.coalesce(right_project & right_type & right_scope & F.col("rank").isNotNull(), F.lit(False)))
    out = j.groupBy("question_id").agg(
        F.first("projects").alias("projects"), F.collect_set("project_id").alias("found"), F.max(F.coalesce(right_type & F.col("rank").isNotNull(), F.lit(False))).alias("type_hit"), F.min(F.when(F.col("joint"), F.col("rank"))).alias("joint_rank"))
    recall = F.when(F.size("projects") > 0, F.size(F.array_intersect("projects", "found")) / F.size("projects"))
    return out.select("question_id", recall.alias("recall"), "type_hit", "joint_rank", F.coalesce(1 / F.col("joint_rank"), F.lit(0.0)).alias("rr"), (F.coalesce(recall, F.lit(1.0)) == 1.0).__and__(F.col("joint_rank").isNotNull()).alias("passed"))


def summary(scores: DataFrame, by: str | None = None) -> DataFrame:
    grouped = scores.groupBy(by) if by else scores.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.sum(F.col("passed").cast("long")).alias("passed"))


def size_histogram(rows: DataFrame, size: str, step: int, most: int) -> DataFrame:
    """``(width_bucket, n)``: rows by size; 0 holds sizes of 0, bucket b sizes in (step * (b - 1), step * b], the last one all greater ones."""
    bucket = F.when(F.col(size) <= 0, 0).otherwise(F.least(F.lit(most), F.ceil(F.col(size) / step).cast("int"))).cast("int")
    return rows.groupBy(bucket.alias("width_bucket")).agg(F.count(F.lit(1)).alias("n"))


def passes(scores: DataFrame, by: str = "category") -> DataFrame:
    """``(category, n, passed, cost)`` with one row of totals (null category): what a run of questions reached and cost."""
    return scores.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("long")).alias("passed"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"))


def payload_error(output: Column) -> Column:
    """The error that a call's output states, or null."""
    return F.get_json_object(output, "$.error")


def tool_name(name: Column) -> Column:
    """A tool's name without the prefix of its server."""
    return F.regexp_replace(name, r"^mcp__[^_]+(?:_[^_]+)*__", "")


def read_trace(lines: DataFrame, questions: DataFrame, key: str = "file") -> DataFrame:
    """``(file, question)``: from the meta record on the first line of a trace, else from the question whose id is the file's stem."""
    first = lines.where(F.col("line") == 0).select(key, F.get_json_object("value", "$.question").alias("_q"))
    stem = F.regexp_replace(key, r"\.[^.]*$", "")
    known = questions.select(F.col("id").alias("_id"), F.col("question").alias("_known"))
    return first.join(known, stem == F.col("_id"), "left").select(key, F.coalesce("_q", "_known").alias("question"))


def save_trace(path: str, question: str, lines: list[str], secrets: dict[str, str] | None = None) -> int:
    """Write a trace of one question: a meta line, then the scrubbed stream; returns the lines written."""
    from pathlib import Path

    kept = [json.dumps({"question": scrub(question, secrets)}, ensure_ascii=False), *(scrub(x, secrets) for x in lines)]
    Path(path).write_text("\n".join(kept) + "\n")
    return len(kept)


def score_answers(answers: DataFrame) -> DataFrame:
    """Route, ids, facts and forbidden claims of answers.

    Columns: question_id, answer, tools (array), errors (int), expect_route, expect_facts, must_not (arrays of arrays: any of),
    expect_ids (array). Plain strings match case-insensitively; ``re:`` patterns by case.
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    hit = lambda p: F.when(F.startswith(p, F.lit("re:")), F.rlike(F.coalesce("answer", F.lit("")), F.substring(p, F.lit(4), F.lit(10_000)))).otherwise(F.contains(low, F.lower(p)))
    any_of = lambda alternatives: F.exists(alternatives, hit)
    route = F.forall("expect_route", lambda alt: F.arrays_overlap(alt, F.col("tools")))
    ids = F.forall("expect_ids", lambda i: F.contains(low, F.lower(i)))
    facts = F.forall("expect_facts", any_of)
    clean = ~F.exists("must_not", any_of)
    out = answers.select("question_id", route.alias("route"), ids.alias("ids"), facts.alias("facts"), clean.alias("clean"), (F.coalesce("errors", F.lit(0)) == 0).alias("no_errors"))
    return out.withColumn("passed", F.col("route") & F.col("ids") & F.col("facts") & F.col("clean") & F.col("no_errors"))


EVENT = "type string, subtype string, session_id string, result string, total_cost_usd double, duration_ms long, is_error boolean, message struct<content:array<struct<type:string,id:string,name:string,input:string,text:string,tool_use_id:string,content:string,is_error:boolean>>>"


def parse_events(lines: DataFrame, key: str = "file", text: str = "value", at: str = "line") -> DataFrame:
    """Typed events of transcripts, one JSON object a line; other and malformed lines are skipped."""
    kept = lines.where(F.ltrim(F.col(text)).startswith("{"))
    parsed = kept.select(key, at, F.from_json(text, EVENT).alias("e")).where(F.col("e.type").isNotNull())
    return parsed.select(key, at, "e.*")


def tool_calls(events: DataFrame, key: str = "file", at: str = "line") -> DataFrame:
    """``(file, line, id, tool, input, output, error)``: each call with its result, null where it has none."""
    items = events.where(F.col("type").isin("assistant", "user")).select(key, at, F.explode("message.content").alias("c"))
    use = items.where("c.type = 'tool_use'").select(key, at, F.col("c.id").alias("id"), F.col("c.name").alias("tool"), F.col("c.input").alias("input"))
    res = items.where("c.type = 'tool_result'").select(key, F.col("c.tool_use_id").alias("id"), F.col("c.content").alias("output"), F.coalesce("c.is_error", F.lit(False)).alias("error"))
    return use.join(res.dropDuplicates([key, "id"]), [key, "id"], "left").select(key, at, "id", tool_name(F.col("tool")).alias("tool"), "input", "output", (F.coalesce("error", F.lit(False)) | F.coalesce(payload_error(F.col("output")).isNotNull(), F.lit(False))).alias("error"))


def routes(calls: DataFrame, key: str = "file", at: str = "line", tool: str = "tool") -> DataFrame:
    """``(file, route)``: consecutive equal tools as ``a ×2 → b``: gaps and islands, then an ordered join of strings."""
    order = Window.partitionBy(key).orderBy(at)
    change = (F.lag(tool).over(order).isNull() | (F.lag(tool).over(order) != F.col(tool))).cast("int")
    runs = calls.withColumn("_c", change).withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(key, "run", tool).agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") > 1, F.concat(F.col(tool), F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col(tool))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", label.alias("l")))), lambda x: x["l"]), " → ").alias("route"))


def scrub(text: str, secrets: dict[str, str] | None = None, home: str | None = None) -> str:
    """Secrets of six characters or more, the home directory, e-mail addresses and phone numbers replaced."""
    for name, value in sorted((secrets or {}).items(), key=lambda x: -len(x[1])):
        if len(value) >= 6:
            text = text.replace(value, f"<{name}>")
    home = home if home is not None else os.path.expanduser("~")
    text = text.replace(home, "~") if len(home) > 1 else text
    return re.sub(PHONE, "[phone redacted]", re.sub(EMAIL, "[email redacted]", text))


def report(title: str, calls: list[dict], answer: str | None, most: int = 220) -> str:
    """A readable trace: numbered calls with clipped input and output, then the answer."""
    cut = lambda s: s if len(s) <= most else f"{s[:most]}… [{len(s) - most} more chars]"
    lines = [f"# {title}", ""]
    for i, c in enumerate(calls, 1):
        lines += [f"{i}. {c['tool']}{' (error)' if c.get('error') else ''}", f"   in:  {cut(c['input'] if isinstance(c['input'], str) else json.dumps(c['input'], ensure_ascii=False))}", f"   out: {cut(str(c.get('output') or ''))}"]
    return "\n".join([*lines, "", answer or "(no answer)"])


def run_questions(questions: list[dict], ask, jobs: int = 3) -> list[dict]:
    """``ask(question)`` for every question on ``jobs`` driver threads, in the order given; an exception becomes ``{"error"}``."""
    from concurrent.futures import ThreadPoolExecutor

    def one(q: dict) -> dict:
        try:
            return {"id": q["id"], "payload": ask(q)}
        except Exception as e:
            return {"id": q["id"], "payload": {"error": f"{type(e).__name__}: {e}"[:500]}}

    with ThreadPoolExecutor(max(1, jobs)) as pool:
        return list(pool.map(one, questions))


def oracle_filters(question: dict, k: int = 8) -> dict:
    """Retrieval arguments taken from the answer key: project ids (grouped if several), section types and scope."""
    projects = [p for p in question.get("expect_ids") or [] if re.fullmatch(r"P\d{6,7}", p)]
    out: dict = {"k": k}
    if projects:
        out["project_ids"] = projects
    if len(projects) > 1:
        out["per_project_k"] = max(1, k // len(projects))
    if question.get("expect_section_types"):
        out["section_types"] = question["expect_section_types"]
    if question.get("expect_scope"):
        out["scope"] = question["expect_scope"]
    return out


def retrieval_page(questions: DataFrame, context: DataFrame, k: int = 8, jobs: int = 3) -> str:
    """A page with the scores of a question file, unfiltered and with filters from the answer key. Files hold a few dozen questions."""
    from opgraph.operators.retrieve import retrieve
    from opgraph.sources.sinks import results_page

    items = [r.asDict(recursive=True) for r in questions.collect()]
    scores = []
    for mode in ("retrieval", "oracle"):
        ask = lambda q, mode=mode: retrieve(context, q["question"], embed=True, **(oracle_filters(q, k) if mode == "oracle" else {"k": k}))
        for item, got in zip(items, run_questions(items, ask, jobs)):
            hits = got["payload"].get("hits", [])
            projects = [p for p in item["expect_ids"] if re.fullmatch(r"P\d{6,7}", p)]
            types, scope = item["expect_section_types"], item["expect_scope"]
            right = lambda h: (not projects or h["project_id"] in projects) and (not types or h["section_type"] in types or h["section_subtype"] in types) and (not scope or h["scope"] == scope)
            recall = len({h["project_id"] for h in hits} & set(projects)) / len(set(projects)) if projects else None
            joint = next((h["rank"] for h in hits if right(h)), None)
            scores.append({"id": item["id"], "topic": item["topic"], "mode": mode, "recall": recall, "joint_rank": joint, "passed": joint is not None and recall in (None, 1.0)})
    return results_page(scores)
