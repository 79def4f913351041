"""Read-only ad-hoc queries: the parsed plan is checked before anything runs, results are capped and made JSON-safe."""

from __future__ import annotations

import datetime
import decimal
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

ROW_CAP, TIMEOUT_S, MAX_STRING, MAX_VECTOR = 200, 30, 4000, 50
#: Classes of a parsed plan that only read.
ALLOWED = frozenset("""Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith
OneRowRelation UnresolvedInlineTable UnresolvedHaving UnresolvedSubqueryColumnAliases Generate LateralJoin WithWindowDefinition Window Pivot Unpivot UnresolvedHint CTERelationDef WithCTE
UnresolvedOrderBy Deduplicate Sample ResolvedInlineTable LocalRelation Range UnresolvedTableValuedFunction UnresolvedCTERelation UnionLoop UnionLoopRef""".split())
FORBIDDEN = re.compile(r"(?i)\b(reflect|java_method|try_reflect|read_files|current_user|session_user|raise_error|assert_true)\s*\(")


class Rejected(ValueError):
    """A query that is not a plain read of registered views."""


def _walk(node) -> Iterator:
    yield node
    for kind in ("children", "innerChildren"):
        items = getattr(node, kind)().iterator()
        while items.hasNext():
            child = items.next()
            if hasattr(child, "children"):
                yield from _walk(child)


def check(spark: SparkSession, sql: str, views: set[str] | None = None) -> None:
    """Raise :class:`Rejected` unless the parsed plan holds only allowed nodes over ``views`` (default: temp views)."""
    if FORBIDDEN.search(sql):
        raise Rejected("function not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Rejected(f"not valid: {str(e).splitlines()[0][:300]}") from None
    known = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary} if views is None else {v.lower() for v in views}
    text = plan.toString()
    local = {m.lower() for m in re.findall(r"(?i)(?:\bwith\b(?:\s+recursive)?|,)\s*`?(\w+)`?(?:\s*\([^)]*\))?\s+as\s*\(", sql)}
    for node in _walk(plan):
        name = node.getClass().getSimpleName()
        if name not in ALLOWED:
            raise Rejected(f"{name} is not allowed: only reads are")
    for parts in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", text):
        relation = parts.replace(" ", "").lower().replace(",", ".")
        if relation not in known and relation not in local:
            raise Rejected(f"unknown table {relation}")
    for parts in re.findall(r"(?i)\bfrom\s+(\w+)\.`", sql):
        raise Rejected(f"{parts} files cannot be read")


def to_json(value):
    """Vectors become a note, long strings are cut, times become ISO text, rows become dicts."""
    if isinstance(value, str):
        return value if len(value) <= MAX_STRING else f"{value[:MAX_STRING]}… [{len(value) - MAX_STRING} more chars]"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if hasattr(value, "asDict"):
        return {k: to_json(v) for k, v in value.asDict().items() if k != "embedding"}
    if isinstance(value, dict):
        return {k: to_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        if len(value) > MAX_VECTOR and all(isinstance(v, float) for v in value):
            return f"<vector of {len(value)} floats>"
        return [to_json(v) for v in value]
    return value


def graph_query(spark: SparkSession, query: str, params: dict | None = None, views: set[str] | None = None, timeout: int = TIMEOUT_S) -> dict:
    """``{columns, rows, row_count[, truncated]}`` of a read-only query, SQL or a pattern query, or ``{error}``."""
    import threading

    from opgraph.operators.patterns import is_pattern, to_sql

    tag = f"opgraph-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout, spark.interruptTag, [tag])
    try:
        sql = to_sql(query) if is_pattern(query) else query
        check(spark, sql, views)
        spark.addTag(tag)
        timer.start()
        df = spark.sql(sql, args=params or {})
        rows = df.limit(ROW_CAP + 1).collect()
    except Exception as e:
        return {"error": str(e).splitlines()[0][:500] if str(e) else type(e).__name__}
    finally:
        timer.cancel()
        spark.removeTag(tag)
    out = {"columns": df.columns, "rows": [{c: to_json(v) for c, v in zip(df.columns, r)} for r in rows[:ROW_CAP]], "row_count": min(len(rows), ROW_CAP)}
    if len(rows) > ROW_CAP:
        out["truncated"] = f"only the first {ROW_CAP} rows; aggregate or add a limit"
    return out
