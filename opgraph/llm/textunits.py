"""The token of this project's size rules, on both sides of the Arrow border."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One maximal run of letters and digits, or any other single character that is not white space.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
TOKEN_RE = regex.compile(TOKEN)


def count_tokens(text: Column) -> Column:
    """Tokens of a text, counted in the JVM over the whole text; null gives null."""
    return F.regexp_count(text, F.lit("(?U)" + TOKEN))


def at_least_tokens(text: Column, n: int) -> Column:
    """A cheap superset of the texts with ``n`` tokens or more: every token has a character."""
    return F.length(text) >= n
