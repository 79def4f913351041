"""Functions registered for SQL: what built-ins cannot express."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from opgraph.functions.text import _decomposed
from opgraph.operators.chunking import windows


@udtf(returnType="n int, start int, end int, text string")
class TextWindows:
    """Overlapping windows of a text's words: ``SELECT * FROM text_windows('...')``."""

    def eval(self, text: str):
        tokens = (text or "").split()
        for i, (a, b) in enumerate(windows(tokens)):
            yield i, a, b, " ".join(tokens[a:b])


def register(spark: SparkSession) -> None:
    """``nfkd(text)`` (Arrow), the SQL function ``name_norm(text)`` over it, and the table function ``text_windows(text)``."""
    spark.udf.register("nfkd", _decomposed)
    spark.udtf.register("text_windows", TextWindows)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION name_norm(t STRING) RETURNS STRING RETURN trim(regexp_replace(lower(nfkd(coalesce(t, ''))), '[^a-z0-9]+', ' '))")
