"""Session factory and table access.

Nothing here changes cluster settings of a session that already exists: a cluster's own shuffle,
broadcast and memory settings win, the values below are only for sessions that this module starts.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


@dataclass(frozen=True)
class Folders:
    """Places below one root: delivered files, extracted records, the graph's tables, caches, results."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name not in ("files", "records", "tables", "cache", "results"):
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{name}"


def get_or_create(master: str | None = None, app: str = "opgraph", **conf: str) -> SparkSession:
    """The running session, or a new one on ``master`` (default: ``local[$BENCH_CPUS or 8]``)."""
    builder = SparkSession.builder.appName(app)
    if SparkSession.getActiveSession() is None:
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        for key, value in {**LOCAL_DEFAULTS, **conf}.items():
            builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data directory; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
