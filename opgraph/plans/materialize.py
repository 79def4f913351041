"""Cutting lineage with written tables in the cluster's shared folder.

Plans that read an intermediate result several times write it once as Parquet below
``spark.checkpoint.dir``. The files live on storage that all executors share, so that a lost executor
costs only the tasks it was running. A local folder is used only where the session names none and runs in one process;
on a cluster without the setting, writing raises.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one, set once, where that is unset."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(spark, "_opgraph_dir", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="opgraph-")
        atexit.register(shutil.rmtree, known, True)
        spark._opgraph_dir = known
    return f"file://{known}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has no lineage beyond its files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables written so far; call it when their readers are done."""
    _remove()


def _remove() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone; the cluster cleans its shared folder itself
            return
