"""Intermediate tables in the shared folder that the cluster names.

A table that several later steps read, or that ends a long lineage, is written
as Parquet under ``spark.checkpoint.dir`` and read back, so it survives lost
executors.  ``release`` removes such folders as soon as their readers are
done; what is left goes when the driver ends (``LEXIFLOW_KEEP_INTERMEDIATE=1``
keeps everything).
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir

_WRITTEN: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared scratch area, removed at the end."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, name: str = "tmp") -> DataFrame:
    """Write ``df`` and read it back.  The schema is handed on, so an empty
    table needs no footer and no inference job runs."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*paths: str) -> None:
    """Delete scratch folders (best effort; a remote session has no file API)."""
    for path in paths:
        spark = _WRITTEN.pop(path, None)
        if spark is None:
            continue
        try:
            sc = spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - best effort
            pass


def table_exists(spark: SparkSession, path: str) -> bool:
    """True if a Parquet table can be read at ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


@atexit.register
def _cleanup() -> None:
    if not os.environ.get("LEXIFLOW_KEEP_INTERMEDIATE"):
        release(*list(_WRITTEN))
