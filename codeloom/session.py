"""Session helpers: shared scratch space, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the small side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
_KNOWN: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """Shared scratch folder of the session, one per application, deleted when it ends.

    The cluster names its parent in ``spark.checkpoint.dir``; without it a session on a
    cluster is refused, since executors do not share their machines' folders. Only in local
    mode (tests, one machine) a folder below the temporary directory takes its place.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "codeloom-scratch")
    own = f"{base.rstrip('/')}/codeloom-{context.applicationId}"
    if own not in _KNOWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _KNOWN.add(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    It cuts the lineage and survives the loss of executors, since the files do not live
    on them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged.

    The check runs ``df`` up to its last shuffle and stops after ``rows + 1`` rows: cheap on
    tables and narrow plans. Give it a materialised table where aggregates or joins lie below.
    """
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df
