"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where the session names none, below a folder of our own on one machine and
    an error on a cluster."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        _own = _own or f"file://{tempfile.mkdtemp(prefix='leasewell-')}"
        folder = _own
    return f"{folder.rstrip('/')}/leasewell/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
