"""Tables written between the steps of a job.

A step that must not be computed twice, or whose lineage has to be cut, is written as Parquet into the folder that the
cluster names in ``spark.checkpoint.dir`` and read back.  Such a table survives the loss of executors, unlike a cache or a
local checkpoint.  Only where that setting is absent (tests, a single machine) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="memloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return the written table."""
    path = f"{scratch_dir(df.sparkSession)}/memloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
