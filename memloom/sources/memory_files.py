"""Saved memories, replies and results: reading and writing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.schema import MEMORY_FILE

VERSION = "1"


class CorruptMemoryError(RuntimeError):
    """A saved memory can't be read and strict reading was asked for."""


def patch_to_json(memory: DataFrame) -> DataFrame:
    """(conv_id, row_id, json): the nine saved fields of each row; derived fields are not saved."""
    fields = F.struct("patch_id", "turn_index", "patch_type", "payload", "dependencies", "utility", F.lit(False).alias("is_delta"), F.lit("").alias("delta_base"), F.lit(0).alias("causal_depth"))
    return memory.select("conv_id", "row_id", F.to_json(fields).alias("json"))


def save_memory(memory: DataFrame, path: str, budget: int = 400) -> None:
    """JSON lines, one per patch with its conversation; the output commit protocol makes a save all or nothing."""
    out = memory.select(
        "conv_id", F.lit(VERSION).alias("version"), F.lit(budget).alias("budget"), "row_id", "patch_id", "turn_index", "patch_type", "payload", "dependencies", "utility",
    )
    out.write.mode("overwrite").json(path)


SAVED = "conv_id BIGINT, version STRING, budget INT, row_id BIGINT, patch_id STRING, turn_index INT, patch_type STRING, payload STRING, dependencies ARRAY<STRING>, utility DOUBLE"


def load_memory(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Saved rows; unreadable ones are left out, or fail the job if strict."""
    if strict:
        return spark.read.schema(SAVED).option("mode", "FAILFAST").json(path)
    # An unreadable line gives a row of nulls; a saved row always has both ids.
    return spark.read.schema(SAVED).json(path).where("conv_id IS NOT NULL AND patch_id IS NOT NULL")


def load_memory_file(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Whole documents {version, budget, turn_index, patches}, one row per patch; numbered in the order of the file."""
    reader = spark.read.schema(MEMORY_FILE).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path).select("version", "budget", F.col("turn_index").alias("file_turn"), F.posexplode("patches").alias("pos", "p")).select("version", "budget", "file_turn", "pos", "p.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Per-dialogue results as JSON lines or, with a header, CSV."""
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.option("header", True).option("inferSchema", True).csv(path)
