"""Reading of the engine's tables and the row rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.sources.ship import ship


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def norm_id(c: Column) -> Column:
    """Ids, types and slot keys are compared in lower case without outer blanks."""
    return F.lower(F.trim(c))


def norm_type(c: Column) -> Column:
    """A patch type is compared like an id, and without trailing ``s``."""
    return F.regexp_replace(norm_id(c), "s+$", "")


def counted(patches: DataFrame, *columns: str) -> DataFrame:
    """One row per (conv_id, patch_id): the one with the greatest ingested_at, then row_id.

    Rows without conv_id or patch_id name nothing and are left out; a null ingested_at counts as the earliest.
    The rank filter is applied before the shuffle as well (Spark's window group limit), so repeats of one key are
    reduced where they are read.
    """
    keep = list(dict.fromkeys(["conv_id", "patch_id", *columns]))
    used = list(dict.fromkeys([*keep, "ingested_at", "row_id"]))
    w = Window.partitionBy("conv_id", "patch_id").orderBy(F.col("ingested_at").desc_nulls_last(), F.col("row_id").desc_nulls_last())
    return (
        patches.select(*used)
        .where("conv_id IS NOT NULL AND patch_id IS NOT NULL")
        .withColumn("_rank", F.row_number().over(w))
        .where("_rank = 1")
        .select(*keep)
    )
