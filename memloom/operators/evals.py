"""Aggregates of per-dialogue evaluation results."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _valid(results: DataFrame) -> DataFrame:
    return results.distinct().where("compressed_tokens > 0")


def recall_by_method(results: DataFrame) -> DataFrame:
    """(method, sr_correct, sr_total, sr): answers over all sr_q_ columns, unanswered ones skipped."""
    asked = [c for c in results.columns if c.startswith("sr_q_")]
    long = _valid(results).unpivot(["method", "dialogue_id"], asked, "question", "hit").where("hit IS NOT NULL")
    return long.groupBy("method").agg(F.count_if("hit").alias("sr_correct"), F.count("*").alias("sr_total"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("sr"))


def summary(results: DataFrame) -> DataFrame:
    """Means per method; null visibility shares are skipped, repeated rows count once."""
    per = _valid(results).groupBy("method").agg(
        F.count("*").alias("n_dialogues"), F.round(F.avg("raw_tokens"), 4).alias("mean_raw_tokens"), F.round(F.avg("compressed_tokens"), 4).alias("mean_compressed_tokens"),
        F.round(F.avg(F.col("raw_tokens") / F.col("compressed_tokens")), 4).alias("mean_compression_ratio"), F.round(F.avg("cpi"), 5).alias("mean_cpi"), F.round(F.avg("time_s"), 4).alias("mean_time_s"),
    )
    return per.join(recall_by_method(results), "method", "left")


def visible_share(results: DataFrame) -> DataFrame:
    """(method, dialogue_id, cpi): visible of all wanted constraints."""
    return results.where("n_gt_constraints > 0").select("method", "dialogue_id", F.round(F.col("n_visible") / F.col("n_gt_constraints"), 4).alias("cpi")).distinct()


def stability(contexts: DataFrame) -> DataFrame:
    """(conv_id, turn_index, similarity) of each context to the one before."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    before = F.lag("context").over(Window.partitionBy("conv_id").orderBy("turn_index"))
    return contexts.withColumn("before", before).where("before IS NOT NULL").select("conv_id", "turn_index", F.round(ratio("before", "context"), 6).alias("similarity"))
