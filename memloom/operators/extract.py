"""Recorded replies to memory rows, turn windows and slot notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import jsonx, text


def extract_items(replies: DataFrame) -> DataFrame:
    """(conv_id, patch_id, turn_index, item_no, patch_type, payload, dependencies, fingerprint, slot_key, token_cost).

    Items of unknown type are skipped, of equal fingerprints in a turn the first stays, and ids count the kept items.
    """
    items = jsonx.explode_items(replies).where("error IS NULL").withColumn("patch_type", text.normalize_type(F.col("type"))).where("patch_type IS NOT NULL")
    items = items.withColumn("payload", text.normalize_payload(F.col("payload"))).withColumn("fingerprint", text.fingerprint(F.col("payload")))
    same = Window.partitionBy("conv_id", "turn_index", "fingerprint").orderBy("item_no")
    turn = Window.partitionBy("conv_id", "turn_index").orderBy("item_no")
    kept = items.withColumn("_k", F.row_number().over(same)).where("_k = 1").withColumn("kept_no", F.row_number().over(turn) - 1)
    return kept.select(
        "conv_id", F.format_string("p%d_%d", F.col("turn_index"), F.col("kept_no")).alias("patch_id"), "turn_index", "item_no", "patch_type", "payload", "dependencies", "fingerprint",
        text.slot_key(F.col("patch_type"), F.col("payload")).alias("slot_key"), text.token_cost(F.col("patch_type"), F.col("payload")).alias("token_cost"),
    )


def extraction_errors(replies: DataFrame) -> DataFrame:
    """(conv_id, turn_index, error_type) of replies without a readable array."""
    return jsonx.explode_items(replies).where("error IS NOT NULL").select("conv_id", "turn_index", F.col("error").alias("error_type"))


def recent_turns(turns: DataFrame, n: int = 8) -> DataFrame:
    """turns (conv_id, turn_index, role, text) with ``context``: the n turns before, as [role] text lines."""
    w = Window.partitionBy("conv_id").orderBy("turn_index").rowsBetween(-n, -1)
    return turns.withColumn("context", F.array_join(F.collect_list(F.concat(F.lit("["), "role", F.lit("] "), "text")).over(w), "\n"))


def recent_context(memory: DataFrame, n: int = 8) -> DataFrame:
    """(conv_id, context): the last n rows of each memory, rendered; only n rows per conversation leave a partition."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn_index"), F.desc("row_id"))
    last = memory.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    entry = F.struct("turn_index", "row_id", text.prompt_line(F.col("patch_type"), F.col("payload")).alias("line"))
    return last.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("rows")).select("conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("context"))


def slot_notes(memory: DataFrame) -> DataFrame:
    """(conv_id, row_id, service, slot, value) of payloads of the form service.slot = value."""
    pattern = r"^(?:\[SLOT\] )?(\w+)\.(\w+) ?= ?(.*)$"
    rows = memory.where((F.col("patch_type") == "slot") & F.col("payload").rlike(pattern))
    part = lambda i: F.regexp_extract("payload", pattern, i)
    return rows.select("conv_id", "row_id", F.lower(part(1)).alias("service"), F.lower(part(2)).alias("slot"), part(3).alias("value"))
