"""History of changing entity attributes (problem 5).

An entity is a slot key of a conversation; its attribute is the payload that each save shows.  Per entity the saves are
gathered into a sorted array of structs, in blocks of ``block_saves`` saves, and folded by a higher-order function that
appends a version only upon a change or a gap.  The versions at the edges of blocks are then joined by a running window, so
no array grows with the history of an entity and the window sees two rows per block.

Of repeated or contradicting rows of a turn the one with the greatest arrived_at, then row_id, decides (a null arrived_at is
the earliest).  A null payload or a missing row ends a version; an empty payload is a value.  Rows without conv_id or
turn_index are left out; rows without slot_key only count as saves.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources.tables import norm_id

BLOCK_SAVES = 128


def same_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def _fold(saves: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = F.coalesce((last["same"] == x["same"]) & (last["last_save"] + 1 == x["save_no"]), F.lit(False))
        start = F.when(goes_on, last["first_save"]).otherwise(x["save_no"])
        version = F.struct(
            start.alias("first_save"), x["save_no"].alias("last_save"), F.when(goes_on, last["valid_from"]).otherwise(x["turn_index"]).alias("valid_from"),
            x["next_turn"].alias("valid_to"), x["same"].alias("same"), F.when(goes_on, last["payload"]).otherwise(x["payload"]).alias("payload"),
        )
        head = F.when(goes_on, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.concat(head, F.array(version))

    empty = F.expr("CAST(array() AS ARRAY<STRUCT<first_save: INT, last_save: INT, valid_from: INT, valid_to: INT, same: STRING, payload: STRING>>)")
    return F.aggregate(saves, empty, step)


def history(snapshots: DataFrame, block_saves: int = BLOCK_SAVES) -> DataFrame:
    """(conv_id, slot_key, version_no, valid_from, valid_to, n_saves, payload): payload as first written in the version."""
    rows = snapshots.select("conv_id", F.col("turn_index").cast("int").alias("turn_index"), norm_id(F.col("slot_key")).alias("slot_key"), "payload", "arrived_at", "row_id").where("conv_id IS NOT NULL AND turn_index IS NOT NULL")
    by_turn = Window.partitionBy("conv_id").orderBy("turn_index")
    saves = rows.select("conv_id", "turn_index").distinct().select("conv_id", "turn_index", F.row_number().over(by_turn).alias("save_no"), F.coalesce(F.lead("turn_index").over(by_turn), F.lit(-1)).alias("next_turn"))
    held = (
        rows.where("slot_key IS NOT NULL")
        .groupBy("conv_id", "slot_key", "turn_index")
        .agg(F.max_by("payload", F.struct("arrived_at", "row_id")).alias("payload"))
        .where("payload IS NOT NULL")
        .join(saves, ["conv_id", "turn_index"])
        .withColumn("block", F.floor(F.col("save_no") / block_saves))
    )
    entry = F.struct("save_no", "turn_index", "next_turn", same_text(F.col("payload")).alias("same"), "payload")
    versions = held.groupBy("conv_id", "slot_key", "block").agg(F.array_sort(F.collect_list(entry)).alias("saves")).select("conv_id", "slot_key", "block", F.explode(_fold(F.col("saves"))).alias("v")).select("conv_id", "slot_key", "block", "v.*")
    at_edge = (F.col("first_save") % block_saves == 0) | ((F.col("last_save") + 1) % block_saves == 0)
    w = Window.partitionBy("conv_id", "slot_key", "at_edge").orderBy("first_save")
    goes_on = F.col("at_edge") & (F.lag("same").over(w) == F.col("same")) & (F.lag("last_save").over(w) + 1 == F.col("first_save"))
    runs = versions.withColumn("at_edge", at_edge).withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("starts").over(w))
    joined = runs.groupBy("conv_id", "slot_key", "at_edge", "run").agg(
        F.min("first_save").alias("first_save"), F.max("last_save").alias("last_save"), F.min("valid_from").alias("valid_from"), F.max_by("valid_to", "last_save").alias("valid_to"), F.min_by("payload", "first_save").alias("payload")
    )
    number = F.row_number().over(Window.partitionBy("conv_id", "slot_key").orderBy("first_save"))
    return joined.select("conv_id", "slot_key", number.alias("version_no"), "valid_from", "valid_to", (F.col("last_save") - F.col("first_save") + 1).alias("n_saves"), "payload")


def found(snapshots: DataFrame) -> DataFrame:
    """(conv_id, slot_key, valid_from, valid_to)."""
    return history(snapshots).select("conv_id", "slot_key", "valid_from", "valid_to")
