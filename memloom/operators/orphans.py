"""References to records that do not exist (problem 2).

The operator keeps three keyed tables: the parent index (first arrival per conversation and id), the deletions, and the
pending references.  A step takes newly arrived references, parents and deletions:

* new references probe the parent index and stay pending if the parent is absent or arrived after them;
* arriving parents resolve waiting orphans: those are kept as ``late``;
* deletions turn missing ones to ``deleted`` and, with ``reopen``, reopen references whose parent was there.

Parents and deletions are reduced per key before the shuffle, so a key that holds a third of all references meets one row of
either index; the join on the side of the references is split by adaptive execution.  The state is a set of written tables.
A load in one step equals a load in many: the state of a reference depends on times, not on the order of steps.

Null and blank ids refer to nothing; a reference without a time is taken as made before any parent; null reasons, repeated
deletions and ids never seen elsewhere do no harm; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.scratch import materialize
from memloom.sources.tables import counted, norm_id

REFS = "src_table STRING, row_id BIGINT, conv_id BIGINT, ref_id STRING, made_at TIMESTAMP_NTZ"


@dataclass
class OrphanState:
    """Written tables: parents (conv_id, ref_id, first_at), deletions (conv_id, ref_id, deleted_at), refs still open."""

    parents: DataFrame
    deletions: DataFrame
    refs: DataFrame

    def save(self) -> OrphanState:
        return OrphanState(materialize(self.parents, "parents"), materialize(self.deletions, "deletions"), materialize(self.refs, "pending"))


def parent_rows(patches: DataFrame) -> DataFrame:
    rows = patches.where("conv_id IS NOT NULL AND patch_id IS NOT NULL")
    return rows.groupBy("conv_id", norm_id(F.col("patch_id")).alias("ref_id")).agg(F.min("ingested_at").alias("first_at"))


def deletion_rows(deleted: DataFrame) -> DataFrame:
    rows = deleted.select("conv_id", norm_id(F.col("patch_id")).alias("ref_id"), "deleted_at").where("conv_id IS NOT NULL AND ref_id <> ''")
    return rows.groupBy("conv_id", "ref_id").agg(F.max("deleted_at").alias("deleted_at"))


def patch_refs(patches: DataFrame) -> DataFrame:
    """Distinct non-blank entries of the dependencies of counted patches."""
    rows = counted(patches, "row_id", "ingested_at", "dependencies").where("size(dependencies) > 0")
    ids = F.filter(F.array_distinct(F.transform("dependencies", lambda x: F.lower(F.trim(x)))), lambda x: x.isNotNull() & (x != ""))
    return rows.select(F.lit("patches").alias("src_table"), "row_id", "conv_id", F.explode(ids).alias("ref_id"), F.col("ingested_at").alias("made_at"))


def item_refs(items: DataFrame) -> DataFrame:
    return items.select(F.lit("context_items").alias("src_table"), "row_id", "conv_id", norm_id(F.col("patch_id")).alias("ref_id"), F.col("selected_at").alias("made_at")).where("ref_id <> ''")


def orphan_step(state: OrphanState | None, refs: DataFrame, parents: DataFrame, deletions: DataFrame, reopen: bool = False) -> tuple[OrphanState, DataFrame]:
    """The next state and the references that are orphans after this step, with ``ref_state``.

    parents and deletions may hold keys that the state has; the first arrival and the last deletion count.  With
    ``reopen`` references that were met in time stay in the state, so that a later deletion can reopen them.
    """
    if state is not None:
        parents = state.parents.unionByName(parents).groupBy("conv_id", "ref_id").agg(F.min("first_at").alias("first_at"))
        deletions = state.deletions.unionByName(deletions).groupBy("conv_id", "ref_id").agg(F.max("deleted_at").alias("deleted_at"))
        refs = state.refs.unionByName(refs)
    probed = refs.join(parents.withColumn("_seen", F.lit(True)), ["conv_id", "ref_id"], "left").join(deletions.withColumn("_gone", F.lit(True)), ["conv_id", "ref_id"], "left")
    met = F.col("_seen").isNotNull() & F.coalesce(F.col("first_at") <= F.col("made_at"), F.lit(False))
    back = F.lit(reopen) & met & F.coalesce(F.col("deleted_at") > F.greatest("made_at", "first_at"), F.lit(False))
    named = probed.withColumn(
        "ref_state",
        F.when(back, "reopened").when(met, "met").when(F.col("_seen").isNotNull(), "late").when(F.col("_gone").isNotNull(), "deleted").otherwise("missing"),
    )
    columns = ["src_table", "row_id", "conv_id", "ref_id", "made_at"]
    orphans = named.where("ref_state <> 'met'").select(*columns, "ref_state")
    kept = refs if reopen else orphans.select(*columns)
    return OrphanState(parents, deletions, kept), orphans


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Snapshot: orphans per table, month and state."""
    return orphans.groupBy("src_table", F.date_format("made_at", "yyyy-MM").alias("src_month"), "ref_state").agg(F.count("*").alias("n_refs"))


def orphans(patches: DataFrame, items: DataFrame, deleted: DataFrame) -> DataFrame:
    """All tables in one step from an empty state."""
    refs = patch_refs(patches).unionByName(item_refs(items))
    return orphan_step(None, refs, parent_rows(patches), deletion_rows(deleted))[1]


def found(patches: DataFrame, items: DataFrame, deleted: DataFrame) -> DataFrame:
    """(src_table, src_month, row_id, ref_id, ref_state); a reference without a time has no month and is left out."""
    rows = orphans(patches, items, deleted).where("made_at IS NOT NULL AND row_id IS NOT NULL")
    return rows.select("src_table", F.date_format("made_at", "yyyy-MM").alias("src_month"), "row_id", "ref_id", "ref_state")
