"""Queries of the general data problems (p1, p2, p4, p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import hierarchy, history, orphans, slots
from memloom.plans import slots_sql
from memloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found(table(spark, d, "patches"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(table(spark, d, "patches"))
    return tree.select("conv_id", "patch_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "root_id", "depth", F.array_join("path", "/").alias("path"), "n_descendants", "on_cycle")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "patches")))


def _orphans(spark: SparkSession, d: str, f: Callable) -> DataFrame:
    return f(table(spark, d, "patches"), table(spark, d, "context_items"), table(spark, d, "deleted_patches"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d, orphans.found)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d, orphans.orphans).where("made_at IS NOT NULL"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return slots.found(table(spark, d, "patches"), table(spark, d, "slot_catalog"))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return slots.wide_slots(table(spark, d, "patches"), table(spark, d, "slot_catalog"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.found(table(spark, d, "memory_snapshots"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return history.history(table(spark, d, "memory_snapshots")).select("conv_id", "slot_key", "version_no", "valid_from", "valid_to", "n_saves")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p2_found, p2_counts, p4_found, p4_wide, p5_found, p5_history)}

_COUNTED = """
WITH RECURSIVE counted AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, patch_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC NULLS LAST) AS rk
    FROM patches WHERE conv_id IS NOT NULL AND patch_id IS NOT NULL) WHERE rk = 1)
"""

_TREE = (
    _COUNTED
    + """
, entries AS (
  SELECT conv_id, patch_id, u.pos, lower(trim(u.dep, ' ')) AS dep
  FROM counted, UNNEST(list_zip(range(len(dependencies)), dependencies)) AS t(z), (SELECT z[1] AS pos, z[2] AS dep) AS u)
, parents AS (
  SELECT e.conv_id, e.patch_id, arg_min(e.dep, e.pos) AS parent_id
  FROM entries e JOIN counted c ON c.conv_id = e.conv_id AND c.patch_id = e.dep GROUP BY 1, 2)
, up AS (
  SELECT conv_id, patch_id, patch_id AS at_id, [patch_id] AS seen, false AS ring FROM parents
  UNION ALL
  SELECT u.conv_id, u.patch_id, p.parent_id, list_append(u.seen, p.parent_id), list_contains(u.seen, p.parent_id)
  FROM up u JOIN parents p ON p.conv_id = u.conv_id AND p.patch_id = u.at_id WHERE NOT u.ring)
, ends AS (
  SELECT conv_id, patch_id, arg_max(at_id, len(seen)) AS at_id, arg_max(seen, len(seen)) AS seen, max(ring) AS ring FROM up GROUP BY 1, 2)
"""
)

_REFS = (
    _COUNTED
    + """
, refs AS (
  SELECT DISTINCT 'patches' AS src_table, row_id, conv_id, lower(trim(d, ' ')) AS ref_id, ingested_at AS made_at
  FROM (SELECT row_id, conv_id, ingested_at, UNNEST(dependencies) AS d FROM counted) WHERE trim(d, ' ') <> ''
  UNION ALL
  SELECT 'context_items', row_id, conv_id, lower(trim(patch_id, ' ')), selected_at FROM context_items WHERE trim(patch_id, ' ') <> '')
, firsts AS (SELECT conv_id, lower(trim(patch_id, ' ')) AS ref_id, min(ingested_at) AS first_at FROM patches GROUP BY 1, 2)
, gone AS (SELECT DISTINCT conv_id, lower(trim(patch_id, ' ')) AS ref_id FROM deleted_patches)
, orphans AS (
  SELECT r.src_table, strftime(r.made_at, '%Y-%m') AS src_month, r.row_id, r.ref_id,
         CASE WHEN f.ref_id IS NOT NULL THEN 'late' WHEN g.ref_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS ref_state
  FROM refs r LEFT JOIN firsts f ON f.conv_id = r.conv_id AND f.ref_id = r.ref_id LEFT JOIN gone g ON g.conv_id = r.conv_id AND g.ref_id = r.ref_id
  WHERE r.made_at IS NOT NULL AND (f.ref_id IS NULL OR f.first_at > r.made_at))
"""
)

_HISTORY = """
WITH rows AS (SELECT conv_id, turn_index, lower(trim(slot_key, ' ')) AS slot_key, payload, arrived_at, row_id FROM memory_snapshots WHERE conv_id IS NOT NULL AND turn_index IS NOT NULL)
, saves AS (SELECT conv_id, turn_index, row_number() OVER w AS save_no, coalesce(lead(turn_index) OVER w, -1) AS next_turn
  FROM (SELECT DISTINCT conv_id, turn_index FROM rows) WINDOW w AS (PARTITION BY conv_id ORDER BY turn_index))
, held AS (SELECT r.conv_id, r.slot_key, r.turn_index, s.save_no, s.next_turn, lower(trim(regexp_replace(r.payload, '\\s+', ' ', 'g'))) AS same
  FROM (SELECT * FROM rows WHERE slot_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, slot_key, turn_index ORDER BY arrived_at DESC NULLS LAST, row_id DESC) = 1) r
  JOIN saves s ON s.conv_id = r.conv_id AND s.turn_index = r.turn_index WHERE r.payload IS NOT NULL)
, marked AS (SELECT *, CASE WHEN lag(same) OVER w = same AND lag(save_no) OVER w + 1 = save_no THEN 0 ELSE 1 END AS starts FROM held WINDOW w AS (PARTITION BY conv_id, slot_key ORDER BY save_no))
, runs AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, slot_key ORDER BY save_no) AS run FROM marked)
, versions AS (SELECT conv_id, slot_key, run::BIGINT AS version_no, min(turn_index) AS valid_from, arg_max(next_turn, save_no) AS valid_to, count(*) AS n_saves FROM runs GROUP BY 1, 2, 3)
"""

ORACLES: dict[str, str] = {
    "p4_found": slots_sql.cells(_COUNTED),
    "p1_found": _TREE
    + "SELECT conv_id, patch_id, CASE WHEN ring THEN 'cycle:' || list_min(seen[list_position(seen, at_id):]) ELSE at_id END AS root_id FROM ends",
    "p1_descendants": _TREE + "SELECT conv_id, at_id AS ancestor_id, patch_id, (len(seen) - 1)::INT AS distance FROM up WHERE NOT ring AND len(seen) > 1",
    "p2_found": _REFS + "SELECT * FROM orphans",
    "p2_counts": _REFS + "SELECT src_table, src_month, ref_state, count(*) AS n_refs FROM orphans GROUP BY 1, 2, 3",
    "p5_found": _HISTORY + "SELECT conv_id, slot_key, valid_from, valid_to FROM versions",
    "p5_history": _HISTORY + "SELECT conv_id, slot_key, version_no, valid_from, valid_to, n_saves FROM versions",
}
