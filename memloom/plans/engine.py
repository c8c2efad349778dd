"""The whole read path: memory and a query per conversation to a context within the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.memory import is_critical, t1_dedup, t2_fusion, t4_prune
from memloom.operators.score import score
from memloom.operators.select import render, select_rows, with_budget
from memloom.schema import MemoryConfig
from memloom.sources.scratch import materialize

DEFAULT_QUERY = "summarise"


def default_queries(memory: DataFrame) -> DataFrame:
    """One query per conversation, asked at its last turn."""
    return memory.groupBy("conv_id").agg(F.max("turn_index").alias("query_turn")).withColumn("query", F.lit(DEFAULT_QUERY))


def shrink(memory: DataFrame) -> DataFrame:
    """Deduplication, fusion and pruning, in the order that leaves fewest rows to score."""
    return t4_prune(materialize(t2_fusion(t1_dedup(memory)).drop("pos_turn", "pos_row"), "fused"))


def compress(memory: DataFrame, queries: DataFrame | None = None, cfg: MemoryConfig | None = None, strict: bool = False) -> DataFrame:
    """(conv_id, status, mode, context, n_selected, context_tokens, n_critical, budget, floor_tokens, critical_selected).

    A conversation whose critical rows can't fit has the status BUDGET_TOO_SMALL and no context; with ``strict`` it fails the
    job.  A blank query asks for a summary.
    """
    cfg = cfg or MemoryConfig()
    memory = materialize(memory, "memory")
    asked = default_queries(memory) if queries is None else queries.withColumn("query", F.when(F.trim("query") == "", DEFAULT_QUERY).otherwise(F.coalesce("query", F.lit(DEFAULT_QUERY))))
    scored = materialize(score(shrink(memory), asked, cfg), "scored")
    contexts = render(select_rows(scored, cfg))
    per = with_budget(scored, cfg)
    out = per.join(contexts, "conv_id", "left").select(
        "conv_id", F.when(F.col("context").isNull() & (F.col("n_critical") > 0), "BUDGET_TOO_SMALL").otherwise(F.col("status")).alias("status"), F.coalesce("mode", F.lit("off")).alias("mode"),
        F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"), "n_critical", "budget", "floor_tokens", F.coalesce("critical_selected", F.lit(0)).alias("critical_selected"),
    )
    if strict:
        out = out.withColumn("status", F.when(F.col("status") != "OK", F.raise_error(F.concat(F.lit("the budget is too small for conversation "), F.col("conv_id").cast("string")))).otherwise(F.col("status")))
    return out


def stats(memory: DataFrame, contexts: DataFrame, conversation_tokens: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Per conversation: counts, share of critical rows kept (crr) and of tokens saved (trr).

    calls: (conv_id, llm_calls, llm_errors).
    """
    per = memory.groupBy("conv_id").agg((F.max("turn_index") + 1).alias("turns"), F.count("*").alias("total_patches"), F.count_if(is_critical()).alias("critical_total"), F.sum("token_cost").alias("patch_tokens"))
    per = per.join(contexts.select("conv_id", "status", "n_selected", "context_tokens", "critical_selected", "budget"), "conv_id", "left")
    if conversation_tokens is None:
        per = per.withColumn("conversation_tokens", F.col("patch_tokens"))
    else:
        per = per.join(conversation_tokens, "conv_id", "left").withColumn("conversation_tokens", F.coalesce("conversation_tokens", F.lit(0)))
    if calls is None:
        per = per.withColumns({"llm_calls": F.lit(0), "llm_errors": F.lit(0)})
    else:
        per = per.join(calls, "conv_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("llm_calls", "llm_errors")})
    kept = F.coalesce("critical_selected", F.lit(0))
    built = F.coalesce(F.col("n_selected") > 0, F.lit(False))
    crr = F.when(~built, 100.0).when(F.col("critical_total") == 0, 0.0).otherwise(100.0 * kept / F.col("critical_total"))
    trr = F.when(F.col("conversation_tokens") > 0, F.round((1 - F.coalesce("context_tokens", F.lit(0)) / F.col("conversation_tokens")) * 100, 1)).otherwise(0.0)
    return per.select(
        "conv_id", "turns", "total_patches", "critical_total", kept.cast("long").alias("critical_selected"), F.lit(0).alias("critical_deleted"), F.round(crr, 1).alias("crr"), trr.alias("trr_by_conversation"),
        "budget", "conversation_tokens", "patch_tokens", F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"), built.alias("context_built"), "llm_calls", "llm_errors",
    )
