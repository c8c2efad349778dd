"""Utility of memory rows against a query, and budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import words_of
from memloom.functions.vectors import bag, bag_cosine, norm, weights
from memloom.operators.memory import dependent_counts, is_critical
from memloom.schema import TYPES, MemoryConfig


def by_type(i: int) -> Column:
    return F.element_at(F.create_map(*(x for t, v in TYPES.items() for x in (F.lit(t), F.lit(v[i])))), F.col("patch_type"))


def recency(turn: Column, now: Column, rate: float = 0.15) -> Column:
    return F.exp(-rate * F.greatest(now - turn, F.lit(0)))


def budget_floor(n_critical: Column) -> Column:
    """The least budget at which n critical rows can all be kept."""
    return F.greatest(F.lit(1), F.floor(n_critical * 2.5).cast("int") + 4)


def auto_budget(n_critical: Column, cfg: MemoryConfig) -> Column:
    room = max(-(10**9), cfg.context_window - cfg.response_reserve - 500)
    return F.greatest(budget_floor(F.greatest(n_critical, F.lit(1))), F.lit(min(int(room * 0.05), 500)))


def score(memory: DataFrame, queries: DataFrame, cfg: MemoryConfig | None = None) -> DataFrame:
    """memory with ``utility`` set for the query of its conversation; queries is (conv_id, query, query_turn).

    Per-conversation maxima are aggregated and joined rather than windowed, so no conversation is gathered.
    """
    cfg = cfg or MemoryConfig()
    deps = dependent_counts(memory)
    most_dep = deps.groupBy("conv_id").agg(F.max("n").alias("max_dep"))
    most = memory.groupBy("conv_id").agg(F.max("token_cost").alias("max_cost")).join(most_dep, "conv_id", "left").join(queries.select("conv_id", "query", "query_turn"), "conv_id")
    align = F.lit(0.0)
    rows = memory.drop("utility")
    if cfg.embedder != "zero":
        most = most.withColumn("query_bag", bag(F.col("query"))).withColumn("query_weights", weights(F.col("query_bag"))).withColumn("query_norm", norm(F.col("query_bag"))).drop("query_bag")
        rows = rows.withColumn("payload_bag", bag(F.col("payload")))
        align = bag_cosine(F.col("payload_bag"), F.col("query_weights"), F.col("query_norm"))
    rows = rows.join(most, "conv_id").join(deps.withColumnRenamed("dep", "patch_id"), ["conv_id", "patch_id"], "left")
    utility = (
        cfg.w_align * (align + by_type(3))
        + cfg.w_dep * F.coalesce("n", F.lit(0)) / F.coalesce("max_dep", F.lit(1))
        + cfg.w_recency * recency(F.col("turn_index"), F.col("query_turn"), cfg.recency_lambda)
        - cfg.w_cost * F.col("token_cost") / F.greatest("max_cost", F.lit(1))
    )
    return rows.withColumn("utility", utility).drop("max_dep", "max_cost", "query", "query_turn", "query_weights", "query_norm", "payload_bag", "n")


def query_ema(queries: DataFrame, cfg: MemoryConfig | None = None, window: int | None = None) -> DataFrame:
    """Running mean of each type's mentions: (conv_id, query_no, ema_<type>).

    The recurrence e = a*hit + (1-a)*e is a weighted sum over earlier queries; terms of a weight below 1e-17 are below the
    precision of a double, so a frame of as many queries as weigh more gives the same value (57 at a = 0.5).
    """
    a = (cfg or MemoryConfig()).alpha_ema
    if window is None:
        window = math.ceil(math.log(1e-17) / math.log(1 - a)) if 0 < a < 1 else 1
    w = Window.partitionBy("conv_id").orderBy("query_no").rowsBetween(-(window - 1), 0)
    cols = []
    for t in TYPES:
        hits = F.collect_list(F.when(F.lower("query").contains(t), 1.0).otherwise(0.0)).over(w)
        cols.append(F.aggregate(hits, F.lit(0.0), lambda e, h: a * h + (1 - a) * e).alias(f"ema_{t}"))
    return queries.select("conv_id", "query_no", *cols)


def type_budgets(ema: DataFrame, cfg: MemoryConfig | None = None) -> DataFrame:
    """budget_<type> per query: shares of the budget raised by the running means; a diagnostic, never enforced."""
    cfg = cfg or MemoryConfig()
    raw = {t: F.lit(v[2]) * (1 + cfg.alpha_ema * F.col(f"ema_{t}")) for t, v in TYPES.items()}
    total = sum(raw.values(), F.lit(0.0))
    return ema.select("conv_id", "query_no", *(F.greatest(F.lit(5), F.floor(cfg.budget * r / total).cast("int")).alias(f"budget_{t}") for t, r in raw.items()))


def shadow_filter(memory: DataFrame, cfg: MemoryConfig | None = None) -> DataFrame:
    """Non-critical rows without those whose positive utility is a small share of all; zero and negative ones stay."""
    least = (cfg or MemoryConfig()).shadow_threshold
    others = memory.where(~is_critical())
    total = others.groupBy("conv_id").agg(F.sum(F.greatest("utility", F.lit(0.0))).alias("_total"))
    share = F.col("utility") / F.when(F.col("_total") == 0, 1e-9).otherwise(F.col("_total"))
    return others.join(total, "conv_id").where((F.col("utility") <= 0) | (share >= least)).drop("_total")


def word_count(payload: Column) -> Column:
    return F.size(words_of(payload))
