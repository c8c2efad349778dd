"""Fitting a conversation's memory to its budget: the ladder for critical rows and the greedy fill with the others.

Nothing here gathers a conversation of unknown size.  A conversation with more critical rows than its budget has room for is
told apart by a count, so the ladder meets at most (budget - 4) / 2.5 rows; and of the others that cost c tokens only the
first budget / c in order of density can ever be picked, so the fill meets at most budget * ln(budget) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.functions.text import TOKEN
from memloom.operators.hierarchy import _groups
from memloom.operators.memory import is_critical
from memloom.operators.score import auto_budget, budget_floor, shadow_filter
from memloom.schema import TYPES, UNITS, MemoryConfig
from memloom.sources.scratch import materialize

_token = regex.compile(TOKEN)
_digit = regex.compile(r"\d")


def n_tokens(s: str) -> int:
    return len(_token.findall(s))


def cost(kind: str, payload: str) -> int:
    return n_tokens(f"[{TYPES[kind][0]}] {payload}")


def trim(payload: str, most: int) -> str:
    """Same as functions.text.trim_numeric."""
    words = payload.split()
    if len(words) <= most:
        return payload
    weight = [2 * bool(_digit.search(w)) + ("%" in w or w.isupper()) + w[:1].isupper() for w in words]
    best = sorted(range(len(words)), key=lambda i: (-weight[i], i))[:most]
    return " ".join(words[i] for i in sorted(best))


def compact(payload: str) -> str:
    """Same as functions.text.ultra_compact."""
    keep, keyword = [], []
    for w in payload.split():
        low = w.lower().rstrip(".,;:")
        if _digit.search(w) or "%" in w or low in UNITS:
            keep.append(low)
        elif not keyword and len(w) > 1 and w[0].isupper():
            keyword.append(w)
    return " ".join((keyword + keep)[:4]) or (payload.split() or [payload])[0]


def key_word(payload: str) -> str:
    """Same as functions.text.single_token."""
    words = payload.split()
    bare = [w.rstrip(".,;:") for w in words]
    tests = (lambda i: _digit.search(words[i]), lambda i: len(bare[i]) > 1 and bare[i].isupper(), lambda i: bare[i][:1].isupper(), lambda i: True)
    return next((bare[i] for test in tests for i in range(len(words)) if test(i)), "?")


def by_kind(kinds: list[str], payloads: list[str]) -> list[tuple[str, list[str]]]:
    return [(k, own) for k in ("constraint", "decision") if (own := [p for t, p in zip(kinds, payloads, strict=True) if t == k])]


def dense_line(kinds: list[str], payloads: list[str]) -> str:
    return "\n".join(f"[{TYPES[k][0]}] {'; '.join(own)}" for k, own in by_kind(kinds, payloads))


def ultra_line(kinds: list[str], payloads: list[str]) -> str:
    return " ".join(w for k, own in by_kind(kinds, payloads) for w in (f"[{k[0].upper()}]", *own))


def ladder(kinds: list[str], payloads: list[str], budget: int) -> tuple[list[str], str, str]:
    """Payloads, mode (off, dense, ultra) and status; rows are never dropped, only shortened, as far as needed."""
    n, limit = len(kinds), max(8, budget)
    if budget < max(1, int(n * 2.5) + 4):
        return payloads, "off", "BUDGET_TOO_SMALL"
    most = max(2, int((limit / n - 4) / 1.4))
    now = [trim(p, most) for p in payloads]
    costs = [cost(k, p) for k, p in zip(kinds, now, strict=True)]
    lengths = [len(p.split()) for p in now]

    def put(i: int, p: str) -> None:
        now[i], costs[i], lengths[i] = p, cost(kinds[i], p), len(p.split())

    left = 4 * n
    while left and sum(costs) > limit and max(lengths) > 1:
        i = lengths.index(max(lengths))
        put(i, trim(now[i], lengths[i] - 1))
        left -= 1
    waiting = list(range(n))
    while waiting and sum(costs) > limit:
        i = max(waiting, key=lambda j: (costs[j], -j))
        put(i, compact(now[i]))
        waiting.remove(i)
    if sum(costs) <= limit:
        return now, "off", "OK"
    if n_tokens(dense_line(kinds, now)) <= limit:
        return now, "dense", "OK"
    now = [key_word(p) for p in now]
    return (now, "ultra", "OK") if n_tokens(ultra_line(kinds, now)) <= limit else (payloads, "off", "BUDGET_TOO_SMALL")


def with_budget(memory: DataFrame, cfg: MemoryConfig) -> DataFrame:
    """(conv_id, n_critical, budget, floor_tokens, status)."""
    n = F.count_if(is_critical()).cast("int")
    per = memory.groupBy("conv_id").agg(n.alias("n_critical"))
    budget = auto_budget(F.col("n_critical"), cfg).cast("int") if cfg.auto_budget else F.lit(cfg.budget)
    per = per.withColumn("budget", budget).withColumn("floor_tokens", budget_floor(F.col("n_critical")))
    return per.withColumn("status", F.when((F.col("n_critical") > 0) & (F.col("budget") < F.col("floor_tokens")), "BUDGET_TOO_SMALL").otherwise("OK"))


def stage_one(memory: DataFrame, cfg: MemoryConfig) -> DataFrame:
    """Critical rows trimmed to an equal number of words: the first step of the ladder, as built-in expressions."""
    per = with_budget(memory, cfg).where("status = 'OK'")
    most = F.greatest(F.lit(2), ((F.greatest(F.lit(8), F.col("budget")) / F.col("n_critical") - 4) / 1.4).cast("int"))
    rows = memory.where(is_critical()).join(per, "conv_id").withColumn("payload", text.trim_numeric(F.col("payload"), most))
    return rows.withColumn("token_cost", text.token_cost(F.col("patch_type"), F.col("payload"))).drop("n_critical", "budget", "floor_tokens", "status")


def fit_criticals(memory: DataFrame, cfg: MemoryConfig) -> DataFrame:
    """(conv_id, pos, patch_id, patch_type, payload, token_cost, mode, status): critical rows by utility, shortened."""
    spark = memory.sparkSession
    per = with_budget(memory, cfg).where("status = 'OK' AND n_critical > 0")
    rows = memory.where(is_critical()).join(per.select("conv_id", "budget"), "conv_id").select("conv_id", "utility", "turn_index", "row_id", "patch_id", "patch_type", "payload", "budget")
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int32()), ("patch_id", pa.string()), ("patch_type", pa.string()), ("payload", pa.string()), ("token_cost", pa.int32()), ("mode", pa.string()), ("status", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), (ids, kinds, payloads, budgets) in _groups(batches, ["conv_id"], ["patch_id", "patch_type", "payload", "budget"]):
            now, mode, status = ladder(kinds, payloads, budgets[0])
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids), pa.array(kinds), pa.array(now), pa.array([cost(k, p) for k, p in zip(kinds, now, strict=True)], pa.int32()), pa.array([mode] * n), pa.array([status] * n)], schema=schema)

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("utility"), "turn_index", "row_id")
    return ordered.mapInArrow(run, "conv_id BIGINT, pos INT, patch_id STRING, patch_type STRING, payload STRING, token_cost INT, mode STRING, status STRING")


def greedy_fill(others: DataFrame, room: DataFrame) -> DataFrame:
    """(conv_id, pos, patch_id, patch_type, payload, token_cost) picked from non-critical rows by density.

    room is (conv_id, budget, used).  Rows are taken in order of utility per token as long as they fit; one that doesn't is
    passed over.  Of rows of equal cost the picked ones are the first in that order, so longer lists per cost aren't needed.
    """
    free = F.col("budget") - F.col("used")
    rows = others.join(room.select("conv_id", free.alias("free")), "conv_id").where("free > 0 AND token_cost <= free")
    density = F.col("utility") / F.greatest("token_cost", F.lit(1))
    w = Window.partitionBy("conv_id", "token_cost").orderBy(F.desc("utility"), "turn_index", "row_id")
    few = rows.withColumn("_rank", F.row_number().over(w)).where("_rank * token_cost <= free OR token_cost = 0")
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int32()), ("patch_id", pa.string()), ("patch_type", pa.string()), ("payload", pa.string()), ("token_cost", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, left, pos = None, 0, 0
        for b in batches:
            taken, places = [], []
            for i, (c, cost_, free_) in enumerate(zip(*(b.column(x).to_pylist() for x in ("conv_id", "token_cost", "free")), strict=True)):
                if c != conv:
                    conv, left, pos = c, free_, 0
                if left > 0 and cost_ <= left:
                    left -= cost_
                    taken.append(i)
                    places.append(pos)
                    pos += 1
            own = b.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()) if f.name == "pos" else own.column(f.name).cast(f.type) for f in schema], schema=schema)

    spark = others.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = few.select("conv_id", (-density).alias("order"), "turn_index", "row_id", "patch_id", "patch_type", "payload", "token_cost", "free").repartition(n, "conv_id").sortWithinPartitions("conv_id", "order", "turn_index", "row_id")
    return ordered.mapInArrow(run, "conv_id BIGINT, pos INT, patch_id STRING, patch_type STRING, payload STRING, token_cost INT")


def select_rows(memory: DataFrame, cfg: MemoryConfig | None = None) -> DataFrame:
    """(conv_id, pos, patch_id, patch_type, payload, token_cost, critical): criticals in order, then the picks."""
    cfg = cfg or MemoryConfig()
    critical = materialize(fit_criticals(memory, cfg), "fitted")
    used = critical.where("status = 'OK'").groupBy("conv_id").agg(F.sum("token_cost").cast("int").alias("used"), F.first("mode").alias("mode"))
    failed = critical.where("status <> 'OK'").select("conv_id").distinct()
    room = with_budget(memory, cfg).where("status = 'OK'").join(failed, "conv_id", "left_anti").join(used, "conv_id", "left").select("conv_id", "budget", F.coalesce("used", F.lit(0)).alias("used"))
    picks = greedy_fill(shadow_filter(memory, cfg), room)
    kept = critical.where("status = 'OK'").select("conv_id", "pos", "patch_id", "patch_type", "payload", "token_cost", "mode", F.lit(True).alias("critical"))
    others = picks.join(used.select("conv_id", "mode"), "conv_id", "left").select("conv_id", "pos", "patch_id", "patch_type", "payload", "token_cost", F.coalesce("mode", F.lit("off")).alias("mode"), F.lit(False).alias("critical"))
    return kept.unionByName(others)


def render(selected: DataFrame) -> DataFrame:
    """(conv_id, mode, context, n_selected, context_tokens, critical_selected) by the mode of each conversation's selection."""
    entry = F.struct(F.when(F.col("critical"), 0).otherwise(1).alias("part"), "pos", "patch_type", "payload")
    per = selected.groupBy("conv_id").agg(F.first("mode").alias("mode"), F.array_sort(F.collect_list(entry)).alias("rows"), F.count("*").alias("n_selected"), F.sum("token_cost").alias("context_tokens"), F.count_if("critical").alias("critical_selected"))
    line = lambda x: text.prompt_line(x["patch_type"], x["payload"])
    rows = F.col("rows")
    plain = F.array_join(F.transform(rows, line), "\n")
    others = F.transform(F.filter(rows, lambda x: x["part"] == 1), line)
    of = lambda kind: F.transform(F.filter(rows, lambda x: (x["part"] == 0) & (x["patch_type"] == kind)), lambda x: x["payload"])
    some = lambda xs, one: F.when(F.size(xs) > 0, F.array(one)).otherwise(F.array().cast("array<string>"))
    dense = F.concat(*(some(of(k), F.concat(F.lit(f"[{TYPES[k][0]}] "), F.array_join(of(k), "; "))) for k in ("constraint", "decision")), others)
    words = F.concat(*(some(of(k), F.concat(F.lit(f"[{k[0].upper()}] "), F.array_join(of(k), " "))) for k in ("constraint", "decision")))
    ultra = F.concat(F.array(F.array_join(words, " ")), others)
    context = F.when(F.col("mode") == "dense", F.array_join(dense, "\n")).when(F.col("mode") == "ultra", F.array_join(ultra, "\n")).otherwise(plain)
    return per.select("conv_id", "mode", context.alias("context"), "n_selected", "context_tokens", "critical_selected")
