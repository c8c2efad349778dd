"""The memory of a conversation as rows, and the filters that shrink it.

All operators take memory rows (conv_id, seq, patch_id, turn_index, patch_type, payload, dependencies, utility, token_cost,
fingerprint, slot_key) and give memory rows.  ``seq`` (turn_index, row_id) is the order that decides ties; nothing relies on
the order of partitions.  Keys finer than a conversation (fingerprint, slot key) spread a conversation that holds a large
share of all rows.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators.hierarchy import BLOCK_ROWS, ROWS_PER_TASK, _groups
from memloom.functions.text import TOKEN
from memloom.schema import CRITICAL, TYPES, MemoryConfig
from memloom.sources.scratch import materialize
from memloom.sources.tables import counted

MEMORY = ["conv_id", "row_id", "patch_id", "turn_index", "patch_type", "payload", "dependencies", "utility", "token_cost", "fingerprint", "slot_key"]


def is_critical(patch_type: Column | None = None) -> Column:
    return (F.col("patch_type") if patch_type is None else patch_type).isin(CRITICAL)


def memory_rows(patches: DataFrame, cfg: MemoryConfig | None = None) -> DataFrame:
    """Counted patches of known types with a payload, all derived fields computed anew; null dependencies are empty."""
    cfg = cfg or MemoryConfig()
    rows = counted(patches, "row_id", "turn_index", "patch_type", "payload", "dependencies", "utility")
    rows = rows.withColumn("patch_type", text.normalize_type(F.trim("patch_type"))).where("patch_type IS NOT NULL AND payload IS NOT NULL")
    rows = rows.withColumn("payload", text.normalize_payload(F.col("payload"), cfg.max_payload_chars))
    return rows.select(
        "conv_id", "row_id", "patch_id", F.coalesce("turn_index", F.lit(0)).alias("turn_index"), "patch_type", "payload",
        F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), F.coalesce("utility", F.lit(0.0)).alias("utility"),
        text.token_cost(F.col("patch_type"), F.col("payload")).alias("token_cost"), text.fingerprint(F.col("payload")).alias("fingerprint"), text.slot_key(F.col("patch_type"), F.col("payload")).alias("slot_key"),
    )


def t1_dedup(memory: DataFrame) -> DataFrame:
    """Of non-critical rows with one fingerprint the latest turn stays, at the place (``pos_turn``, ``pos_row``) of the first."""
    w = Window.partitionBy("conv_id", "fingerprint")
    first = F.min(F.struct("turn_index", "row_id")).over(w)
    others = (
        memory.where(~is_critical())
        .withColumn("_first", first)
        .withColumn("_rank", F.row_number().over(w.orderBy(F.desc("turn_index"), "row_id")))
        .where("_rank = 1")
        .withColumn("pos_turn", F.col("_first.turn_index"))
        .withColumn("pos_row", F.col("_first.row_id"))
        .drop("_first", "_rank")
    )
    critical = memory.where(is_critical()).withColumn("pos_turn", F.col("turn_index")).withColumn("pos_row", F.col("row_id"))
    return others.unionByName(critical)


def t2_fusion(memory: DataFrame) -> DataFrame:
    """Of non-critical rows with one slot key the one of highest utility, then latest turn, then first place stays."""
    place = ["pos_turn", "pos_row"] if "pos_turn" in memory.columns else ["turn_index", "row_id"]
    w = Window.partitionBy("conv_id", "slot_key").orderBy(F.desc("utility"), F.desc("turn_index"), *place)
    others = memory.where(~is_critical()).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return others.unionByName(memory.where(is_critical()))


def t3_delta(memory: DataFrame, cfg: MemoryConfig | None = None) -> DataFrame:
    """Along each chain of one slot key, later non-critical payloads become word differences where that saves tokens.

    The base is the previous row of the chain as it was left, so the chain is folded in order: rows stream through a task,
    sorted by key and turn, and only the previous row is held.  Adds is_delta and delta_base.
    """
    saving = (cfg or MemoryConfig()).delta_min_saving
    token = regex.compile(TOKEN)
    columns = ["conv_id", "slot_key", "patch_id", "turn_index", "row_id", "patch_type", "payload", "token_cost"]
    schema = pa.schema([("conv_id", pa.int64()), ("slot_key", pa.string()), ("patch_id", pa.string()), ("turn_index", pa.int32()), ("row_id", pa.int64()), ("patch_type", pa.string()), ("payload", pa.string()), ("token_cost", pa.int32()), ("is_delta", pa.bool_()), ("delta_base", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base_id, base_words = None, "", frozenset()
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for conv, slot, pid, turn, row, kind, payload, cost in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                words, changed, based = frozenset(payload.lower().split()), False, ""
                if (conv, slot) == key and not TYPES[kind][1]:
                    more, less = sorted(words - base_words), sorted(base_words - words)
                    parts = [f"{sign}[{' '.join(ws)}]" for sign, ws in (("+", more), ("-", less)) if ws]
                    delta = " ".join(parts) if parts else payload
                    if len(token.findall(delta)) <= cost - saving:
                        payload, changed, based = delta, True, base_id
                        cost = len(token.findall(f"[{TYPES[kind][0]}] {payload}"))
                        words = frozenset(payload.lower().split())
                key, base_id, base_words = (conv, slot), pid, words
                for o, x in zip(out, (conv, slot, pid, turn, row, kind, payload, cost, changed, based), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

    spark = memory.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chains = memory.select(*columns).repartition(n, "conv_id", "slot_key").sortWithinPartitions("conv_id", "slot_key", "turn_index", "row_id")
    return chains.mapInArrow(run, "conv_id BIGINT, slot_key STRING, patch_id STRING, turn_index INT, row_id BIGINT, patch_type STRING, payload STRING, token_cost INT, is_delta BOOLEAN, delta_base STRING")


def dependency_edges(memory: DataFrame) -> DataFrame:
    """(conv_id, patch_id, dep): distinct edges to patches that are there."""
    ids = memory.select("conv_id", F.col("patch_id").alias("dep"))
    return memory.select("conv_id", "patch_id", F.explode(F.array_distinct("dependencies")).alias("dep")).join(ids, ["conv_id", "dep"], "left_semi").select("conv_id", "patch_id", "dep")


def dependent_counts(memory: DataFrame) -> DataFrame:
    """(conv_id, dep, n): how often an id is depended on, ids that are not there included."""
    return memory.select("conv_id", F.explode("dependencies").alias("dep")).where("dep IS NOT NULL").groupBy("conv_id", "dep").agg(F.count("*").alias("n"))


def _depths(ids: list[str], deps: list[list[str]]) -> tuple[list[int], list[bool]]:
    """Breadth-first depth from the patches without dependencies (0 where none leads there), and who has dependents."""
    at = {x: i for i, x in enumerate(ids)}
    below = defaultdict(list)
    for i, ds in enumerate(deps):
        for d in ds:
            if d in at:
                below[at[d]].append(i)
    depth = [-1] * len(ids)
    queue = deque(i for i, ds in enumerate(deps) if not ds)
    for i in queue:
        depth[i] = 0
    while queue:
        i = queue.popleft()
        for j in below[i]:
            if depth[j] < 0:
                depth[j] = depth[i] + 1
                queue.append(j)
    return [max(d, 0) for d in depth], [bool(below[i]) for i in range(len(ids))]


def causal_depths(memory: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, patch_id, causal_depth, has_child).

    Conversations up to block_rows rows are walked whole, one at a time; larger ones level by level with joins.
    """
    spark = memory.sparkSession
    total, hot = memory.groupBy("conv_id").count().agg(F.sum("count"), F.collect_list(F.when(F.col("count") > block_rows, F.col("conv_id")))).first()
    n = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // ROWS_PER_TASK))
    schema = pa.schema([("conv_id", pa.int64()), ("patch_id", pa.string()), ("causal_depth", pa.int32()), ("has_child", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), (ids, deps) in _groups(batches, ["conv_id"], ["patch_id", "dependencies"]):
            depth, child = _depths(ids, deps)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(ids), pa.int64()), pa.array(ids, pa.string()), pa.array(depth, pa.int32()), pa.array(child, pa.bool_())], schema=schema)

    rows = memory.where(~F.col("conv_id").isin(hot)) if hot else memory
    out = rows.select("conv_id", "patch_id", "dependencies").repartition(n, "conv_id").sortWithinPartitions("conv_id").mapInArrow(run, "conv_id BIGINT, patch_id STRING, causal_depth INT, has_child BOOLEAN")
    if not hot:
        return out
    large = materialize(memory.where(F.col("conv_id").isin(hot)).select("conv_id", "patch_id", "dependencies"), "large")
    edges = materialize(dependency_edges(large), "edges")
    front = materialize(large.where("size(dependencies) = 0").select("conv_id", "patch_id", F.lit(0).alias("causal_depth")), "front")
    seen, d = front, 0
    while not front.isEmpty():
        d += 1
        step = edges.join(front.select("conv_id", F.col("patch_id").alias("dep")), ["conv_id", "dep"], "left_semi").select("conv_id", "patch_id").distinct()
        front = materialize(step.join(seen, ["conv_id", "patch_id"], "left_anti").withColumn("causal_depth", F.lit(d)), "front")
        seen = seen.unionByName(front)
    child = edges.select("conv_id", F.col("dep").alias("patch_id")).distinct().withColumn("has_child", F.lit(True))
    deep = large.select("conv_id", "patch_id").join(seen, ["conv_id", "patch_id"], "left").join(child, ["conv_id", "patch_id"], "left")
    return out.unionByName(deep.select("conv_id", "patch_id", F.coalesce("causal_depth", F.lit(0)).alias("causal_depth"), F.coalesce("has_child", F.lit(False)).alias("has_child")))


def t4_prune(memory: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Drops non-critical rows that lie between a root and a dependent; the others get causal_depth."""
    depths = causal_depths(memory, block_rows)
    return memory.join(depths, ["conv_id", "patch_id"]).where(is_critical() | (F.col("causal_depth") == 0) | ~F.col("has_child")).drop("has_child")


def merge_memory(memory: DataFrame, cfg: MemoryConfig | None = None) -> DataFrame:
    """The ordered merge of all rows into each conversation's memory: (conv_id, row_id, kept, superseded_by).

    A row is skipped (kept false, superseded_by null) if its fingerprint is in memory; a critical row removes stored critical
    rows of its slot key whose words overlap enough.  Rows act on each other only through an equal fingerprint or an equal
    slot key, and both imply an equal topic, so the fold runs per conversation and topic over streamed, sorted rows; only the
    rows in memory are held.
    """
    cfg = cfg or MemoryConfig()
    overlap, bypass = cfg.revision_overlap, cfg.critical_bypass
    columns = ["conv_id", "topic", "row_id", "patch_type", "payload", "fingerprint", "slot_key"]
    schema = pa.schema([("conv_id", pa.int64()), ("row_id", pa.int64()), ("kept", pa.bool_()), ("superseded_by", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        stored: dict[str, dict[int, frozenset]] = defaultdict(dict)  # critical rows by slot key
        prints: dict[str, int] = {}
        of: dict[int, str] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            rows: list[tuple] = []
            for conv, topic, row, kind, payload, print_, slot in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if (conv, topic) != key:
                    rows += [(key[0], r, True, None) for s in stored.values() for r in s] if key else []
                    key = (conv, topic)
                    stored.clear()
                    prints.clear()
                    of.clear()
                critical = kind in CRITICAL
                if prints.get(print_) and not (bypass and critical):
                    rows.append((conv, row, False, None))
                    continue
                if critical:
                    words = frozenset(payload.lower().split())
                    chain = stored[slot]
                    for r in [r for r, ws in chain.items() if len(ws & words) / max(1, len(ws | words)) >= overlap]:
                        rows.append((conv, r, False, row))
                        del chain[r]
                        prints[of[r]] -= 1
                    chain[row] = words
                    of[row] = print_
                else:
                    rows.append((conv, row, True, None))
                prints[print_] = prints.get(print_, 0) + 1
            yield batch(rows)
        if key:
            yield batch([(key[0], r, True, None) for s in stored.values() for r in s])

    spark = memory.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = memory.withColumn("topic", F.substring_index("slot_key", "::", -1)).select(*columns, "turn_index")
    rows = rows.repartition(n, "conv_id", "topic").sortWithinPartitions("conv_id", "topic", "turn_index", "row_id")
    return rows.select(*columns).mapInArrow(run, "conv_id BIGINT, row_id BIGINT, kept BOOLEAN, superseded_by BIGINT")
