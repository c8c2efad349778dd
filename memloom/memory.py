"""The engine as an object: the memories of many conversations, held as a written table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators.extract import extract_items, extraction_errors, recent_turns
from memloom.operators.memory import MEMORY, is_critical, merge_memory
from memloom.plans import engine
from memloom.schema import MemoryConfig
from memloom.sources import memory_files
from memloom.sources.models import call_model
from memloom.sources.scratch import materialize
from memloom.sources.ship import ship

ROWS = "conv_id BIGINT, row_id BIGINT, patch_id STRING, turn_index INT, patch_type STRING, payload STRING, dependencies ARRAY<STRING>, utility DOUBLE, token_cost INT, fingerprint STRING, slot_key STRING"
PROMPT = "Extract the facts worth keeping from the turn as a JSON array of objects with type, payload, patch_id and dependencies."


class ConversationMemory:
    """add_turns -> get_context -> stats for all conversations of a table at once.

    Turns come with recorded replies (``llm_response``) or are sent to ``client`` (see ``call_model``).  Later batches merge
    into what is there; turns should come in order, since a turn numbered before stored ones is merged at its place.
    """

    def __init__(self, spark: SparkSession, cfg: MemoryConfig | None = None, client: Callable | None = None, on_error: str = "fail") -> None:
        ship(spark)
        self.spark, self.cfg, self.client, self.on_error = spark, cfg or MemoryConfig(), client, on_error
        self.reset()

    def reset(self) -> None:
        """Forgets rows, counters and the last context; the configuration stays."""
        self.rows = self.spark.createDataFrame([], ROWS)
        self.errors = self.spark.createDataFrame([], "conv_id BIGINT, turn_index INT, error_type STRING")
        self.tokens = self.spark.createDataFrame([], "conv_id BIGINT, conversation_tokens BIGINT")
        self.calls = self.spark.createDataFrame([], "conv_id BIGINT, llm_calls BIGINT, llm_errors BIGINT")
        self.contexts: DataFrame | None = None

    def set_budget(self, budget: int) -> None:
        self.cfg = replace(self.cfg, budget=budget)

    def add_turns(self, turns: DataFrame) -> DataFrame:
        """turns (conv_id, turn_index, role, text[, llm_response]); gives the rows extracted from them."""
        turns = turns.withColumn("turn_index", F.col("turn_index").cast("int"))
        sent = "llm_response" not in turns.columns
        if sent:
            if self.client is None:
                raise RuntimeError("turns without recorded replies need a client")
            turns = call_model(recent_turns(turns), self.client, PROMPT, on_error=self.on_error)
        turns = materialize(turns, "turns")
        if sent:
            made = turns.groupBy("conv_id").agg(F.sum("attempts").alias("llm_calls"), F.sum("failed").alias("llm_errors"))
            self.calls = materialize(self.calls.unionByName(made).groupBy("conv_id").agg(F.sum("llm_calls").alias("llm_calls"), F.sum("llm_errors").alias("llm_errors")), "calls")
        spoken = turns.groupBy("conv_id").agg(F.sum(text.count_tokens(F.col("text"))).alias("conversation_tokens"))
        self.tokens = materialize(self.tokens.unionByName(spoken).groupBy("conv_id").agg(F.sum("conversation_tokens").alias("conversation_tokens")), "spoken")
        self.errors = materialize(self.errors.unionByName(extraction_errors(turns)), "errors")
        new = extract_items(turns).withColumn("row_id", F.col("turn_index").cast("long") * (1 << 20) + F.col("item_no")).withColumn("utility", F.lit(0.0)).select(*MEMORY)
        return self._merge(materialize(new, "new"))

    def _merge(self, new: DataFrame) -> DataFrame:
        top = self.rows.agg(F.max("row_id")).first()[0]
        # Ids above all that are there keep rows apart that are delivered or loaded again.
        shifted = new if top is None else new.withColumn("row_id", F.col("row_id") + (((top >> 40) + 1) << 40))
        rows = materialize(self.rows.unionByName(shifted), "rows")
        kept = merge_memory(rows, self.cfg).where("kept").select("conv_id", "row_id")
        self.rows = materialize(rows.join(kept, ["conv_id", "row_id"], "left_semi").select(*MEMORY), "memory")
        return new

    def get_context(self, queries: DataFrame | None = None) -> DataFrame:
        """Contexts per conversation for queries (conv_id, query, query_turn)."""
        self.contexts = materialize(engine.compress(self.rows, queries, self.cfg), "contexts")
        return self.contexts

    def stats(self) -> DataFrame:
        built = self.contexts if self.contexts is not None else self.spark.createDataFrame([], "conv_id BIGINT, status STRING, n_selected BIGINT, context_tokens BIGINT, critical_selected BIGINT, budget INT")
        return engine.stats(self.rows, built, self.tokens, self.calls)

    @property
    def all_patches(self) -> DataFrame:
        return self.rows

    @property
    def critical_patches(self) -> DataFrame:
        return self.rows.where(is_critical())

    @property
    def error_log(self) -> DataFrame:
        return self.errors

    def save(self, path: str) -> None:
        memory_files.save_memory(self.rows, path, self.cfg.budget)

    def load(self, path: str, strict: bool = False) -> None:
        """Merges saved rows into the memory; derived fields are computed anew."""
        rows = memory_files.load_memory(self.spark, path, strict)
        kind, payload = F.col("patch_type"), F.col("payload")
        rows = rows.withColumn("payload", text.normalize_payload(payload)).withColumn("token_cost", text.token_cost(kind, payload)).withColumn("fingerprint", text.fingerprint(payload)).withColumn("slot_key", text.slot_key(kind, payload))
        self._merge(rows.withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>"))).withColumn("utility", F.coalesce("utility", F.lit(0.0))).select(*MEMORY))
