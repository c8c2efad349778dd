"""Choice of a chat model and calls of a chat client from inside tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name parts that mark chat models, rule them out, and their points.
CHAT_HINTS = ["llama", "qwen", "gpt", "gemma", "mistral", "kimi", "deepseek", "phi", "instruct", "chat", "sonnet", "nova", "granite", "command"]
CHAT_EXCLUDES = ["guard", "embed", "whisper", "tts", "moderation", "safety", "flux", "stable", "diffusion", "rerank", "sora"]
POINTS = [("405b", 40), ("120b", 30), ("70b", 30), ("90b", 30), ("32b", 20), ("versatile", 15), ("instruct", 10), ("latest", 5), ("chat", 5)]
SMALL = ["8b", "9b", "4b", "3b", "1b", "mini", "small", "tiny", "22m", "86m"]
SMALL_POINTS = -15
RETRY_SECONDS = (1, 2, 5)
REMINDER = "\n\nReply with the JSON array only."


class FatalBackendError(RuntimeError):
    """The service refuses the key or the request; repeating is useless."""


def model_scores(models: DataFrame) -> DataFrame:
    """(model_id, pos, score) of the chat models among (model_id, pos)."""
    m = F.lower("model_id")
    hit = lambda parts: sum((m.contains(p).cast("int") for p in parts), F.lit(0)) > 0
    score = F.lit(0)
    for part, points in [*POINTS, *((s, SMALL_POINTS) for s in SMALL)]:
        score = score + F.when(m.contains(part), points).otherwise(0)
    return models.where(hit(CHAT_HINTS) & ~hit(CHAT_EXCLUDES)).select("model_id", "pos", score.alias("score"))


def pick_model(models: DataFrame, preferred: list[str] = ()) -> str | None:
    rows = {r.model_id for r in models.where(F.col("model_id").isin(list(preferred))).select("model_id").distinct().collect()} if preferred else set()
    for p in preferred:
        if p in rows:
            return p
    best = model_scores(models).agg(F.max_by("model_id", F.struct("score", (-F.col("pos")).alias("first")))).first()
    return best[0] if best else None


def call_model(turns: DataFrame, client: Callable[[], Callable[[str, str, int], str]], prompt: str, attempts: int = 3, max_tokens: int = 2000, on_error: str = "fail", wait: tuple[int, ...] = RETRY_SECONDS) -> DataFrame:
    """turns (conv_id, turn_index, text, context) with ``llm_response``, ``attempts``, ``error`` and ``failed`` (calls that raised).

    ``client`` is called once per task and gives a function (system prompt, user text, max tokens) -> reply.  Failed calls and
    empty replies are repeated inside the task; an empty one gets twice the tokens.  FatalBackendError is never repeated.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for f in frames:
            out = []
            for turn, text, context in zip(f.turn_index, f.text, f.context, strict=True):
                reply, error, room, k, failed = None, None, max_tokens, 0, 0
                for k in range(1, attempts + 1):
                    try:
                        reply = ask(prompt + (REMINDER if k > 1 else ""), f"Turn {turn}:\n{text}\n\nBefore it:\n{context}", room)
                    except FatalBackendError:
                        raise
                    except Exception as x:  # noqa: BLE001
                        error, failed = str(x)[:300], failed + 1
                    else:
                        if reply and reply.strip():
                            error = None
                            break
                        reply, error, room = None, "empty reply", room * 2
                    if k < attempts:
                        time.sleep(wait[min(k, len(wait)) - 1])
                if reply is None and on_error == "fail":
                    raise RuntimeError(f"no reply for turn {turn}: {error}")
                out.append((reply, k, error, failed))
            yield f.assign(llm_response=[o[0] for o in out], attempts=[o[1] for o in out], error=[o[2] for o in out], failed=[o[3] for o in out])

    rows = turns.select("conv_id", F.col("turn_index").cast("int").alias("turn_index"), "text", "context")
    return rows.mapInPandas(run, "conv_id BIGINT, turn_index INT, text STRING, context STRING, llm_response STRING, attempts INT, error STRING, failed INT")
