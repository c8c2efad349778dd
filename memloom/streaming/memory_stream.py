"""Incremental merge of arriving memory rows with state per cell of conversations and topics."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.operators.memory import is_critical
from memloom.schema import CRITICAL, MemoryConfig

COLUMNS = ["conv_id", "turn_index", "row_id", "patch_type", "payload", "fingerprint", "slot_key"]
OUTPUT = "conv_id BIGINT, topic STRING, row_id BIGINT, event STRING, other BIGINT"
STATE = "stored STRING"
CELLS = 4096


class _Group:
    """What is in memory for one conversation and topic, all that a new row can act on."""

    def __init__(self, last: int = -1, others: Iterable[str] = (), criticals: Iterable[list] = ()) -> None:
        self.last = last
        self.prints = dict.fromkeys(others, False)  # fingerprints, True of critical rows
        self.chains: dict[str, dict[str, tuple[int, frozenset]]] = defaultdict(dict)  # critical rows by slot key and fingerprint
        for slot, print_, row, words in criticals:
            self.prints[print_] = True
            self.chains[slot][print_] = row, frozenset(words.split())

    def dump(self) -> list:
        criticals = [[slot, print_, row, " ".join(sorted(words))] for slot, chain in self.chains.items() for print_, (row, words) in chain.items()]
        return [self.last, [p for p, critical in self.prints.items() if not critical], criticals]


def merge_stream(memory: DataFrame, cfg: MemoryConfig | None = None, cells: int = CELLS) -> DataFrame:
    """A stream of (conv_id, topic, row_id, event, other): kept, skipped, or superseded with the row that did it in ``other``.

    Rows act on each other only within a conversation and topic.  Most of these groups hold one or two rows, and a call of
    Python with its state costs as much as a hundred rows, so groups are hashed to ``cells``, and the state of a cell holds
    its groups.  A batch costs its rows and the stored rows of the cells that they meet.  The number of cells belongs to a
    checkpoint: state made with another number is refused where a row meets it.

    Rows are merged in order within a batch; a row whose turn lies before the last one of its group is merged late, with the
    event late_kept.  Over all batches the result equals ``operators.memory.merge_memory`` if rows arrive in order.
    """
    overlap = (cfg or MemoryConfig()).revision_overlap

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"cells": cells, "groups": []}
        if held["cells"] != cells:
            raise ValueError(f"the checkpoint was made with {held['cells']} cells, not {cells}")
        stored = {(conv, topic): rest for conv, topic, *rest in held["groups"]}
        groups: dict[tuple, _Group] = {}  # those that new rows meet
        new = [(*(x if x is None else int(x) for x in r[:3]), *r[3:]) for frame in frames for r in map(json.loads, frame["row"])]
        new.sort(key=lambda r: (r[1], r[2] is not None, r[2] or 0))
        out: list[tuple] = []
        for conv, turn, row, kind, payload, print_, slot, topic in new:
            group = groups.get((conv, topic))
            if group is None:
                group = groups[conv, topic] = _Group(*stored.pop((conv, topic), ()))
            if print_ in group.prints:
                out.append((conv, topic, row, "skipped", None))
                continue
            critical = kind in CRITICAL
            if critical:
                words, chain = frozenset(payload.lower().split()), group.chains[slot]
                for p in [p for p, (_, ws) in chain.items() if len(words & ws) / max(1, len(words | ws)) >= overlap]:
                    out.append((conv, topic, chain.pop(p)[0], "superseded", row))
                    del group.prints[p]
                chain[print_] = row, words
            group.prints[print_] = critical
            out.append((conv, topic, row, "kept" if turn >= group.last else "late_kept", None))
            group.last = max(group.last, turn)
        kept = [[*k, *rest] for k, rest in stored.items()] + [[*k, *g.dump()] for k, g in groups.items()]
        state.update((json.dumps({"cells": cells, "groups": kept}, ensure_ascii=False, separators=(",", ":")),))
        conv_id, topic, row_id, event, other = zip(*out, strict=True)
        ids = {n: pd.array(list(x), "Int64") for n, x in (("conv_id", conv_id), ("row_id", row_id), ("other", other))}
        yield pd.DataFrame({"conv_id": ids["conv_id"], "topic": topic, "row_id": ids["row_id"], "event": event, "other": ids["other"]})

    # One text column: pandas turns whole numbers with nulls into fractions, and each column of a group costs a conversion.
    topic = F.substring_index("slot_key", "::", -1)
    values = {c: F.col(c).cast("string") for c in COLUMNS} | {"payload": F.when(is_critical(), F.col("payload")), "topic": topic}
    rows = memory.select(F.pmod(F.xxhash64("conv_id", topic), F.lit(cells)).alias("cell"), F.to_json(F.array(*values.values())).alias("row"))
    return rows.groupBy("cell").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def kept_rows(events: DataFrame) -> DataFrame:
    """(conv_id, row_id) in memory after all events of a finished stream."""
    kept = events.where("event IN ('kept', 'late_kept')").select("conv_id", "row_id")
    return kept.join(events.where("event = 'superseded'").select("conv_id", "row_id"), ["conv_id", "row_id"], "left_anti")
