"""Row types and constants of the memory engine."""

from __future__ import annotations

from dataclasses import dataclass

# The patch types with tag, criticality, share of the budget and score boost.
TYPES: dict[str, tuple[str, bool, float, float]] = {
    "constraint": ("CON", True, 0.25, 0.20),
    "decision": ("DEC", True, 0.15, 0.18),
    "slot": ("SLOT", False, 0.30, 0.0),
    "code": ("CODE", False, 0.05, 0.12),
    "equation": ("EQ", False, 0.10, 0.10),
    "entity": ("ENT", False, 0.10, 0.06),
    "structure": ("STR", False, 0.05, 0.04),
}
CRITICAL = [t for t, v in TYPES.items() if v[1]]

# Words that never name a topic.
TOPIC_STOP_WORDS = (
    "max maximum min minimum must mustnt the all always never not no non use using set add update change is are was were be been "
    "for per each every any and or but if when then a an in on at to of by do does did done this that these those it its they them their "
    "will would should could can has have had"
).split()
# Units kept by the compact form.
UNITS = "s h m min max kb mb gb ms sec hour day week year req rpm rps vcpu ram cpu".split()
# Marks of a revision.
REVISION_MARKS = ["revis", "chang", "updat", "from", "->", "to"]


@dataclass(frozen=True)
class MemoryConfig:
    """Parameters of compression; a budget below 1 is refused."""

    budget: int = 400
    auto_budget: bool = False
    context_window: int = 8192
    response_reserve: int = 2000
    embedder: str = "hash"  # or "zero"
    max_payload_chars: int = 200
    revision_overlap: float = 0.40
    alpha_ema: float = 0.5
    shadow_threshold: float = 0.01
    recency_lambda: float = 0.15
    delta_min_saving: int = 1
    w_align: float = 0.45
    w_dep: float = 0.20
    w_recency: float = 0.15
    w_cost: float = 0.20
    critical_bypass: bool = False

    def __post_init__(self) -> None:
        if self.budget < 1:
            raise ValueError(f"the budget must be at least 1, not {self.budget}")


MEMORY_FILE = (
    "version STRING, budget INT, turn_index INT, patches ARRAY<STRUCT<patch_id: STRING, turn_index: INT, patch_type: STRING, payload: STRING, "
    "dependencies: ARRAY<STRING>, utility: DOUBLE, is_delta: BOOLEAN, delta_base: STRING, causal_depth: INT>>"
)
