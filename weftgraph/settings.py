"""Typed, range-checked parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# The published defaults of the alignment method.
MAX_CAPACITY = 1e10
NEIGHBOR_DIRECTIONS = ("descendant", "ancestor", "all")
HMEAN_MODES = ("strict", "reference")


def _dampen() -> dict[str, float]:
    return {"sentence": 1.0, "concept": 2.0, "neighborhood": 2.0, "attribute": 0.8}


@dataclass(frozen=True)
class AlignSettings:
    """Parameters of similarity, thresholds and the alignment loop."""

    similarity_dampen_exp: dict[str, float] = field(default_factory=_dampen)
    role_neighbor_weight: float = 0.3
    role_weight: float = 0.5
    concept_token_weight: float = 0.4
    concept_roleset_weight: float = 0.4
    concept_roles_weight: float = 0.2
    neighbor_direction: str = "all"
    neighbor_weights: tuple[float, ...] = (0.0, 1.0, 0.1, 0.1)
    skew_y: float = -0.5
    skew_x: float = 0.5
    skew_compress: float = 1.0
    sentence_dampen: float = 0.5
    similarity_threshold: float = 0.3
    alignment_capacity: float = 1.0
    doc_capacity: float = MAX_CAPACITY
    sink_capacity: float = MAX_CAPACITY
    align_min_capacity: float = 0.1
    role_min_flow: float = 0.1
    capacity_min: float = 0.0
    max_loops: int = 30
    hmean: str = "strict"
    block_rows: int = 1024

    def __post_init__(self) -> None:
        unit = ("sentence_dampen", "similarity_threshold")
        for name in unit:
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        non_negative = (
            "role_neighbor_weight", "role_weight", "concept_token_weight",
            "concept_roleset_weight", "concept_roles_weight", "alignment_capacity",
            "align_min_capacity", "role_min_flow", "capacity_min",
        )
        for name in non_negative:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.neighbor_direction not in NEIGHBOR_DIRECTIONS:
            raise ValueError(f"neighbor_direction must be one of {NEIGHBOR_DIRECTIONS}")
        if self.hmean not in HMEAN_MODES:
            raise ValueError(f"hmean must be one of {HMEAN_MODES}")
        unknown = set(self.similarity_dampen_exp) - set(_dampen())
        if unknown:
            raise ValueError(f"unknown dampening keys: {sorted(unknown)}")
        if not self.neighbor_weights:
            raise ValueError("neighbor_weights must not be empty")
        if self.max_loops < 1 or self.block_rows < 1:
            raise ValueError("max_loops and block_rows must be positive")

    def exponent(self, kind: str) -> float:
        """Dampening exponent of a similarity kind (1 when none is set)."""
        return float(self.similarity_dampen_exp.get(kind, 1.0))

    def with_values(self, **changes) -> "AlignSettings":
        names = {f.name for f in fields(self)}
        unknown = set(changes) - names
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **changes)
