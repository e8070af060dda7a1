"""Policies: which aggregation, scale, calibrator and normalizer to use. Resolved to columns at plan time."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column

from .functions import scores as s

COHORTS = ("code_economy", "state_cardinality_type", "state_cardinality_function", "bloat_function", "coupling_module")
DIMENSIONS = ("duplication", "code_economy", "state_cardinality", "bloat", "coupling_density")


@dataclass(frozen=True)
class Aggregation:
    """``kind`` with its parameters; see ``operators.aggregates``."""

    kind: str = "geometric_mean_score"
    p: float = 2.0
    alpha: float = 0.1
    tail_weight: float = 1.0
    size_weighting: str = "sqrt"


@dataclass(frozen=True)
class Calibrator:
    kind: str = "capped_reciprocal_score"
    half_life: float = 1.0
    shape: float = 1.0
    zero_at: float = 2.0

    def score(self, n: Column) -> Column:
        if self.kind == "capped_reciprocal_score":
            return s.capped_reciprocal(n)
        if self.kind == "exponential_decay_score":
            return s.exponential_decay(n, self.half_life)
        if self.kind == "linear_decay_score":
            return s.linear_decay(n, self.zero_at)
        if self.kind == "stretched_exponential_decay":
            return s.stretched_decay(n, self.half_life, self.shape)
        raise ValueError(f"unknown calibrator {self.kind!r}")


@dataclass(frozen=True)
class Strategy:
    """How a cohort's threshold is found; see ``operators.cohorts``."""

    kind: str = "use_target_threshold"
    multiplier: float = 1.0
    stddev_multiplier: float = 1.0
    iqr_multiplier: float = 1.0
    min_count: int = 5


@dataclass(frozen=True)
class Scales:
    """Target thresholds on the raw scales."""

    code_economy_log2_overhead: float = math.log2(5)
    state_cardinality_log2: float = 4.0
    bloat_log2_lines: float = math.log2(45)
    coupling_density_edges: float = 3.0

    def of(self, cohort: str) -> float:
        return {
            "code_economy": self.code_economy_log2_overhead,
            "state_cardinality_type": self.state_cardinality_log2,
            "state_cardinality_function": self.state_cardinality_log2,
            "bloat_function": self.bloat_log2_lines,
            "coupling_module": self.coupling_density_edges,
        }[cohort]


@dataclass(frozen=True)
class Policy:
    directional: Scales = field(default_factory=Scales)
    normalization: dict[str, Strategy] = field(default_factory=dict)
    calibration: dict[str, Calibrator] = field(default_factory=dict)
    state_cardinality_aggregation: Aggregation = field(default_factory=Aggregation)
    bloat_aggregation: Aggregation = field(default_factory=Aggregation)
    coupling_density_aggregation: Aggregation = field(default_factory=Aggregation)
    objective_scalarization: str = "geometric_mean_score"

    def calibrator(self, cohort: str) -> Calibrator:
        """An override, else the pipeline's own choice for the cohort."""
        if cohort in self.calibration:
            return self.calibration[cohort]
        if cohort == "bloat_function":
            return Calibrator("stretched_exponential_decay", half_life=1.0, shape=3.0)
        if cohort.startswith("state_cardinality"):
            return Calibrator("stretched_exponential_decay", half_life=1.0, shape=2.0)
        return Calibrator("exponential_decay_score", half_life=1.0)

    def strategy(self, cohort: str) -> Strategy:
        return self.normalization.get(cohort, Strategy())

    def aggregation(self, dimension: str) -> Aggregation:
        return getattr(self, f"{dimension}_aggregation")

    @classmethod
    def from_dict(cls, d: dict) -> Policy:
        """Groups and fields that are missing take their defaults; unknown keys are an error."""
        d = dict(d)
        agg = dict(d.pop("aggregation", {}))
        scalar = agg.pop("objective_scalarization", {"kind": "geometric_mean_score"})
        out = cls(
            directional=Scales(**d.pop("directional", {})),
            normalization={k: Strategy(**v) for k, v in d.pop("normalization", {}).get("overrides", {}).items()},
            calibration={k: Calibrator(**v) for k, v in d.pop("calibration", {}).get("overrides", {}).items()},
            objective_scalarization=scalar["kind"] if isinstance(scalar, dict) else scalar,
            **{k: Aggregation(**v) for k, v in agg.items()},
        )
        if d:
            raise ValueError(f"unknown policy groups {sorted(d)}")
        return out

    @classmethod
    def load(cls, path: str | Path) -> Policy:
        return cls.from_dict(json.loads(Path(path).read_text()))

    def to_dict(self) -> dict:
        return {
            "directional": asdict(self.directional),
            "normalization": {"overrides": {k: asdict(v) for k, v in self.normalization.items()}},
            "calibration": {"overrides": {k: asdict(v) for k, v in self.calibration.items()}},
            "aggregation": {
                **{f"{x}_aggregation": asdict(self.aggregation(x)) for x in ("state_cardinality", "bloat", "coupling_density")},
                "objective_scalarization": {"kind": self.objective_scalarization},
            },
        }
