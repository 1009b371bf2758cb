"""Frozen configuration records and the cache tag derived from all their fields."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

# Probabilities are kept inside (EPS, 1 - EPS), pairs that are not at risk sit on EPS.
EPS = 1e-6
# Fixed value: days in a mean calendar year.
YEAR_DAYS = 365.25


@dataclass(frozen=True)
class Span:
    """A calendar length: ``n`` years or ``n`` days."""

    n: int
    unit: str = "year"


@dataclass(frozen=True)
class TableSpec:
    """Declares how one event table is read."""

    name: str
    kind: str
    time: str
    code: str
    subject: str = "PATIENT"
    stop: str | None = None
    reason: str | None = None
    reason_is_code: bool = True
    value: str | None = None
    value_type: str | None = None
    costs: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        named = [self.time, self.subject, self.code, self.stop, self.reason, self.value, self.value_type]
        return list(dict.fromkeys([c for c in named if c] + list(self.costs)))


@dataclass(frozen=True)
class TimelineSpec:
    """What a family of timelines has in common."""

    window: Span
    visit_kind: str
    kind_order: tuple[str, ...]
    date_only: tuple[str, ...] = ()
    target_kind: str = "COND"
    demographics: tuple[str, ...] = ()


@dataclass(frozen=True)
class ExampleConfig:
    stride: Span = Span(5)
    window: Span = Span(5)
    min_events: int = 10
    augment_splits: tuple[str, ...] = ()
    max_extra: int | None = None


@dataclass(frozen=True)
class FeatureConfig:
    """``windows`` are days; the unbounded window is always added as ``ever``."""

    windows: tuple[float, ...] = (365.0, 1825.0)
    rate_window: float = 730.0
    min_subjects: int = 5
    n_bins: int = 10
    lab_min_coverage: float = 0.05
    n_common: int = 20
    cap_days: float = 3650.0
    shape_kinds: tuple[str, ...] = ("ENC", "COND", "MED", "PROC", "OBS", "IMM")
    kinds: tuple[str, ...] | None = None


@dataclass(frozen=True)
class SequenceConfig:
    block_size: int = 512
    min_subjects: int = 5
    n_bins: int = 10
    min_events_per_bin: int = 50
    adaptive_bins: bool = False
    text_answers: bool = False
    post_anchor_vocab: bool = False


@dataclass(frozen=True)
class LogisticConfig:
    C: float = 0.03
    max_iter: int = 2000
    log1p_counts: bool = True


@dataclass(frozen=True)
class TreeConfig:
    learning_rate: float = 0.05
    max_iter: int = 300
    max_leaf_nodes: int = 15
    min_samples_leaf: int = 5
    l2_regularization: float = 1.0
    max_bins: int = 255


def config_tag(*configs) -> str:
    """Key that changes when any field of any given record changes."""
    blob = json.dumps([{type(c).__name__: asdict(c)} for c in configs], sort_keys=True, default=str)
    return hashlib.sha256(blob.encode()).hexdigest()[:16]
