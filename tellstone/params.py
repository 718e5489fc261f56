"""Thresholds of all detectors and of the score, in one place."""
from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Snap:
    lookback_ticks: int = 32
    lookahead_ticks: int = 20
    off_target_deg: float = 12.0
    on_target_deg: float = 2.5
    max_transition_ticks: int = 3
    extreme_angvel: float = 45.0
    low_jitter_deg: float = 0.35
    min_jitter_samples: int = 4
    jitter_window_deg: float = 4.0
    post_lock_max_stdev: float = 1.0
    post_lock_min_ticks: int = 4


@dataclass(frozen=True)
class Reaction:
    fov_deg: float = 55.0
    max_range: float = 3000.0
    impossible_ms: float = 90.0
    fast_ms: float = 140.0
    low_stdev_ms: float = 25.0
    min_samples: int = 5
    steady_deg_per_tick: float = 3.0
    steady_ticks: int = 5


@dataclass(frozen=True)
class Tracking:
    lock_deg: float = 4.0
    min_distance: float = 900.0
    min_lock_ticks: int = 24
    ignore_window_ticks: int = 96
    min_target_travel_deg: float = 8.0


@dataclass(frozen=True)
class Recoil:
    max_gap_ticks: int = 12
    min_shots: int = 5
    perfect_error_deg: float = 1.2
    flat_spread_deg: float = 0.8
    min_bursts: int = 4


@dataclass(frozen=True)
class Movement:
    teleport_deg: float = 90.0
    snap_back_deg: float = 25.0
    return_window_ticks: int = 3
    return_tolerance_deg: float = 2.0
    min_ticks: int = 2000


@dataclass(frozen=True)
class Context:
    min_kills: int = 8
    smoke_rate: float = 0.12
    wallbang_rate: float = 0.18
    noscope_rate: float = 0.20


@dataclass(frozen=True)
class Cursor:
    min_samples: int = 400
    min_presses: int = 20
    min_speed: float = 0.5
    human_jerk: float = 0.55
    smooth_jerk: float = 0.12
    jump_speed: float = 60.0
    stop_speed: float = 1.0
    human_key_spread: float = 0.35
    robot_key_spread: float = 0.06


@dataclass(frozen=True)
class Burst:
    window_ms: float = 1200.0
    min_burst_kills: int = 3
    min_kills: int = 6
    min_gap_samples: int = 8
    fast_gap_ms: float = 900.0


#: The share of each signal in the score.
WEIGHTS = {
    "snap": 0.28, "jitter": 0.17, "reaction": 0.20, "tracking": 0.25, "prefire": 0.10, "burst": 0.12,
    "recoil": 0.18, "movement": 0.22, "context": 0.14, "tremor": 0.30, "cursor_jump": 0.22, "key_timing": 0.26,
}


@dataclass(frozen=True)
class Scoring:
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    unconfident_weight: float = 0.35
    strong_value: float = 0.55
    corroboration: float = 0.08
    review_threshold: float = 55.0
    min_kills_for_score: int = 6
    weak_only_cap: float = 60.0


@dataclass(frozen=True)
class Params:
    snap: Snap = field(default_factory=Snap)
    reaction: Reaction = field(default_factory=Reaction)
    tracking: Tracking = field(default_factory=Tracking)
    recoil: Recoil = field(default_factory=Recoil)
    movement: Movement = field(default_factory=Movement)
    context: Context = field(default_factory=Context)
    cursor: Cursor = field(default_factory=Cursor)
    burst: Burst = field(default_factory=Burst)
    scoring: Scoring = field(default_factory=Scoring)
    #: Ticks a second by which milliseconds become ticks, whatever a match's own rate is.
    tickrate: float = 64.0

    def ticks(self, ms: float) -> float:
        return ms * self.tickrate / 1000

    def ms(self, ticks):
        return ticks * 1000.0 / self.tickrate


def overlay(base, changes: dict):
    """base with the values in changes; unknown keys are passed over, weights are merged."""
    new = {}
    for f in fields(base):
        if f.name in changes:
            old, value = getattr(base, f.name), changes[f.name]
            new[f.name] = overlay(old, value) if is_dataclass(old) else old | value if isinstance(old, dict) else type(old)(value)
    return replace(base, **new)


def load(path: str | None = None, env: str = "TELLSTONE_PARAMS") -> Params:
    """Defaults with the JSON file laid over them, by path or by the environment variable."""
    path = path or os.environ.get(env)
    if not path or not os.path.exists(path):
        return Params()
    with open(path, encoding="utf-8") as f:
        return overlay(Params(), json.load(f))


def save(params: Params, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(params), f, indent=2)
