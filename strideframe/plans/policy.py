"""Versioned thresholds. Every operator takes one of these; the defaults are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Court:
    """A court in feet: x across, y along; the net is at half length."""

    width: float = 20.0
    length: float = 44.0
    kitchen_depth: float = 7.0
    transition_depth: float = 8.0
    margin: float = 3.0

    @property
    def net(self) -> float:
        return self.length / 2


@dataclass(frozen=True)
class MovementPolicy:
    max_gap_us: int = 1_000_000
    max_step: float = 15.0
    side_uncertainty: float = 2.5
    feet_to_metres: float = 0.3048


@dataclass(frozen=True)
class Eligibility:
    duration: float = 1.0
    observations: int = 3
    inside_ratio: float = 0.6
    extended_ratio: float = 0.6
    rate: float = 1.2
    confidence: float = 0.4


@dataclass(frozen=True)
class AssociationPolicy:
    max_gap: float = 15.0
    short_gap: float = 0.75
    endpoint: float = 14.0
    speed: float = 18.0
    area_ratio: float = 1.75
    appearance: float = 0.70
    reentry_appearance: float = 0.96
    reentry_duration: float = 0.5
    overlap: float = 0.0
    default_interval: float = 1 / 30

    def __post_init__(self):
        if min(self.max_gap, self.endpoint, self.speed, self.default_interval) <= 0 or self.area_ratio < 1 or self.short_gap > self.max_gap:
            raise ValueError("limits of an association policy must be positive, and a short gap no longer than the longest")


@dataclass(frozen=True)
class ActivityPolicy:
    window_us: int = 3_000_000
    half_smoothing_us: int = 250_000
    min_dt_us: int = 80_000
    max_gap_us: int = 750_000
    moving_speed: float = 0.80
    stationary_speed: float = 0.30
    reference_speed: float = 4.0
    active_intensity: float = 0.25
    idle_intensity: float = 0.12
    direction_degrees: float = 50.0
    direction_speed: float = 0.50
    coverage: float = 0.55
    min_moving_share: float = 0.5 / 3
    min_simultaneous_share: float = 0.35 / 3
    min_players: int = 2
    minor_gap: float = 0.15
    severe_gap: float = 0.35
    idle_stationary: float = 0.55


@dataclass(frozen=True)
class BallPolicy:
    base: float = 42.0
    per_gap: float = 24.0
    velocity_factor: float = 2.5
    interpolate: int = 4
    restart: int = 8
    min_segment: int = 3
    min_observations: int = 3
    interpolated_confidence: float = 0.6

    def __post_init__(self):
        if self.base <= 0 or min(self.per_gap, self.velocity_factor, self.interpolate) < 0 or self.restart < self.interpolate:
            raise ValueError("distances and gaps of a ball policy must be positive, and a restart no earlier than interpolation ends")


#: The driver's `events` are hours apart: the same operators with thresholds on that scale.
EVENT_MOVEMENT = MovementPolicy(max_gap_us=21_600_000_000)
EVENT_ASSOCIATION = AssociationPolicy(max_gap=172_800.0, short_gap=64_800.0, speed=1.5e-4, reentry_duration=432_000.0)
EVENT_ACTIVITY = ActivityPolicy(
    window_us=86_400_000_000,
    half_smoothing_us=14_400_000_000,
    min_dt_us=600_000_000,
    max_gap_us=21_600_000_000,
    moving_speed=0.80 / 1600,
    stationary_speed=0.30 / 1600,
    reference_speed=4.0 / 1600,
    direction_speed=0.50 / 1600,
    coverage=0.05,
)
