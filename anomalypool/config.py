"""Settings of the sampler and of the generator, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class SamplerConfig:
    """How recordings become samples and samples a pool."""

    split_threshold: int = 15_000
    base_chunk: int = 1_500
    min_length: int = 1_000
    max_length: int = 35_000
    max_anomaly_ratio: float = 0.30
    stats_tolerance: float = 1.5
    reference_clip: float = 5.0
    period_range: tuple[int, int] = (25, 5_000)
    periods_per_chunk: int = 3
    min_length_for_period: int = 150
    period_clip: float = 8.0
    pool_size: int | None = 2_900
    positive_rate: float | None = 0.25
    recording_share: float | None = 0.05
    samples_per_recording: int | None = None
    seed: int = 42
    dev_fraction: float = 0.30
    # the older way of cutting, which follows the labels
    legacy: bool = False
    legacy_chunk_max: int = 8_000
    legacy_target_ratio: float = 0.06
    legacy_acceptable_ratio: float = 0.15
    legacy_max_ratio: float = 0.27
    legacy_tolerance: float = 0.65
    lookahead: int = 100

    def __post_init__(self) -> None:
        _need(0 < self.max_anomaly_ratio < 1, "max_anomaly_ratio must lie between 0 and 1")
        _need(self.stats_tolerance > 0, "stats_tolerance must be positive")
        _need(0 < self.min_length <= self.base_chunk <= self.max_length, "lengths must satisfy 0 < min_length <= base_chunk <= max_length")
        _need(0 < self.legacy_target_ratio <= self.legacy_acceptable_ratio <= self.legacy_max_ratio < 1, "legacy ratios must rise between 0 and 1")
        _need(not self.legacy or self.base_chunk <= self.legacy_chunk_max <= self.max_length, "legacy_chunk_max must lie between base_chunk and max_length")
        _need(self.positive_rate is None or 0 <= self.positive_rate <= 1, "positive_rate must lie within 0 and 1")
        _need(0 < self.dev_fraction < 1, "dev_fraction must lie between 0 and 1")


POOLS = {"S1": ("white_noise", "ar1", "ar2"), "S2": ("linear_trend", "seasonal_sine", "trend_seasonal")}
FAMILIES = ("point", "group", "level_shift", "variance", "trend", "seasonality", "flatline")
BASES = POOLS["S1"] + POOLS["S2"]


@dataclass(frozen=True)
class PoolConfig:
    """A synthetic pool: which processes, which anomalies, how many and how strong."""

    group: str = "S1"
    num_series: int = 2_000
    base_types: tuple[str, ...] = POOLS["S1"]
    families: tuple[str, ...] = FAMILIES
    anomaly_rate: float = 0.25
    length_range: tuple[int, int] = (1_000, 4_000)
    fraction_range: tuple[float, float] = (0.01, 0.20)
    point_fraction_range: tuple[float, float] = (0.004, 0.025)
    severity_range: tuple[float, float] = (2.6, 3.6)
    severity_overrides: dict = field(default_factory=lambda: {"point": (2.6, 3.1), "group": (2.8, 3.6)})
    fraction_overrides: dict = field(default_factory=dict)
    certify: bool = True
    floor_z: float = 5.0
    min_event_points: dict = field(default_factory=lambda: {"group": 128, "level_shift": 24, "variance": 64, "trend": 48, "seasonality": 48, "flatline": 24})
    min_periods: int = 2
    two_events: float = 0.25
    event_margin: int = 25
    baseline_offset: tuple[float, float] = (-50.0, 50.0)
    heavy_tail: float = 0.25
    heavy_tail_df: tuple[float, float] = (4.0, 10.0)
    heavy_tail_clip: float = 3.5
    noise_phi: tuple[float, float] = (0.0, 0.7)
    second_season: float = 0.35
    amplitude_modulation: float = 0.40
    dev_fraction: float = 0.30
    seed: int = 42

    def __post_init__(self) -> None:
        _need(self.num_series > 0, "num_series must be positive")
        _need(0 <= self.anomaly_rate <= 1, "anomaly_rate must lie within 0 and 1")
        _need(64 <= self.length_range[0] <= self.length_range[1], "length_range must rise from 64 at least")
        _need(0 < self.fraction_range[0] <= self.fraction_range[1] < 1, "fraction_range must rise between 0 and 1")
        _need(0 < self.severity_range[0] <= self.severity_range[1], "severity_range must rise from above 0")
        for what, names, known in (("base type", self.base_types, BASES), ("family", self.families, FAMILIES)):
            _need(bool(names) and set(names) <= set(known), f"unknown {what}: {sorted(set(names) - set(known))}")

    @classmethod
    def of(cls, group: str, **changes) -> "PoolConfig":
        _need(group in POOLS, f"unknown pool {group}")
        return cls(group=group, base_types=POOLS[group], **changes)
