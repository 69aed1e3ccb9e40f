"""One synthetic series, from the seed, the pool's name and its number alone."""

from __future__ import annotations

import json
import zlib

import numpy as np

from ..config import PoolConfig
from .events import INJECTORS, Scene, rounded
from .processes import PROCESSES


def stream(config: PoolConfig, index: int) -> np.random.Generator:
    """The random numbers of series number index, whichever others are made."""
    return np.random.default_rng(np.random.SeedSequence(config.seed, spawn_key=(zlib.crc32(config.group.encode()), index)))


def _events(scene: Scene, family: str, points: int) -> None:
    config, n, floor = scene.config, len(scene.x), 0
    if config.certify and family != "point":
        floor = config.min_event_points.get(family, 4)
        if scene.period and family in ("seasonality", "level_shift", "trend"):
            floor = max(floor, (2 if family == "seasonality" else config.min_periods) * scene.period + 2)
        floor = min(floor, n)
    two = family != "point" and scene.rng.random() < config.two_events and points >= 2 * max(floor, 4)
    for share in (0.6, 0.4) if two else (1.0,):
        INJECTORS[family](scene, max(max(4, round(points * share)), floor))


def generate_series(index: int, config: PoolConfig) -> tuple[np.ndarray, np.ndarray, dict]:
    """Values, labels and metadata."""
    rng = stream(config, index)
    n = int(rng.integers(config.length_range[0], config.length_range[1] + 1))
    base = config.base_types[rng.integers(len(config.base_types))]
    x, params = PROCESSES[base](rng, n, config)
    offset = float(rng.uniform(*config.baseline_offset))
    x = x + offset
    params["baseline"] = round(offset, 3)

    family, severity, target, segments = "none", 0.0, 0.0, []
    if rng.random() < config.anomaly_rate:
        family = config.families[rng.integers(len(config.families))]
        usual = config.point_fraction_range if family == "point" and config.certify else config.fraction_range
        low, high = config.fraction_overrides.get(family, usual)
        span = config.severity_overrides.get(family, config.severity_range)
        target, severity = float(np.exp(rng.uniform(np.log(low), np.log(high)))), float(rng.uniform(*span))
        scene = Scene(rng, x, base, params, config, severity, span)
        _events(scene, family, max(4, round(n * target)))
        segments, x = scene.events, scene.x
        if not segments:
            family, severity, target = "none", 0.0, 0.0
    labels = np.zeros(n, dtype=np.int8)
    for e in segments:
        labels[e.start : e.end] = 1

    anomalous = int(labels.sum())
    weakest = lambda key, other: min((e.detail.get(key, other) for e in segments), default=0.0)
    return x, labels, {
        "series_id": f"{config.group}__SYNTH__{base}-{index:05d}_full", "length": n, "num_point_anomalies": anomalous, "y_i": int(anomalous > 0), "is_split": False, "original_length": n,
        "source_notes": f"synthetic;base={base};anomaly={family}", "base_type": base, "base_params": json.dumps({k: rounded(v) for k, v in params.items()}), "anomaly_type": family,
        "severity": round(severity, 4), "num_segments": len(segments), "segments": json.dumps([e.as_dict() for e in segments]), "severity_effective": round(float(weakest("severity_effective", severity)), 4),
        "detect_z": round(float(weakest("snr", 0.0)), 2), "anomaly_fraction": round(anomalous / n, 6), "target_fraction": round(target, 6),
    }
