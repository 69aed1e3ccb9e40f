"""Kernels on inputs whose answer is known, and against plain versions."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anomalypool.config import PoolConfig, SamplerConfig
from anomalypool.kernels import generate, signal
from anomalypool.kernels.legacy import Cutter

RNG = np.random.default_rng(5)


def test_period_of_sine_with_spikes_and_trend():
    t = np.arange(3000)
    x = np.sin(2 * np.pi * t / 50) + 0.01 * t + 0.1 * RNG.normal(size=3000)
    x[RNG.integers(0, 3000, 20)] += 5
    assert abs(signal.detect_period(x) - 50) <= 1


@pytest.mark.parametrize("x", [np.zeros(3000), np.arange(3000.0), RNG.normal(size=3000), np.zeros(10)])
def test_no_period(x):
    assert signal.detect_period(x) is None


def test_fundamental_of_two_harmonics():
    t = np.arange(4000)
    assert signal.detect_period(np.sin(2 * np.pi * t / 80) + 0.6 * np.sin(4 * np.pi * t / 80)) == 80


def test_first_peak_of_the_older_way():
    assert signal.detect_period(np.sin(2 * np.pi * np.arange(3000) / 60), SamplerConfig(legacy=True)) == 60


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=80), st.floats(-0.9, 0.9), st.floats(-0.9, 0.9))
@settings(max_examples=50, deadline=None)
def test_ar_filter(noise, a, b):
    out = []
    for i, e in enumerate(noise):
        out.append(e + a * (out[i - 1] if i else 0) + b * (out[i - 2] if i > 1 else 0))
    assert np.allclose(signal.ar_filter(np.array(noise), (a, b)), out)


@given(st.lists(st.floats(-9, 9), min_size=1, max_size=60), st.sampled_from([1, 3, 5, 11]))
@settings(max_examples=50, deadline=None)
def test_rolling_median(x, width):
    x = np.array(x)
    at = np.clip(np.arange(len(x))[:, None] + np.arange(-(width // 2), width // 2 + 1), 0, len(x) - 1)
    assert np.allclose(signal.rolling_median(x, width), np.median(x[at], axis=1))


@given(st.integers(2, 200), st.integers(-3, 300))
def test_taper_is_zero_at_its_ends(n, ramp):
    w = signal.taper(n, ramp)
    assert w[0] == w[-1] == 0 and w.max() <= 1 and np.allclose(w, w[::-1])


@pytest.mark.parametrize("group", ["S1", "S2"])
@pytest.mark.parametrize("family", PoolConfig().families)
def test_events_are_found_and_labelled(group, family):
    config = PoolConfig.of(group, anomaly_rate=1.0, families=(family,))
    found = 0
    for i in range(12):
        x, y, meta = generate.generate_series(i, config)
        assert len(x) == len(y) == meta["length"] and np.isfinite(x).all() and set(np.unique(y)) <= {0, 1}
        assert meta["y_i"] == int(y.any()) and meta["num_point_anomalies"] == y.sum()
        if meta["num_segments"]:
            found += 1
            assert family == "flatline" or meta["detect_z"] >= 4.99
            assert meta["anomaly_fraction"] <= 0.5
    assert found >= 9


def test_a_series_depends_on_its_number_only():
    few, many = PoolConfig.of("S2", num_series=3), PoolConfig.of("S2", num_series=3000)
    for i in (0, 2):
        a, b = generate.generate_series(i, few), generate.generate_series(i, many)
        assert np.array_equal(a[0], b[0]) and a[2] == b[2]


def test_rates_of_a_pool():
    metas = [generate.generate_series(i, PoolConfig.of("S1"))[2] for i in range(400)]
    assert 0.17 < np.mean([m["y_i"] for m in metas]) < 0.33
    assert {m["base_type"] for m in metas} == {"white_noise", "ar1", "ar2"}


@given(st.lists(st.booleans(), min_size=30, max_size=300), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_legacy_cuts_keep_their_bounds(labels, seed):
    x = np.random.default_rng(seed).normal(size=len(labels))
    c = SamplerConfig(legacy=True, base_chunk=20, min_length=10, max_length=60, split_threshold=50, legacy_chunk_max=40, legacy_tolerance=3.0, lookahead=5)
    cutter = Cutter(x, np.array(labels, dtype=np.int8), None, c)
    seen: set[int] = set()
    for cut in cutter.cuts():
        at = cut.positions()
        assert 10 <= len(at) <= 60 and not seen & set(at.tolist())
        seen |= set(at.tolist())
        assert np.mean(np.array(labels)[at]) <= (0.27 if cut.name == "full" else 0.15) + 1e-9


@pytest.mark.parametrize("wrong", [{"max_anomaly_ratio": 1.5}, {"min_length": 0}, {"base_chunk": 50_000}, {"legacy_target_ratio": 0.5}, {"stats_tolerance": 0}])
def test_sampler_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        SamplerConfig(**wrong)


@pytest.mark.parametrize("wrong", [{"num_series": 0}, {"base_types": ("nothing",)}, {"families": ()}, {"length_range": (10, 20)}, {"anomaly_rate": 2}])
def test_pool_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        PoolConfig(**wrong)


@pytest.mark.parametrize("legacy", [False, True])
def test_period_detection_holds_little_beside_a_long_series(monkeypatch, legacy):
    """Once the transform of all of it and the table for its line took many times its size."""
    monkeypatch.setattr(signal, "SPAN", 1 << 14)
    n = 1_000_003
    x = np.random.default_rng(1).normal(size=n) + 2 * np.sin(2 * np.pi * np.arange(n) / 60)
    tracemalloc.start()
    found = signal.detect_period(x, SamplerConfig(legacy=legacy))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 60 and peak < 2.5 * x.nbytes


def test_cutter_holds_little_beside_a_long_series():
    x, y = np.random.default_rng(2).normal(size=1_000_003), np.zeros(1_000_003, np.int8)
    y[::700] = 1
    tracemalloc.start()
    Cutter(x, y, None, SamplerConfig(legacy=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * x.nbytes


@pytest.mark.parametrize("span", [64, 700, 4096])
def test_spans_of_a_series_give_what_all_of_it_gives(monkeypatch, span):
    rng = np.random.default_rng(3)
    for n in (997, 2500):
        x = rng.normal(size=n) + np.sin(2 * np.pi * np.arange(n) / 60)
        ties = rng.integers(0, 3, n).astype(float)
        power = np.abs(np.fft.rfft(x, 2 * n)) ** 2
        acf = np.fft.irfft(power, 2 * n)
        configs = SamplerConfig(), SamplerConfig(legacy=True)
        with monkeypatch.context() as m:
            m.setattr(signal, "SPAN", 1 << 18)
            whole = [signal.detect_period(x, c) for c in configs]
        with monkeypatch.context() as m:
            m.setattr(signal, "SPAN", span)
            band, found = signal._spectrum(x, 300, 5, 900)
            assert np.allclose(band, power[5:901], atol=1e-8) and np.allclose(found, acf[:300] / acf[0], atol=1e-12)
            assert [signal.detect_period(x, c) for c in configs] == whole
            assert signal._correlation(x, 7) == pytest.approx(np.corrcoef(x[:-7], x[7:])[0, 1], rel=1e-12)
            for v in (x, ties, np.sort(x), np.append(x, np.inf)):
                assert signal._median(v) == np.median(v) and signal._median(v, 0.3) == np.median(np.abs(v - 0.3))
            assert np.isnan(signal._median(np.append(x, np.nan)))
