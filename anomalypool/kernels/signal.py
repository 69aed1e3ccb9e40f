"""Filters, baselines and period detection."""

from __future__ import annotations

import numpy as np

from ..config import SamplerConfig

TINY = 1e-10
SPAN = 1 << 18  # values of a long series that are transformed at once


def _spans(n: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + size)) for a in range(0, n, size)]


def ar_filter(noise: np.ndarray, coefficients: tuple[float, ...]) -> np.ndarray:
    """x[t] = noise[t] + sum of coefficients[k] * x[t - 1 - k], from rest."""
    if not any(coefficients):
        return noise.copy()
    order = len(coefficients)
    out = [0.0] * order
    for e in noise.tolist():
        out.append(e + sum(c * out[-1 - k] for k, c in enumerate(coefficients)))
    return np.array(out[order:])


def rolling_median(x: np.ndarray, width: int) -> np.ndarray:
    """Median of an odd width around each value; the end values are repeated outwards."""
    half = width // 2
    padded = np.pad(x, half, mode="edge")
    out = np.empty(len(x))
    for a in range(0, len(x), 4096):  # so that the windows of a long series aren't all in memory
        b = min(len(x), a + 4096)
        out[a:b] = np.median(np.lib.stride_tricks.sliding_window_view(padded[a : b + 2 * half], width), axis=1)
    return out


def mad_sigma(x: np.ndarray) -> float:
    return 1.4826 * float(np.median(np.abs(x - np.median(x))))


def steps_sd(x: np.ndarray) -> float:
    """Deviation of steps over sqrt 2; 0 below three values."""
    return float(np.std(np.diff(x)) / np.sqrt(2)) if len(x) > 2 else 0.0


def local_scale(x: np.ndarray) -> float:
    if len(x) < 2:
        return 1.0
    for scale in (mad_sigma(np.diff(x)) / np.sqrt(2), float(np.std(x))):
        if scale > 1e-9:
            return scale
    return 1.0


def taper(duration: int, ramp: int) -> np.ndarray:
    """Rises linearly from 0 over ramp samples, falls to 0 at the end."""
    ramp = min(max(ramp, 1), max(1, duration // 2))
    i = np.arange(duration)
    return np.minimum(np.minimum(i, duration - 1 - i), ramp) / ramp


def whitened_norm(shape: np.ndarray, ar: tuple[float, ...], sigma: float) -> float:
    """Length of shape, seen through the filter that makes an AR process white, in units of its innovations."""
    return float(np.linalg.norm(np.convolve(shape, [1.0, *(-c for c in ar)]))) / max(sigma, 1e-12)


class Geometry:
    """What a plot of a series shows: its slow baseline, the band around it and how far the tail reaches."""

    def __init__(self, x: np.ndarray, period: int | None = None) -> None:
        n = len(x)
        width = min(max(101, 2 * int(period) + 1) if period else 101, max(3, n // 3))
        self.baseline = rolling_median(x, width | 1)
        self.residual = x - self.baseline
        size = np.abs(self.residual - np.median(self.residual))
        middle = float(np.median(size))
        self.sigma = 1.4826 * middle if middle > 1e-9 else max(float(np.std(self.residual)), 1e-9)
        far, farther = np.quantile(size, [0.995, 0.999])
        self.tail_step = max(float(farther - far), 0.0)
        self.reach = max(float(far), 1.2 * self.sigma)

    def wander(self, horizon: int) -> float:
        """How far the baseline, without its line, moves in horizon samples: the 0.995 quantile."""
        n = len(self.baseline)
        if n < 8:
            return 0.0
        t = np.arange(n)
        rest = self.baseline - np.polyval(np.polyfit(t, self.baseline, 1), t)
        h = min(max(horizon, 1), n - 1)
        return float(np.quantile(np.abs(rest[h:] - rest[:-h]), 0.995))


def _median(x: np.ndarray, centre: float | None = None) -> float:
    """np.median of x, or of its distances from centre. Of a long x only what lies between two order statistics of a sample around the middle is gathered."""
    of = (lambda part: part) if centre is None else (lambda part: np.abs(part - centre))
    n = len(x)
    if n <= SPAN:
        return float(np.median(of(x)))
    sample = np.sort(of(x[:: -(-n // 65536)]))
    middle, slack = len(sample) // 2, 3 * int(len(sample) ** 0.5)
    low, high = sample[max(middle - slack, 0)], sample[min(middle + slack, len(sample) - 1)]
    while True:
        counts, between = np.zeros(4, np.int64), []
        for a, b in _spans(n, SPAN):
            part = of(x[a:b])
            counts += [np.count_nonzero(hit) for hit in (part < low, part == low, (part == high) & (part > low), part > high)]
            between.append(part[(part > low) & (part < high)])
        inside = np.sort(np.concatenate(between))
        if counts.sum() + len(inside) < n:
            return float("nan")
        first = counts[0] + counts[1]
        ranks = ((n - 1) // 2, n // 2)
        if ranks[0] >= counts[0] and ranks[1] < n - counts[3]:
            return float(np.mean([low if r < first else inside[r - first] if r < first + len(inside) else high for r in ranks]))
        low, high = (low if ranks[0] >= counts[0] else -np.inf), (high if ranks[1] < n - counts[3] else np.inf)


def _standard(x: np.ndarray) -> np.ndarray | None:
    """x with mean 0 and deviation 1, in place; None if it is constant."""
    x -= np.mean(x)
    spread = float(np.sqrt(sum(float(np.dot(x[a:b], x[a:b])) for a, b in _spans(len(x), SPAN)) / len(x)))
    if spread < TINY:
        return None
    x /= spread
    return x


def _spectrum(v: np.ndarray, lags: int, lo: int = 0, hi: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Power at frequencies lo / 2n to hi / 2n, and the biased autocorrelation at the first lags, 1 at lag 0."""
    n = len(v)
    if n > SPAN:
        power, acf = _band(v, lo, hi), _products(v, lags)
    else:
        f = np.fft.rfft(v, 2 * n)
        whole = (f * f.conj()).real
        power, acf = whole[lo : hi + 1], np.fft.irfft(whole, 2 * n)[:lags]
    return power, acf / (acf[0] + TINY)


def _products(v: np.ndarray, lags: int) -> np.ndarray:
    """Sums of v[i] * v[i + lag], span by span."""
    out, size = np.zeros(lags), 1 << (min(SPAN, len(v)) + lags - 1).bit_length()
    for a, b in _spans(len(v), SPAN):
        out += np.fft.irfft(np.fft.rfft(v[a:b], size).conj() * np.fft.rfft(v[a : b + lags - 1], size), size)[:lags]
    return out


def _band(v: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Power at frequencies lo / 2n to hi / 2n by the chirp transform of each span of v, for a span of frequencies at a time."""
    n, width = len(v), min(SPAN, max(hi + 1 - lo, 0))
    out, size = np.empty(max(hi + 1 - lo, 0)), 1 << (SPAN + width - 1).bit_length()
    turn = lambda k, of: np.exp(-2j * np.pi / of * (k % of))  # noqa: E731  whole numbers, so that late phases are as good as early ones
    half = turn(np.arange(max(SPAN, width), dtype=np.int64) ** 2, 4 * n)
    ring = np.zeros(size, complex)
    ring[:width], ring[size - SPAN + 1 :] = half[:width].conj(), half[SPAN - 1 : 0 : -1].conj()
    ring = np.fft.fft(ring)
    for first, last in _spans(len(out), SPAN):
        k = np.arange(lo + first, lo + last, dtype=np.int64)
        found = np.zeros(len(k), complex)
        for a, b in _spans(n, SPAN):
            part = v[a:b] * half[: b - a]
            part *= turn(np.arange(b - a, dtype=np.int64) * (lo + first), 2 * n)
            part = np.fft.fft(part, size)
            part *= ring
            part = np.fft.ifft(part)[: len(k)]
            part *= turn(k * a, 2 * n)
            found += part
        out[first:last] = found.real**2 + found.imag**2  # half, which is left out, has length 1
    return out


def _correlation(x: np.ndarray, lag: int) -> float:
    a, b = x[:-lag], x[lag:]
    p, q = float(np.mean(a)), float(np.mean(b))
    sums = np.zeros(3)
    for i, j in _spans(len(a), SPAN):
        u, w = a[i:j] - p, b[i:j] - q
        sums += np.dot(u, u), np.dot(w, w), np.dot(u, w)
    return float(sums[2] / np.sqrt(sums[0] * sums[1])) if sums[0] > 0 and sums[1] > 0 else float("nan")


def _local_peaks(x: np.ndarray, above: float, most: int | None = None) -> np.ndarray:
    """Indices higher than both neighbours and than above; the most highest ones, highest first, if most is given."""
    at = 1 + np.flatnonzero((x[1:-1] > np.maximum(x[:-2], x[2:])) & (x[1:-1] > above))
    return at if most is None else at[np.argsort(-x[at], kind="stable")][:most]


def detect_period(x: np.ndarray, config: SamplerConfig = SamplerConfig(), overwrite: bool = False) -> int | None:
    """The dominant period of a series, from its values alone, or None.

    Beside the series and one copy (none, if it may be overwritten; then its values are lost) it holds a bounded number of
    values, and a share of some percent of the frequencies.
    """
    x = np.asarray(x, dtype=float)
    least, most = config.period_range[0], min(config.period_range[1], len(x) // config.periods_per_chunk)
    if len(x) < 3 or most < least:
        return None
    return _first_peak(x, least, most) if config.legacy else _best_comb(x if overwrite else x.copy(), least, most, config.period_clip)


def _first_peak(x: np.ndarray, least: int, most: int) -> int | None:
    """The older way: the first clear peak of the autocorrelation without the line through the end points."""
    n = len(x)
    line = np.linspace(x[0], x[-1], n)
    v = _standard(np.subtract(x, line, out=line))
    if v is None:
        return None
    last = max(least + 1, min(most, n // 2 - 1))
    _, acf = _spectrum(v, min(n, last + 1))
    clear = set(_local_peaks(acf, max(0.2, 1.96 / np.sqrt(n))).tolist())
    return next((lag for lag in range(least, last) if lag in clear and _correlation(x, lag) >= 0.15), None)


def _flatten(x: np.ndarray) -> None:
    """Takes the least-squares line off x, in place."""
    n = len(x)
    x -= np.mean(x)
    middle = (n - 1) / 2
    slope = sum(float(np.dot(np.arange(a, b) - middle, x[a:b])) for a, b in _spans(n, SPAN)) * 12 / n / (n * n - 1)
    for a, b in _spans(n, SPAN):
        x[a:b] -= slope * (np.arange(a, b) - middle)


def _best_comb(x: np.ndarray, least: int, most: int, clip: float) -> int | None:
    """Peaks of the periodogram and of the autocorrelation, moved to the nearest hill of the latter, and of these the
    least whose multiples are about as correlated as those of the best. x is overwritten."""
    n = len(x)
    _flatten(x)
    middle = _median(x)
    if (sigma := 1.4826 * _median(x, middle)) > TINY:
        np.clip(x, middle - clip * sigma, middle + clip * sigma, out=x)
    v = _standard(x)
    last = min(most, n // 2 - 2)
    if v is None or last <= least:
        return None
    lags = min(n, 4 * last + max(2, last // 20) + 1)
    lo, hi = max(1, -(-2 * n // last)), min(n - 1, 2 * n // least)
    band, acf = _spectrum(v, lags, lo, hi)
    acf *= n / (n - np.arange(lags))  # without bias, so that long lags compare

    guesses = [float(least + i) for i in _local_peaks(acf[least:last], 0.2, 5)]
    if hi > lo:
        guesses += [2 * n / (lo + i) for i in _local_peaks(band, 10 * (np.median(band) + 1e-30), 5)]

    combs: dict[int, float] = {}
    for guess in guesses:
        centre, slack = round(guess), max(2, round(0.06 * guess))
        a, b = max(least, centre - slack), min(last, centre + slack)
        if b <= a:
            continue
        p = a + int(np.argmax(acf[a : b + 1]))
        if acf[p] < 0.2 or acf[p] - acf[1:p].min() < 0.1:
            continue
        teeth = range(p, p * max(1, min(4, (n // 2 - 2) // p)) + 1, p)
        width = max(2, p // 20)
        combs[p] = float(np.mean([acf[k - width : min(n - 1, k + width) + 1].max() for k in teeth]))
    if not combs:
        return None
    best = max(combs.values())
    p = min(p for p, score in combs.items() if score >= best - 0.05 * abs(best))
    return p if _correlation(v, p) >= 0.2 else None
