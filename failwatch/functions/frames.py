"""Trailing frames over the sorted rows of one block of one service, in arrays.

The streaming operators close one (service, block) at a time; these are the batch frames of
``operators/windows`` and ``operators/trends`` for the rows of such a block. Times are in
microseconds and ascending; missing numbers are NaN. Every function takes linear time, the
maxima one factor of log n.
"""

from __future__ import annotations

import numpy as np

from failwatch.settings import DEFAULTS, MICROS, MINUTE_US, Settings


def sliding_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest number of every values[low:high], NaN where there is none."""
    level = np.where(np.isnan(values), -np.inf, values)
    out = np.full(len(low), -np.inf)
    length = high - low
    width = 1
    while len(level) and width <= length.max(initial=0):
        mine = np.flatnonzero((length >= width) & (length < 2 * width))
        out[mine] = np.maximum(level[low[mine]], level[high[mine] - width])
        level = np.maximum(level[:-width], level[width:]) if len(level) > width else level[:0]
        width *= 2
    return np.where(np.isinf(out), np.nan, out)


def _sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[high] - total[low]


def _mean_and_spread(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the numbers of every values[low:high]."""
    known = ~np.isnan(values)
    middle = values[known].mean() if known.any() else 0.0
    centred = np.where(known, values - middle, 0.0)
    n = _sums(known.astype(float), low, high)
    first, second = _sums(centred, low, high), _sums(centred * centred, low, high)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, middle + first / n, np.nan)
        spread = np.where(n > 1, np.sqrt(np.maximum(second - first * first / n, 0.0) / (n - 1)), np.nan)
    return mean, spread


def frame_features(
    ts: np.ndarray, ram: np.ndarray, cpu: np.ndarray, heap: np.ndarray, gc: np.ndarray, failed: np.ndarray,
    settings: Settings = DEFAULTS,
) -> dict[str, np.ndarray]:
    """Features of the frame [t - width, t) of every row; rows with a short frame included."""
    low = np.searchsorted(ts, ts - settings.window_us, "left")
    high = np.searchsorted(ts, ts, "left")
    some = high > low
    first, last = np.where(some, low, 0), np.where(some, high - 1, 0)

    def edges(values: np.ndarray) -> np.ndarray:
        return np.where(some, values[last] - values[first], np.nan)

    # A step belongs to its later row, so the frame's first row brings none.
    inner = np.minimum(low + 1, high)
    step = np.concatenate([[np.nan], np.diff(heap)]) if len(heap) else heap
    steps, moved = _sums(~np.isnan(step), inner, high), _sums(np.nan_to_num(step), inner, high)
    rises = np.concatenate([[False], gc[1:] > gc[:-1]]) if len(gc) else np.zeros(0, bool)
    ram_mean, ram_std = _mean_and_spread(ram, low, high)
    cpu_mean, _ = _mean_and_spread(cpu, low, high)
    return {
        "window_rows": high - low,
        "memory_growth": edges(ram),
        "heap_rate": np.where(steps > 0, moved / np.maximum(steps, 1), 0.0),
        "gc_spike_count": _sums(rises.astype(np.int64), inner, high),
        "window_duration_seconds": edges(ts.astype(float)) / MICROS,
        "ram_mean": ram_mean,
        "ram_max": sliding_max(ram, low, high),
        "ram_std": ram_std,
        "cpu_mean": cpu_mean,
        "cpu_max": sliding_max(cpu, low, high),
        "heap_max": sliding_max(heap, low, high),
        "window_label": np.where(_sums(failed.astype(np.int64), low, high) > 0, "FAILURE", "NORMAL"),
    }


def failure_trends(ts: np.ndarray, failed: np.ndarray) -> dict[str, np.ndarray]:
    """Slope, maximum and variance over 5 and 10 minutes of the failures of the last minute.

    Frames end with the row itself. All sums are of whole numbers, hence exact."""
    end = np.arange(1, len(ts) + 1)
    count = _sums(failed.astype(np.int64), np.searchsorted(ts, ts - MINUTE_US, "right"), end)
    place = np.arange(len(ts))
    out = {}
    for minutes in (5, 10):
        low = np.searchsorted(ts, ts - minutes * MINUTE_US, "right")
        n = (end - low).astype(float)
        total, squares = _sums(count, low, end), _sums(count * count, low, end)
        product = _sums(count * place, low, end) - low * total
        many = n > 1
        safe = np.maximum(n, 2)
        out[f"trend_slope_{minutes}m"] = np.where(many, (product - (n - 1) / 2 * total) / (safe * (safe * safe - 1) / 12), 0.0)
        out[f"trend_max_failures_{minutes}m"] = sliding_max(count.astype(float), low, end)
        out[f"trend_variance_{minutes}m"] = np.where(many, np.maximum(squares - total * total / safe, 0.0) / (safe - 1), 0.0)
    return out
