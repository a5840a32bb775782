"""Small hand-made samples and plain-Python references for the ordered operators."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import DataFrame, SparkSession

MIN = 60_000_000
T0 = 1_704_067_200_000_000
COLUMNS = (
    "seq bigint, ts_us bigint, service_name string, stack string, log_level string, "
    "log_message string, ram_percent double, cpu_percent double, heap_mb_used double, "
    "gc_count bigint, ground_truth_label string, failure_type string"
)


def rows_to_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    base = {
        "service_name": "a", "stack": "Python/Flask", "log_level": "INFO", "log_message": "ok",
        "ram_percent": 50.0, "cpu_percent": 10.0, "heap_mb_used": 100.0, "gc_count": 0,
        "ground_truth_label": "NORMAL", "failure_type": "none",
    }
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    filled = [tuple({"seq": i, **base, **r}.get(n) for n in names) for i, r in enumerate(rows)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(filled, COLUMNS).withColumn("timestamp", F.timestamp_micros("ts_us"))


def random_rows(n: int, seed: int = 7, ties: bool = True) -> list[dict]:
    """Most rows belong to one service; times are uneven and may repeat."""
    rng = random.Random(seed)
    t = dict.fromkeys("abc", T0)
    rows = []
    for i in range(n):
        service = "a" if rng.random() < 0.6 else rng.choice("bc")
        t[service] += rng.choice([0 if ties else 1, 900_000, 7 * 1_000_000, 35 * 1_000_000, 200 * 1_000_000])
        rows.append(
            {
                "seq": i, "ts_us": t[service], "service_name": service,
                "ram_percent": rng.choice([None, round(rng.uniform(0, 100), 2), 50.0]),
                "cpu_percent": round(rng.uniform(0, 120), 1),
                "heap_mb_used": rng.choice([None, float(rng.randrange(500))]),
                "gc_count": rng.choice([None, rng.randrange(12)]),
                "ground_truth_label": rng.choice(["NORMAL", "NORMAL", "FAILURE"]),
                "hybrid_label": rng.choice(["NORMAL", "FAILURE"]),
                "log_message": rng.choice(
                    ["ok", "", "  ", f"request {i} served", f"worker {rng.randrange(3)} lost node {i}"]
                ),
            }
        )
    return rows


def by_service(rows: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["ts_us"], r["seq"])):
        out.setdefault(r["service_name"], []).append(r)
    return out


def frame_reference(rows: list[dict], width_us: int, need: int = 3) -> dict[int, dict]:
    """Features of [t - width, t) by scanning, keyed by seq."""
    found = {}
    for service_rows in by_service(rows).values():
        for r in service_rows:
            w = [x for x in service_rows if r["ts_us"] - width_us <= x["ts_us"] < r["ts_us"]]
            if len(w) < need:
                continue
            ram = [x["ram_percent"] for x in w if x["ram_percent"] is not None]
            steps = lambda c: [
                b[c] - a[c] for a, b in zip(w, w[1:]) if a[c] is not None and b[c] is not None
            ]
            heap = steps("heap_mb_used")
            first, last = w[0]["ram_percent"], w[-1]["ram_percent"]
            heaps = [x["heap_mb_used"] for x in w if x["heap_mb_used"] is not None]
            found[r["seq"]] = {
                "window_rows": len(w),
                "memory_growth": None if first is None or last is None else last - first,
                "heap_rate": statistics.fmean(heap) if heap else 0.0,
                "gc_spike_count": sum(d > 0 for d in steps("gc_count")),
                "window_duration_seconds": (w[-1]["ts_us"] - w[0]["ts_us"]) / 1e6,
                "ram_mean": statistics.fmean(ram) if ram else None,
                "ram_max": max(ram, default=None),
                "ram_std": statistics.stdev(ram) if len(ram) > 1 else None,
                "cpu_mean": statistics.fmean(x["cpu_percent"] for x in w),
                "cpu_max": max(x["cpu_percent"] for x in w),
                "heap_max": max(heaps, default=None),
                "window_label": "FAILURE" if any(x["ground_truth_label"] == "FAILURE" for x in w) else "NORMAL",
            }
    return found


def slope(y: list[float]) -> float:
    n = len(y)
    if n < 2:
        return 0.0
    xm, ym = (n - 1) / 2, sum(y) / n
    return sum((i - xm) * (v - ym) for i, v in enumerate(y)) / sum((i - xm) ** 2 for i in range(n))


def trend_reference(rows: list[dict]) -> dict[int, dict]:
    """Trends by scanning: frames (t - w, t], rows of equal time only up to the row itself."""
    found = {}
    for service_rows in by_service(rows).values():
        def frame(i: int, width: int) -> range:
            t = service_rows[i]["ts_us"]
            return [j for j in range(i + 1) if service_rows[j]["ts_us"] > t - width]

        f1 = [
            sum(service_rows[j]["hybrid_label"] == "FAILURE" for j in frame(i, MIN))
            for i in range(len(service_rows))
        ]
        for i, r in enumerate(service_rows):
            found[r["seq"]] = {"failures_1m": f1[i]}
            for m in (5, 10):
                y = [float(f1[j]) for j in frame(i, m * MIN)]
                found[r["seq"]] |= {
                    f"trend_max_failures_{m}m": max(y),
                    f"trend_variance_{m}m": statistics.variance(y) if len(y) > 1 else 0.0,
                    f"trend_slope_{m}m": slope(y),
                }
    return found


def close(a, b, tol: float = 1e-9) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b
