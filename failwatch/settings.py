"""Tunable parameters and the fixed word lists of the classifier."""

from __future__ import annotations

from dataclasses import dataclass

MICROS = 1_000_000
MINUTE_US = 60 * MICROS


@dataclass(frozen=True)
class Settings:
    """Parameters of every operator; the defaults give the standard results."""

    # template mining
    similarity: float = 0.4
    max_children: int = 100
    # classifier
    semantic_threshold: float = 0.12
    metric_score_threshold: int = 3
    confirm_score: int = 2
    vocabulary_size: int = 5000
    gc_history_rows: int = 10
    # trailing window
    window_minutes: int = 5
    min_window_rows: int = 3
    # Time slice used to split one service over many tasks for operators that
    # look back without a time limit (fill, counters, row lags).
    slice_minutes: int = 5

    @property
    def window_us(self) -> int:
        return self.window_minutes * MINUTE_US

    @property
    def slice_us(self) -> int:
        return self.slice_minutes * MINUTE_US


DEFAULTS = Settings()

# ---------------------------------------------------------------------------
# Phrases, sentences and rules that decide the labels.
# ---------------------------------------------------------------------------

MEMORY_PHRASES = [
    "MEMORY LEAK",
    "MEMORY PRESSURE",
    "OUT OF MEMORY",
    "OOM",
    "HEAP GROWING",
    "HEAP EXHAUSTION",
    "HEAP SPACE",
    "OUTOFMEMORYERROR",
    "ALLOCATION FAILED",
    "ALLOCATION FAILURE",
    "GC OVERHEAD LIMIT",
    "HEAP USED CRITICAL",
    "MEMORY THRESHOLD",
    "HEAP OUT OF MEMORY",
    "CANNOT ALLOCATE",
    "MEMORY CRITICAL",
    "HEAP EXHAUSTED",
    "MEMORY LIMIT",
    "HEAP PRESSURE",
]

CPU_PHRASES = [
    "CPU SPIKE",
    "HIGH COMPUTATION",
    "CPU USAGE CRITICAL",
    "THREAD POOL EXHAUSTED",
    "COMPUTATION STARTED",
]

FAILURE_SENTENCES = [
    "memory leak heap allocation increasing",
    "out of memory error oom condition triggered",
    "heap growing allocated chunks memory pressure",
    "memory pressure critical heap exhaustion",
    "garbage collection overhead limit exceeded",
    "allocation failed heap used memory critical",
    "cpu spike high computation thread started",
    "memory threshold exceeded heap growing fast",
    "fatal heap exhaustion process memory critical",
    "java heap space outofmemoryerror gc overhead",
]

EXTRA_SENTENCES = [
    "heap memory consumption rising steadily without release",
    "application nearing memory saturation due to unreclaimed objects",
    "garbage collector running frequently with low reclaimed memory",
    "memory allocation retries increasing under sustained load",
    "process terminated after exceeding configured memory limit",
    "old generation occupancy remains high across multiple gc cycles",
    "service response delay linked to severe heap pressure",
    "container memory usage spikes followed by out of memory crash",
    "resident memory grows continuously indicating possible leak pattern",
    "allocation stall observed before heap exhaustion error",
]

CORPUS_SIZES = [3, 5, 7, 10, 15, 20]
WINDOW_SWEEP_MINUTES = [4, 6, 8, 10, 12, 16, 20, 24]

# image-tag substring -> stack, first match wins
STACK_RULES = [
    (["python", "flask"], "Python/Flask"),
    (["node"], "Node.js/Express"),
    (["java", "spring"], "Java/SpringBoot"),
    (["dotnet", "aspnet"], ".NET/Core"),
    (["golang", "/go"], "Go/net_http"),
]
GO_TAG_PREFIX = "go:"
UNKNOWN_STACK = "Unknown"

# log-text substring -> level, first match wins
LEVEL_RULES = [
    (["CRITICAL", "FATAL"], "CRITICAL"),
    (["ERROR", "EXCEPTION", "OOM"], "ERROR"),
    (["WARN"], "WARNING"),
]
DEFAULT_LEVEL = "INFO"
GC_WORDS = ["GC", "GARBAGE", "COLLECTION"]

# metric -> (low, high)
METRIC_BOUNDS = {
    "ram_percent": (0.0, 100.0),
    "cpu_percent": (0.0, 100.0),
    "heap_mb_used": (0.0, 10000.0),
}

# (metric, strictly above, points)
METRIC_POINTS = [
    ("ram_percent", 75.0, 2),
    ("ram_percent", 60.0, 1),
    ("heap_mb_used", 350.0, 2),
    ("heap_mb_used", 280.0, 1),
    ("cpu_percent", 80.0, 2),
]
GC_JUMP_ABOVE = 3
GC_JUMP_POINTS = 2
