"""Batch jobs from samples to tables and reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from failwatch.operators import classify, evaluate, preprocess, sweeps, templates, trends, windows
from failwatch.operators.importance import feature_importance
from failwatch.plans.stages import Stages, Templating
from failwatch.settings import DEFAULTS, Settings
from failwatch.sinks import tables
from failwatch.sources import samples as sources


class Reports(Mapping):
    """Reports by name, each built when asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers = makers

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass(frozen=True)
class BatchResult:
    """Stage tables and reports of a batch run."""

    stages: Stages
    reports: Reports


def run_batch(
    samples: DataFrame, out_dir: str, settings: Settings = DEFAULTS, templating: Templating | None = None
) -> BatchResult:
    """Clean, mine, label, window, write both tables and prepare every report.

    ``templating`` replaces the mining; the catalogue of clusters is that of the miner."""
    stages = Stages(samples, settings, templating)
    tables.write_audit(stages.trended, f"{out_dir}/audit")
    stages.write_ml(f"{out_dir}/ml_ready")
    if templating is None:
        templates.template_catalogue(stages.templated).write.mode("overwrite").parquet(
            f"{out_dir}/template_catalogue"
        )
    return BatchResult(stages, reports(stages, settings))


def run_without_export(
    samples: DataFrame, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """(labelled samples, windows), nothing exported or evaluated."""
    stages = Stages(samples, settings)
    return stages.classified, stages.windows


def reports(stages: Stages, settings: Settings = DEFAULTS) -> Reports:
    """Every report on the source, the cleaning, the trends and the labels."""
    raw = stages.samples
    samples, rows = stages.classified, stages.window_rows
    return Reports(
        {
            "rows_per_service": lambda: sources.rows_per_service(raw),
            "source_labels": lambda: classify.distribution(raw, "ground_truth_label"),
            "quality": lambda: preprocess.quality_report(raw, settings),
            "trends": lambda: trends.trend_report(stages.trended),
            "label_distribution": lambda: classify.distribution(samples, "hybrid_label"),
            "failure_types": lambda: classify.distribution(samples, "failure_type"),
            "templates": lambda: templates.template_count(samples),
            "templates_per_stack": lambda: templates.per_stack(samples),
            "top_templates": lambda: templates.most_frequent(samples),
            "corpus_size": lambda: sweeps.corpus_size_sweep(samples, settings=settings),
            "window_width": lambda: sweeps.window_width_sweep(samples, settings=settings),
            "window_summary": lambda: windows.window_summary(rows),
            "window_labels": lambda: classify.distribution(rows, "ground_truth_label"),
            "overall": lambda: evaluate.overall(rows),
            "layer_contribution": lambda: evaluate.layer_contribution(rows),
            "per_service": lambda: evaluate.per_service(rows),
            "feature_ranges": lambda: evaluate.feature_ranges(rows),
            "ablation": lambda: evaluate.ablation(rows),
            "best_method": lambda: evaluate.best_method(evaluate.ablation(rows)),
            "leave_one_stack_out": lambda: evaluate.leave_one_stack_out(rows),
            "leave_one_stack_out_summary": lambda: evaluate.leave_one_stack_out_summary(rows),
            "early_warnings": lambda: evaluate.early_warnings(rows),
            "early_warning_summary": lambda: evaluate.early_warning_summary(
                evaluate.early_warnings(rows)
            ),
            "early_warning_by_service": lambda: evaluate.early_warning_by_service(
                evaluate.early_warnings(rows)
            ),
            "feature_importance": lambda: feature_importance(rows),
        }
    )
