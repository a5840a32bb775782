"""The batch job as a chain of stage tables.

Several operators read their input more than once (a slice summary next to the rows, a
model next to the rows it labels). Each stage is therefore written once to the shared
folder when first needed: later passes read just the columns they want, nothing upstream
runs twice, and a lost executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from failwatch.operators import classify, enrich, preprocess, templates, trends, windows
from failwatch.settings import DEFAULTS, Settings
from failwatch.sinks import tables
from failwatch.sinks.tables import ROW_KEYS
from failwatch.storage import materialize

Templating = Callable[[DataFrame], DataFrame]


class Stages:
    """Stage tables of one batch run over raw samples.

    ``templating`` adds log_template and template_id; mining is the default.
    """

    def __init__(
        self,
        samples: DataFrame,
        settings: Settings = DEFAULTS,
        templating: Templating | None = None,
    ):
        self.samples = samples
        self.settings = settings
        self.templating = templating or (lambda df: templates.mine_templates(df, settings))

    @cached_property
    def deduped(self) -> DataFrame:
        return materialize(preprocess.drop_duplicates(self.samples), "deduped")

    @cached_property
    def cleaned(self) -> DataFrame:
        return materialize(preprocess.after_dedupe(self.deduped, self.settings), "cleaned")

    @cached_property
    def templated(self) -> DataFrame:
        # Labelling reads it three times, and mining is a pass of Python over the rows.
        return materialize(self.templating(self.cleaned), "templated")

    @cached_property
    def similarity(self) -> DataFrame:
        """Fitted semantic model: (log_template, similarity)."""
        return classify.fit_similarity(self.templated, self.settings)

    @cached_property
    def classified(self) -> DataFrame:
        labelled = classify.classify(self.templated, self.settings, self.similarity)
        return materialize(labelled, "classified")

    @cached_property
    def window_rows(self) -> DataFrame:
        return materialize(windows.sliding_windows(self.classified, self.settings), "windows")

    @cached_property
    def windows(self) -> DataFrame:
        """Window table with ids, in the published column order."""
        return windows.published(
            windows.number_windows(self.window_rows, self.classified, self.settings)
        )

    @cached_property
    def trended(self) -> DataFrame:
        """Windows with ids and all trend columns.

        Lags, ids and trends look at few columns, so they are worked out on rows of those; the
        wide rows, a written table, move once, to be joined with the result.
        """
        narrow = self.window_rows.select(*ROW_KEYS, "hybrid_label", "ram_std")
        trended = trends.add_failure_trends(trends.add_ram_std_trend(narrow, settings=self.settings))
        numbered = windows.number_windows(trended, self.classified, self.settings, counted=narrow)
        added = numbered.drop("hybrid_label", "ram_std")
        return materialize(self.window_rows.join(added, ROW_KEYS), "trended")

    @property
    def audit(self) -> DataFrame:
        return enrich.audit_table(self.windows)

    @property
    def ml(self) -> DataFrame:
        return enrich.ml_table(self.trended)

    def write_ml(self, path: str) -> None:
        tables.write_ml(self.trended, path)
