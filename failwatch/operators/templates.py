"""Log templates.

Messages are clustered online with a fixed-depth tree (He et al., "Drain: An Online
Log Parsing Approach with Fixed Depth Tree", ICWS 2017): a message goes to the leaf of
its token count and first token, joins the most similar template there or starts a new
one, and positions that differ become wildcards. The outcome depends on row order,
yet nearly all rows change nothing. So the work is split in two:

* the few rows that change a template are replayed in order, leaf by leaf, which gives
  the versions of every template over time;
* all rows are matched against the versions valid at their position, in parallel and
  without a shuffle, so a leaf that holds a third of all rows is no hot spot.

The matching also finds rows that would still change a template. Those are added and
the replay repeated until there are none; then every row has exactly the result of one
pass in order. Leaves that do not settle, or models too large to send to all tasks, take
the pass in order itself: rows stream through a sorted partition, behind the templates that the
leaf has from an earlier model, and only the templates of the current leaf are held.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from failwatch.functions import text
from failwatch.functions.timeaxis import slot
from failwatch.operators.history import position
from failwatch.settings import DEFAULTS, Settings
from failwatch.storage import materialize

WILDCARD = "<*>"
#: The blanks that part tokens in Spark's patterns; other Unicode blanks belong to a token.
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
SEED_BUCKETS = 16
MAX_ROUNDS = 10
MODEL_LIMIT_BYTES = 64 * 1024 * 1024
_LAST = (1 << 62)
_TIME_SLICE_US = 3_600_000_000

EVENT = "leaf string, at bigint, seq bigint, message string"
VERSION = "leaf string, cluster int, at bigint, seq bigint, template string"


# ------------------------------------------------------------------ native columns

def leaf_columns(df: DataFrame) -> DataFrame:
    """Add n_tokens, first_token (digits masked) and the masked pattern."""
    masked = df.withColumn("_tokens", text.mask_numbers(text.tokens(F.col("log_message"))))
    return masked.withColumns(
        {
            "n_tokens": F.size("_tokens"),
            "first_token": F.coalesce(F.get("_tokens", F.lit(0)), F.lit("")),
            "pattern": F.array_join("_tokens", " "),
        }
    ).drop("_tokens")


def with_leaf(
    df: DataFrame, settings: Settings = DEFAULTS, catalogue: DataFrame | None = None
) -> DataFrame:
    """Add ``leaf`` and ``at``.

    A token count has a limited number of first tokens; those first seen after the
    limit share the wildcard leaf. Tokens of the catalogue were seen before all rows.
    """
    keyed = leaf_columns(df).withColumn("at", F.coalesce("ts_us", F.lit(_LAST)))
    firsts = (
        keyed.where(F.col("first_token") != WILDCARD)
        .groupBy("n_tokens", "first_token")
        .agg(F.min(position("at")).alias("_from"))
    )
    if catalogue is not None:
        known = catalogue.select(
            F.substring_index("leaf", " ", 1).cast("int").alias("n_tokens"),
            F.expr("substring(leaf, length(substring_index(leaf, ' ', 1)) + 2)").alias("first_token"),
        ).where(F.col("first_token") != WILDCARD).distinct()
        firsts = (
            firsts.unionByName(known.withColumn("_from", F.lit(-1).cast(firsts.schema["_from"].dataType)))
            .groupBy("n_tokens", "first_token")
            .agg(F.min("_from").alias("_from"))
        )
    by_first = Window.partitionBy("n_tokens").orderBy("_from", "first_token")
    kept = (
        firsts.withColumn("_rank", F.row_number().over(by_first))
        .where(F.col("_rank") < settings.max_children)
        .select("n_tokens", "first_token", F.lit(True).alias("_kept"))
    )
    # Written first: with its size known a small list is joined without a shuffle.
    kept = materialize(kept, "first-tokens")
    first = F.when(F.col("_kept"), F.col("first_token")).otherwise(WILDCARD)
    return (
        keyed.join(kept, ["n_tokens", "first_token"], "left")
        .withColumn("leaf", F.concat_ws(" ", "n_tokens", first))
        .drop("n_tokens", "first_token", "_kept")
    )


# ----------------------------------------------------------- one leaf, small helpers

def split_tokens(message: str) -> list[str]:
    """The tokens of a message, as ``text.tokens`` has them."""
    return [t for t in _BLANKS.split(message) if t]


#: Templates of a leaf that are compared one by one, and messages before more are laid out as a table.
PLAIN_TEMPLATES = 8
PLAIN_MESSAGES = 2


@dataclass
class Leaf:
    """Templates of one leaf at one moment."""

    templates: list[list[str]] = field(default_factory=list)
    similarity: float = 0.4
    _asked: int = 0
    _table: "TokenTable | None" = None

    def match(self, tokens: list[str]) -> int | None:
        """Most similar template; more wildcards win a tie, then the older one."""
        self._asked += 1
        if tokens and self._asked > PLAIN_MESSAGES and len(self.templates) > PLAIN_TEMPLATES:
            if self._table is None:
                self._table = TokenTable(len(tokens))
            if self._table.take(self.templates, tokens):
                return self._table.match(tokens, self.similarity)
        best, best_rank = None, (self.similarity, -1)
        for i, template in enumerate(self.templates):
            wild = template.count(WILDCARD)
            same = sum(a == b for a, b in zip(template, tokens) if a != WILDCARD)
            rank = (same / len(tokens) if tokens else 1.0, wild)
            if rank > best_rank:
                best, best_rank = i, rank
        return best

    def merged(self, i: int, tokens: list[str]) -> list[str]:
        return [a if a == b else WILDCARD for a, b in zip(self.templates[i], tokens)]

    def absorb(self, tokens: list[str]) -> tuple[int, bool]:
        """Take the message in; gives its cluster and whether a template changed."""
        i = self.match(tokens)
        if i is None:
            self.templates.append(tokens)
            return len(self.templates) - 1, True
        merged = self.merged(i, tokens)
        changed = merged != self.templates[i]
        self.templates[i] = merged
        if changed and self._table is not None:
            self._table.update(i, merged)
        return i, changed


class TokenTable:
    """The templates of a leaf as numbers, a row each, so that a message meets all of them at once."""

    def __init__(self, width: int):
        self.width = width
        self.numbers: dict[str, int] = {WILDCARD: 0}
        self.rows = np.zeros((2 * PLAIN_TEMPLATES, width), np.int32)
        self.wild = np.zeros(2 * PLAIN_TEMPLATES, np.int32)
        self.n = 0
        self.even = True

    def take(self, templates: list[list[str]], tokens: list[str]) -> bool:
        """Lay out the templates that are new; whether all have as many tokens as the message."""
        if len(templates) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(templates), self.width), np.int32)])
            self.wild = np.concatenate([self.wild, np.zeros(len(templates), np.int32)])
        while self.even and self.n < len(templates):
            self.even = len(templates[self.n]) == self.width
            if self.even:
                self.n += 1
                self.update(self.n - 1, templates[self.n - 1])
        return self.even and len(tokens) == self.width

    def update(self, i: int, template: list[str]) -> None:
        if i < self.n:
            self.rows[i] = [self.numbers.setdefault(t, len(self.numbers)) for t in template]
            self.wild[i] = template.count(WILDCARD)

    def match(self, tokens: list[str], similarity: float) -> int | None:
        # A wildcard of the message is equal to none of the template.
        wanted = np.array([self.numbers.get(t) or -1 for t in tokens], np.int32)
        same = np.count_nonzero(self.rows[: self.n] == wanted, axis=1)
        most = same.max()
        if most / self.width < similarity:
            return None
        return int(np.argmax(np.where(same == most, self.wild[: self.n], -1)))


class Timeline:
    """Versions of all templates; finds the templates valid at a position."""

    def __init__(self, base: dict[str, list[str]], versions: list[tuple], similarity: float):
        self.similarity = similarity
        self.base = base
        self.changes: dict[str, list[tuple]] = {}
        for leaf, cluster, at, seq, template in sorted(versions, key=lambda v: (v[0], v[2], v[3])):
            self.changes.setdefault(leaf, []).append(((at, seq), cluster, template))
        self._moments: dict[str, list[tuple]] = {}
        self._states: dict[tuple, tuple] = {}

    def _state(self, leaf: str, step: int) -> tuple:
        """Leaf, the positions that tell its templates apart, and a result cache."""
        state = self._states.get((leaf, step))
        if state is None:
            templates = [split_tokens(t) for t in self.base.get(leaf, [])]
            for _, cluster, template in self.changes.get(leaf, [])[:step]:
                templates[cluster:cluster + 1] = [split_tokens(template)]
            fixed = sorted({p for t in templates for p, token in enumerate(t) if token != WILDCARD})
            pick = itemgetter(*fixed) if fixed else (lambda tokens: ())
            if len(self._states) >= 256:
                del self._states[next(iter(self._states))]
            state = self._states[(leaf, step)] = (Leaf(templates, self.similarity), pick, {})
        return state

    def look_up(self, leaf: str, at: int, seq: int, message: str, final: bool) -> tuple:
        """(cluster, template, would change) of a row."""
        moments = self._moments.get(leaf)
        if moments is None:
            moments = self._moments[leaf] = [c[0] for c in self.changes.get(leaf, [])]
        state, pick, cache = self._state(leaf, bisect_right(moments, (at, seq)))
        tokens = split_tokens(message)
        key = pick(tokens)
        found = cache.get(key)
        if found is None:
            i = state.match(tokens)
            if i is None:
                found = (-1, None, True)
            else:
                template = state.templates[i]
                found = (i, " ".join(template), state.merged(i, tokens) != template)
            if len(cache) < 100_000:
                cache[key] = found
        if final and found[0] >= 0:
            last = self._state(leaf, len(moments))[0].templates[found[0]]
            return found[0], " ".join(last), found[2]
        return found


# ---------------------------------------------------------------------- Spark passes

def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("leaf").sortWithinPartitions("leaf", "at", "seq")


def _replay(events: DataFrame, base: dict[str, list[str]], similarity: float) -> DataFrame:
    """Versions made by the events, in order within each leaf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, leaf = None, Leaf()
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                if row.leaf != name:
                    name = row.leaf
                    leaf = Leaf([split_tokens(t) for t in base.get(name, [])], similarity)
                cluster, changed = leaf.absorb(split_tokens(row.message))
                if changed:
                    made.append((name, cluster, row.at, row.seq, " ".join(leaf.templates[cluster])))
            yield pd.DataFrame(made, columns=["leaf", "cluster", "at", "seq", "template"])

    return _in_order(events.select("leaf", "at", "seq", "message")).mapInPandas(run, VERSION)


def _matched(df: DataFrame, timeline: Timeline, final: bool, ids: dict[tuple[str, int], int] | None = None) -> DataFrame:
    """Add ``_match`` (cluster, template, template_id, changes) to every row, without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(
        (timeline.base, [(k, c, p[0], p[1], t) for k, v in timeline.changes.items() for p, c, t in v], ids or {})
    )
    similarity = timeline.similarity

    @F.pandas_udf("cluster int, template string, template_id bigint, changes boolean")
    def match(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        base, versions, numbers = shared.value
        local = Timeline(base, versions, similarity)
        for leaf, at, seq, message in columns:
            found = [local.look_up(*row, final) for row in zip(leaf, at, seq, message)]
            numbered = [numbers.get((name, f[0]), -1) for name, f in zip(leaf, found)]
            frame = pd.DataFrame(found, columns=["cluster", "template", "changes"])
            frame.insert(2, "template_id", numbered)
            yield frame

    return df.withColumn("_match", match("leaf", "at", "seq", "log_message"))


def _pass_in_order(df: DataFrame, catalogue: DataFrame | None, similarity: float) -> DataFrame:
    """The plain pass: every row absorbed in order, one leaf at a time.

    The templates of the catalogue come first in their leaf, so it may have any size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, leaf = None, Leaf()
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                if row.leaf != name:
                    name = row.leaf
                    leaf = Leaf([], similarity)
                if row.known:
                    leaf.templates.append(split_tokens(row.message))
                    continue
                cluster, _ = leaf.absorb(split_tokens(row.message))
                made.append((name, row.at, row.seq, cluster, " ".join(leaf.templates[cluster])))
            yield pd.DataFrame(made, columns=["leaf", "at", "seq", "cluster", "template"])

    keys = df.select("leaf", F.lit(False).alias("known"), "at", "seq", F.col("log_message").alias("message"))
    if catalogue is not None:
        first = F.col("cluster").cast("bigint").alias("at")
        keys = keys.union(catalogue.select("leaf", F.lit(True), first, F.lit(0).cast("bigint"), F.col("template")))
    ordered = keys.repartition("leaf").sortWithinPartitions("leaf", F.desc("known"), "at", "seq")
    return ordered.mapInPandas(
        run, "leaf string, at bigint, seq bigint, cluster int, template string"
    )


_GROUP = ["leaf", "pattern", "_bucket"]


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("log_message"), F.lit(SEED_BUCKETS)))


def _first_events(rows: DataFrame) -> DataFrame:
    """Earliest rows per (leaf, pattern), a few each.

    Only positions are reduced, in hash tables before the shuffle; their rows are then
    picked from the table.
    """
    placed = _grouped(rows).withColumn("_from", position("at"))
    firsts = materialize(placed.groupBy(*_GROUP).agg(F.min("_from").alias("_from")), "firsts")
    return placed.join(firsts, [*_GROUP, "_from"], "left_semi").select(
        "leaf", "at", "seq", F.col("log_message").alias("message")
    )


def _first_changes(rows: DataFrame) -> DataFrame:
    """The same for the few rows that a match has marked, in one pass over them."""
    event = F.struct("at", "seq", F.col("log_message").alias("message"))
    return _grouped(rows).groupBy(*_GROUP).agg(F.min(event).alias("e")).select("leaf", "e.*")


def _fits(table: DataFrame, column: str) -> bool:
    size = table.agg(F.coalesce(F.sum(F.length("leaf") + F.length(column) + 64), F.lit(0))).first()[0]
    return size <= MODEL_LIMIT_BYTES


def catalogue_base(catalogue: DataFrame | None) -> tuple[dict[str, list[str]], dict[tuple[str, int], int]] | None:
    """Templates per leaf in cluster order and their ids; None if they are too large to send."""
    if catalogue is None:
        return {}, {}
    if not _fits(catalogue, "template"):
        return None
    base: dict[str, list[str]] = {}
    ids: dict[tuple[str, int], int] = {}
    for r in catalogue.orderBy("leaf", "cluster").toLocalIterator():
        base.setdefault(r["leaf"], []).append(r["template"])
        ids[r["leaf"], r["cluster"]] = r["template_id"]
    return base, ids


def mine_templates(
    df: DataFrame,
    settings: Settings = DEFAULTS,
    final: bool = False,
    catalogue: DataFrame | None = None,
) -> DataFrame:
    """Add ``log_template`` and ``template_id`` (plus ``leaf`` and ``cluster``).

    The template is the one valid right after the row, or with ``final`` the last one of
    its cluster. Ids count clusters in order of their first row. ``catalogue`` continues an
    earlier model, whose templates are all taken as older than the rows.

    Runs jobs: the versions have to be known before rows can be matched. (ts_us, seq)
    must identify a row.
    """
    highest = 0
    if catalogue is not None:
        highest = catalogue.agg(F.max("template_id")).first()[0] or 0
    known = catalogue_base(catalogue)
    rows = materialize(with_leaf(df, settings, catalogue), "leaves")
    if known is None:
        found = materialize(_unsettled(rows, catalogue, settings, final), "templates")
        return _with_ids(found, highest, catalogue).drop("at", "pattern")
    base, ids = known
    events = materialize(_first_events(rows), "events")
    timeline, unsettled = None, rows.select("leaf").distinct()
    # Leaves are independent, so one that has settled is not looked at again.
    open_rows = rows
    for _ in range(MAX_ROUNDS):
        versions = materialize(_replay(events, base, settings.similarity), "versions")
        if not _fits(versions, "template"):
            timeline, unsettled = None, rows.select("leaf").distinct()
            break
        timeline = Timeline(base, [tuple(r) for r in versions.collect()], settings.similarity)
        late = materialize(
            _first_changes(_matched(open_rows, timeline, False).where("_match.changes")), "late"
        )
        unsettled = late.select("leaf").distinct()
        open_rows = rows.join(unsettled, "leaf", "left_semi")
        if late.isEmpty():
            unsettled = None
            break
        events = materialize(events.unionByName(late), "events")

    if unsettled is None:
        # The ids go with the model, so one pass over the rows gives all three columns.
        return _settled(rows, timeline, final, ids | _first_ids(timeline, base, highest)).drop("at", "pattern")
    if timeline is None:
        found = _unsettled(rows, catalogue, settings, final)
    else:
        unsettled = materialize(unsettled, "unsettled")
        found = _settled(rows.join(unsettled, "leaf", "left_anti"), timeline, final, {}).drop("template_id").unionByName(
            _unsettled(rows.join(unsettled, "leaf", "left_semi"), catalogue, settings, final)
        )
    return _with_ids(materialize(found, "templates"), highest, catalogue).drop("at", "pattern")


def _settled(rows: DataFrame, timeline: Timeline, final: bool, ids: dict[tuple[str, int], int]) -> DataFrame:
    return _matched(rows, timeline, final, ids).select(
        *rows.columns, F.col("_match.cluster").alias("cluster"), F.col("_match.template").alias("log_template"),
        F.col("_match.template_id").alias("template_id"),
    )


def _first_ids(timeline: Timeline, base: dict, highest: int) -> dict[tuple[str, int], int]:
    """Ids of the clusters that are not in the catalogue, by their first row."""
    first: dict[tuple, tuple] = {}
    for leaf, changes in timeline.changes.items():
        for moment, cluster, _ in changes:
            if cluster >= len(base.get(leaf, [])):
                first.setdefault((leaf, cluster), moment)
    return {k: highest + i for i, k in enumerate(sorted(first, key=first.get), 1)}


def _unsettled(rows: DataFrame, catalogue: DataFrame | None, settings: Settings, final: bool) -> DataFrame:
    found = materialize(_pass_in_order(rows, catalogue, settings.similarity), "in-order")
    if final:
        last = found.groupBy("leaf", "cluster").agg(
            F.max_by("template", F.struct("at", "seq")).alias("template")
        )
        found = found.drop("template").join(last, ["leaf", "cluster"])
    found = found.withColumnRenamed("template", "log_template")
    return rows.join(found, ["leaf", "at", "seq"]).select(*rows.columns, "cluster", "log_template")


def _with_ids(found: DataFrame, highest: int, catalogue: DataFrame | None) -> DataFrame:
    """Number the clusters that are not in the catalogue by their first row."""
    clusters = found.groupBy("leaf", "cluster").agg(F.min(F.struct("at", "seq")).alias("_from"))
    if catalogue is not None:
        clusters = clusters.join(catalogue.select("leaf", "cluster"), ["leaf", "cluster"], "left_anti")
    ids = _number_clusters(clusters, highest)
    if catalogue is not None:
        ids = ids.unionByName(catalogue.select("leaf", "cluster", "template_id"))
    return found.join(ids, ["leaf", "cluster"])


def _number_clusters(clusters: DataFrame, highest: int) -> DataFrame:
    """Dense ids by first position: counts per hour are added up, then rows ranked."""
    timed = clusters.withColumn("_hour", slot(F.col("_from.at"), _TIME_SLICE_US))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = timed.groupBy("_hour").agg(F.count("*").alias("_n")).select(
        "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    rank = F.row_number().over(Window.partitionBy("_hour").orderBy("_from", "leaf"))
    return timed.join(hours, "_hour").select(
        "leaf", "cluster", (F.col("_base") + rank + F.lit(highest)).cast("bigint").alias("template_id")
    )


def template_catalogue(mined: DataFrame) -> DataFrame:
    """The model as a table: one row per cluster with its latest template."""
    order = F.struct(F.col("ts_us").isNull().alias("untimed"), "ts_us", "seq")
    return (
        mined.groupBy("leaf", "cluster", "template_id")
        .agg(
            F.max_by("log_template", order).alias("template"),
            F.min_by("seq", order).alias("first_seq"),
            F.count("*").alias("n"),
        )
        .withColumn("tokens", F.split("template", " "))
    )


# ------------------------------------------------------------------------- reporting

def template_count(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("log_template").alias("templates"))


def most_frequent(df: DataFrame, limit: int = 10, width: int = 90) -> DataFrame:
    """Most frequent templates, text cut for display."""
    return (
        df.where(F.col("log_template").isNotNull())
        .groupBy("log_template")
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "log_template")
        .limit(limit)
        .select(F.substring("log_template", 1, width).alias("template"), "rows")
    )


def per_stack(df: DataFrame) -> DataFrame:
    """Distinct templates per stack, most first."""
    return (
        df.where(F.col("stack").isNotNull())
        .groupBy("stack")
        .agg(F.countDistinct("log_template").alias("templates"))
        .orderBy(F.desc("templates"), "stack")
    )
