"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all ordered thresholds t_k.
x holds 1 for every chosen word or word start that the text has. Words are runs of
alphanumerics, ASCII in lower case; a feature is a whole word or its first characters.

Edge cases: a null or empty text has no feature and gets the intercept's severity; a null
doc_id is scored like any other; repeated rows give repeated results; labels that are null or
belong to no document are not used; other columns are ignored. Without usable labels of two
grades every severity is 0 and nothing is rejected. With few toxic labels the features of most
evidence are taken, whatever it is, and the ridge shrinks their weights: texts like the labelled
ones are found, others may be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from failwatch.storage import materialize
from failwatch.llm.words import ALPHANUMERIC, LOWER, mix, span_hashes, text_chunks, word_spans

#: Bound of the labelled sample that is fitted: the rows of least hash.
TRAINING_ROWS = 20_000
#: Features kept, by evidence against independence of feature and toxic label.
FEATURES = 4_096
#: Bytes at the start of a longer word that are features too, for stems with free endings.
STEMS = (4, 5, 6, 8)
#: P(grade > 0) from which a text is toxic: one flagged word must do, also a rare one.
THRESHOLD = 0.3
#: Folds whose toxic rows are graded by a model of the other rows.
FOLDS = 2
_STEM_SALT = np.uint64(0xA24BAED4963EE407)


@dataclass
class Model:
    """Feature hashes in ascending order, their weights and the ordered thresholds."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def severity(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade > 0) of linear scores."""
        if not len(self.thresholds):
            return np.zeros(len(scores)), np.zeros(len(scores))
        above = _sigmoid(scores[:, None] - self.thresholds[None, :])
        return above.sum(axis=1), above[:, 0]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def row_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct-free feature hashes and the row of each: words, then stems of longer words."""
    starts, ends, rows = word_spans(data, offsets, ALPHANUMERIC)
    lower = LOWER[data]
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    keys, rows_of = [span_hashes(lower, starts, ends)], [of]
    for size in STEMS:
        longer = ends - starts > size
        keys.append(mix(span_hashes(lower, starts[longer], starts[longer] + size) ^ _STEM_SALT))
        rows_of.append(of[longer])
    return np.concatenate(keys), np.concatenate(rows_of)


def _pairs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in text_chunks(texts):
        yield first, end, *row_features(data, offsets)


def _row_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, keys, of in _pairs(batch["text"]):
            order = np.lexsort((keys, of))
            keys, of = keys[order], of[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
            offsets = np.searchsorted(of[new], np.arange(end - first + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[new].view(np.int64)))
            yield pa.record_batch({"grade": batch["grade"].slice(first, end - first), "keys": lists})


def training_rows(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """(text, grade) of at most ``limit`` labelled documents, those of least hash.

    The sample is bounded, so it is broadcast to the documents, which are not shuffled."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "text", F.col("toxic").cast("int").alias("grade")
    )


def choose_features(rows: DataFrame, limit: int = FEATURES) -> np.ndarray:
    """The features of the sample with most evidence (a G test) that they go with toxic text.

    The least evidence is the logarithm of the number of features that go with toxic text at all, so
    that about one of those kept would be there by chance, or the most that any feature has, if less."""
    sums = rows.agg(F.count("*"), F.sum((F.col("grade") > 0).cast("long"))).first()
    total, toxic = sums[0], sums[1] or 0
    if not toxic or toxic == total:
        return np.zeros(0, np.uint64)
    counts = rows.select(F.explode("keys").alias("key"), (F.col("grade") > 0).cast("long").alias("bad")).groupBy("key").agg(
        F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("a")
    )
    expected = F.col("n") * (toxic / total)
    rest = F.col("n") - F.col("a")

    def term(seen, mean):
        return F.when(seen > 0, seen * F.log(seen / mean)).otherwise(0.0)

    evidence = term(F.col("a"), expected) + term(rest, F.col("n") - expected)
    with_toxic = materialize(counts.where(F.col("a") > expected).select("key", F.round(evidence, 9).alias("g")), "toxicity-features")
    found, most = with_toxic.agg(F.count("*"), F.max("g")).first()
    if not found:
        return np.zeros(0, np.uint64)
    best = with_toxic.where(F.col("g") >= min(np.log(found), most)).orderBy(F.desc("g"), "key").limit(limit)
    keys = best.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    return np.sort(keys)


def fit_cumulative(x_rows: np.ndarray, x_cols: np.ndarray, grades: np.ndarray, n_features: int, rounds: int = 1500, ridge: float = 0.01):
    """Weights and ascending thresholds by full-batch Adam on the ordinal log likelihood."""
    top = int(grades.max()) if len(grades) else 0
    if top < 1:
        return np.zeros(n_features), np.zeros(0)
    w = np.zeros(n_features)
    above = np.array([(grades > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    first, steps = -np.log(above[0] / (1 - above[0])), np.diff(-np.log(above / (1 - above))).clip(0.05)
    theta = np.concatenate([[first], np.log(steps)])
    m, v = np.zeros(n_features + top), np.zeros(n_features + top)
    n = len(grades)
    for step in range(1, rounds + 1):
        cuts = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
        score = np.bincount(x_rows, w[x_cols], n)
        # Cumulative probabilities P(grade > k), with 1 and 0 at the ends.
        above = np.column_stack([np.ones(n), _sigmoid(score[:, None] - cuts), np.zeros(n)])
        upper, lower = above[np.arange(n), grades], above[np.arange(n), grades + 1]
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = -(d_upper - d_lower)
        g_cuts = np.zeros(top)
        for k in range(top):
            g_cuts[k] = d_upper[grades == k + 1].sum() - d_lower[grades == k].sum()
        g_theta = np.array([g_cuts.sum(), *(g_cuts[k:].sum() * np.exp(theta[k]) for k in range(1, top))])
        g = np.concatenate([np.bincount(x_cols, g_score[x_rows], n_features) + ridge * w, g_theta]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, theta = w - move[:n_features], theta - move[n_features:]
    return w, np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> Model:
    """Fit the model on the bounded sample.

    ``labels.toxic`` above 1 is taken as a grade. Where it only says 0 or 1, toxic texts are graded 1 or 2
    by the score that a model of 0 and 1 fitted on the other fold gives them: 2 from the median on."""
    rows = training_rows(documents, labels, limit).mapInArrow(_row_features, "grade int, keys array<bigint>")
    rows = materialize(rows, "toxicity-sample")
    keys = choose_features(rows)
    if not len(keys):
        return Model()
    chosen = rows.sparkSession.createDataFrame([(keys.view(np.int64).tolist(),)], "chosen array<bigint>")
    # At most ``limit`` rows of at most FEATURES entries each.
    held = rows.crossJoin(F.broadcast(chosen)).select(
        "grade", F.pmod(F.xxhash64("keys"), F.lit(FOLDS)).alias("fold"), F.array_intersect("keys", "chosen").alias("keys")
    ).toPandas()
    grades = held["grade"].to_numpy(np.int64).clip(0)
    sizes = held["keys"].map(len).to_numpy()
    at = np.repeat(np.arange(len(held)), sizes)
    cols = np.concatenate([np.asarray(k, np.int64) for k in held["keys"]] or [np.zeros(0, np.int64)])
    cols = np.searchsorted(keys, cols.view(np.uint64))
    if grades.max(initial=0) == 1:
        grades = _graded(at, cols, grades, held["fold"].to_numpy(), len(keys))
    else:
        grades = np.unique(grades, return_inverse=True)[1]
    w, cuts = fit_cumulative(at, cols, grades, len(keys))
    return Model(keys, w, cuts)


def _graded(at: np.ndarray, cols: np.ndarray, toxic: np.ndarray, fold: np.ndarray, n_features: int) -> np.ndarray:
    """0 for clean rows, 1 or 2 for toxic ones by the other fold's model."""
    scores = np.zeros(len(toxic))
    for k in range(FOLDS):
        other = fold != k
        place = np.cumsum(other) - 1
        mine = other[at]
        w, cuts = fit_cumulative(place[at[mine]], cols[mine], toxic[other], n_features, rounds=500)
        if len(cuts):
            scores[~other] = (np.bincount(at, w[cols], len(toxic)) - cuts[0])[~other]
    grades = toxic + ((toxic == 1) & (scores >= np.median(scores[toxic == 1])))
    return grades if (grades == 1).any() else np.minimum(grades, 1)


def linear_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if not len(model.keys):
        return np.zeros(n)
    keys, of = row_features(data, offsets)
    at = np.searchsorted(model.keys, keys)
    at[at == len(model.keys)] = 0
    hit = model.keys[at] == keys
    pairs = np.unique(of[hit] * len(model.keys) + at[hit])
    return np.bincount(pairs // len(model.keys), model.weights[pairs % len(model.keys)], n)


def _scored(documents: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The columns as c0, c1, ..., so clashing names do no harm, severity and p_toxic."""
    picked = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("scored_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, risk = [], []
            for _, _, data, offsets in text_chunks(batch["scored_text"]):
                s, p = model.severity(linear_scores(model, data, offsets))
                severity.append(s)
                risk.append(p)
            if severity:
                arrays = [batch.column(i) for i in range(len(columns))]
                arrays += [pa.array(np.concatenate(severity)), pa.array(np.concatenate(risk))]
                names = [f"c{i}" for i in range(len(columns))] + ["severity", "p_toxic"]
                yield pa.record_batch(arrays, names)

    return picked.mapInArrow(run, f"{schema}, severity double, p_toxic double")


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, the expected ``severity`` and ``p_toxic``, P(grade > 0), of every document."""
    return _scored(documents, model, ["doc_id"]).select(F.col("c0").alias("doc_id"), "severity", "p_toxic")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity, p_toxic and ``toxic``, true from ``threshold`` on, for every document."""
    return score(documents, train(documents, labels)).withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose P(grade > 0) is under ``threshold``, all their columns."""
    kept = _scored(documents, train(documents, labels), documents.columns).where(F.col("p_toxic") < threshold)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)])
