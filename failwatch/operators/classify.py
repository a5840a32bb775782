"""Keyword, semantic and metric layers of the sample classifier."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from failwatch.functions import metrics, text
from failwatch.operators import history
from failwatch.settings import DEFAULTS, EXTRA_SENTENCES, FAILURE_SENTENCES, Settings
from failwatch.storage import materialize


def corpora(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(size, ref_id, text): the first ``size`` failure sentences, extra ones last."""
    sentences = FAILURE_SENTENCES + EXTRA_SENTENCES
    rows = [{"size": s, "ref_id": i, "text": sentences[i]} for s in sizes for i in range(s)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<size int, ref_id int, text string>>")
    return spark.range(0, 1, 1, 1).select(F.inline(table))


def keyword_layer(template: Column) -> tuple[Column, Column, Column]:
    """label, layer and failure type of the keyword layer, null where it is silent."""
    return layers_of(text.keyword_type(template))


def layers_of(kind: Column) -> tuple[Column, Column, Column]:
    """The same from a failure type that is already known."""
    hit = kind.isNotNull()
    return F.when(hit, "FAILURE"), F.when(hit, "keyword"), kind


def _term_counts(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, term, tf) of each document."""
    return (
        df.withColumn("_words", text.words(F.col(body)))
        .select(*keys, F.explode(text.with_bigrams(F.col("_words"))).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count("*").alias("tf"))
    )


def _term_marks(templates: DataFrame) -> DataFrame:
    """(term, total, df) to be added up: a row per occurrence and one per distinct template with the term.

    A template is one row, so nothing is grouped by it and its text stays where it is."""
    listed = templates.withColumn("_words", text.words(F.col("log_template"))).select(
        text.with_bigrams(F.col("_words")).alias("_terms")
    )
    counted = lambda total, df: lambda t: F.struct(
        t.alias("term"), F.lit(total).cast("bigint").alias("total"), F.lit(df).cast("bigint").alias("df")
    )
    told = F.concat(
        F.transform("_terms", counted(1, 0)), F.transform(F.array_distinct("_terms"), counted(0, 1))
    )
    return listed.select(F.inline(told))


def _added_up(marks: DataFrame) -> DataFrame:
    return marks.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


@dataclass(frozen=True)
class TermModel:
    """TF-IDF fitted on the distinct templates and the sentences of each corpus size.

    ``template_terms`` (log_template, term, tf), worked out by those who read it;
    ``vocabulary`` (size, term, idf, refs) with
    the weight of the term in every sentence. The vocabulary has at most
    ``vocabulary_size`` terms per corpus size, whatever the data, so it can be broadcast.
    """

    sizes: list[int]
    template_terms: DataFrame
    vocabulary: DataFrame


def fit_terms(
    templates: DataFrame, sizes: list[int] | None = None, settings: Settings = DEFAULTS
) -> TermModel:
    """Count the terms of the templates once; a size adds only its few sentences."""
    sizes = sizes or [len(FAILURE_SENTENCES)]
    spark = templates.sparkSession
    counted = _term_marks(templates)
    if len(sizes) > 1:
        counted = materialize(_added_up(counted), "term-totals")
    sentences = _sentence_terms(spark, sizes)
    n_templates = templates.count()
    vocabulary = reduce(
        DataFrame.unionByName,
        [
            _vocabulary(counted, sentences.where(F.col("size") == s), s, n_templates, max(sizes), settings)
            for s in sizes
        ],
    )
    template_terms = _term_counts(templates, ["log_template"], "log_template")
    return TermModel(sizes, template_terms, materialize(vocabulary, "vocabulary"))


def _sentence_terms(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(size, term, total, df, tfs): counts of each term over the sentences of a size, and
    per sentence. A fixed short list, so it is laid out without a shuffle."""
    split = corpora(spark, sizes).withColumn("_words", text.words(F.col("text"))).select(
        "size", "ref_id", text.with_bigrams(F.col("_words")).alias("terms")
    )
    found: dict[tuple, dict[int, int]] = {}
    for r in split.collect():
        for term in r["terms"]:
            tfs = found.setdefault((r["size"], term), {})
            tfs[r["ref_id"]] = tfs.get(r["ref_id"], 0) + 1
    rows = [
        {"size": s, "term": t, "total": sum(tfs.values()), "df": len(tfs),
         "tfs": [tfs.get(i, 0) for i in range(max(sizes))]}
        for (s, t), tfs in found.items()
    ]
    shape = "array<struct<size int, term string, total bigint, df bigint, tfs array<int>>>"
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), shape)))


def _vocabulary(
    counted: DataFrame, sentences: DataFrame, size: int, n_templates: int, width: int, settings: Settings
) -> DataFrame:
    """The most frequent terms of templates and sentences, ties by term.

    ``orderBy().limit()`` keeps the leaders of every partition before they are merged.
    """
    columns = ["term", "total", "df"]
    totals = _added_up(counted.unionByName(sentences.select(*columns)))
    leaders = totals.orderBy(F.desc("total"), "term").limit(settings.vocabulary_size)
    # A corpus of ``size`` sentences adds that many documents.
    idf = F.log((1 + n_templates + size) / (1 + F.col("df"))) + 1
    refs = F.transform(
        F.coalesce("tfs", F.array_repeat(F.lit(0), width)),
        lambda tf: F.when(tf > 0, (1 + F.log(F.greatest(tf, F.lit(1)))) * F.col("idf")).otherwise(0.0),
    )
    return (
        leaders.join(F.broadcast(sentences.select("term", "tfs")), "term", "left")
        .withColumn("idf", idf)
        .select(F.lit(size).alias("size"), "term", "idf", refs.alias("refs"))
    )


def _weighted(model: TermModel) -> DataFrame:
    known = model.template_terms.join(F.broadcast(model.vocabulary), "term")
    return known.withColumn("_raw", (1 + F.log("tf")) * F.col("idf"))


def term_weights(model: TermModel) -> DataFrame:
    """Unit-length weights of the templates: (size, log_template, term, weight)."""
    document = Window.partitionBy("size", "log_template")
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(document))
    return _weighted(model).select(
        "size", "log_template", "term", (F.col("_raw") / norm).alias("weight")
    )


def template_similarity(templates: DataFrame, model: TermModel) -> DataFrame:
    """(size, log_template, similarity): largest cosine to any sentence, 0 if none.

    Only terms of the vocabulary take part. Length and all dot products of a template
    come from one grouping, since the sentences are a fixed short list.
    """
    places = range(max(model.sizes))
    square = lambda c: F.sqrt(F.sum(c * c))
    # One row per corpus size.
    lengths = model.vocabulary.groupBy("size").agg(
        F.array(*[square(F.get("refs", F.lit(i))) for i in places]).alias("_lengths")
    )
    dots = _weighted(model).groupBy("size", "log_template").agg(
        square(F.col("_raw")).alias("_length"),
        F.array(*[F.sum(F.col("_raw") * F.get("refs", F.lit(i))) for i in places]).alias("_dots"),
    )
    cosines = F.zip_with(
        "_dots", "_lengths", lambda d, r: F.when(r > 0, d / (r * F.col("_length"))).otherwise(0.0)
    )
    best = dots.join(F.broadcast(lengths), "size").select(
        "size", "log_template", F.array_max(cosines).alias("similarity")
    )
    every_size = F.explode(F.array(*[F.lit(s) for s in model.sizes])).alias("size")
    return templates.select(every_size, "log_template").join(
        best, ["size", "log_template"], "left"
    ).select("size", "log_template", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def frozen_similarity(templates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(log_template, similarity) of new templates under a kept one-size vocabulary."""
    sizes = [len(FAILURE_SENTENCES)]
    terms = _term_counts(templates, ["log_template"], "log_template")
    return template_similarity(templates, TermModel(sizes, terms, vocabulary)).select(
        "log_template", "similarity"
    )


def distinct_templates(df: DataFrame) -> DataFrame:
    return df.select("log_template").where(F.col("log_template").isNotNull()).distinct()


def semantic_hit(similarity: Column, threshold: float) -> Column:
    return F.coalesce(similarity > threshold, F.lit(False))


def gc_jump(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``gc_jump``: counter now minus the oldest of the last ten rows."""
    back = settings.gc_history_rows - 1
    aged = history.row_lag(df, "gc_count", back, "_gc_oldest", settings.slice_us, clamp=True)
    return aged.withColumn("gc_jump", F.col("gc_count") - F.col("_gc_oldest")).drop("_gc_oldest")


def metric_score(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``metric_score`` (and the ``gc_jump`` it uses)."""
    return gc_jump(df, settings).withColumn(
        "metric_score", metrics.metric_points(F.col("gc_jump"))
    )


def fuse(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Combine the layers; needs log_template, similarity and metric_score."""
    # A column of its own: the phrases are searched once a row, not once for every use.
    df = df.withColumn("_kind", text.keyword_type(F.col("log_template")))
    label, layer, kind = layers_of(F.col("_kind"))
    semantic = semantic_hit(F.col("similarity"), settings.semantic_threshold)
    before_label = F.coalesce(label, F.when(semantic, "FAILURE").otherwise("NORMAL"))
    before_layer = F.coalesce(layer, F.when(semantic, "tfidf_semantic").otherwise("normal"))
    score = F.col("metric_score")
    raised = (before_label == "NORMAL") & (score >= settings.metric_score_threshold)
    confirmed = (before_label == "FAILURE") & (score >= settings.confirm_score)
    return df.withColumns(
        {
            "hybrid_label": F.when(raised, "FAILURE").otherwise(before_label),
            "detection_layer": F.when(raised, "metric_fusion")
            .when(confirmed, F.concat(before_layer, F.lit("_metric_confirmed")))
            .otherwise(before_layer),
            "failure_type": F.when(raised, "metric_only").otherwise(
                F.coalesce(kind, F.lit("none"))
            ),
        }
    ).drop("_kind")


def fit_similarity(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(log_template, similarity) fitted on the templates of ``df``.

    The model is a table of its own: templates, terms and vocabulary are written as they
    are made, since counting, weighting and comparing all read them.
    """
    found = materialize(distinct_templates(df), "distinct-templates")
    fitted = template_similarity(found, fit_terms(found, settings=settings))
    return materialize(fitted.select("log_template", "similarity"), "similarity")


def classify(
    df: DataFrame, settings: Settings = DEFAULTS, similarity: DataFrame | None = None
) -> DataFrame:
    """Label every sample.

    The semantic layer works on distinct templates and is joined back; neither side is
    broadcast by hint, since the number of templates grows with the data. Pass
    ``similarity`` (log_template, similarity) to use a frozen model.
    """
    if similarity is None:
        similarity = fit_similarity(df, settings)
    scored = metric_score(df, settings)
    joined = scored.join(similarity, "log_template", "left")
    return fuse(joined, settings).drop("similarity", "metric_score", "gc_jump")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share in percent."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("_total"))
    # One-row total.
    return counts.join(F.broadcast(total)).select(
        column, "rows", (F.col("rows") / F.col("_total") * 100.0).alias("percent")
    )
