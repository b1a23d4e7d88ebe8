"""Topic job: fit topics over one text column and write the report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswatch.config import DEFAULTS, Settings, cluster_tier
from presswatch.functions.scalars import null_if_blank
from presswatch.operators import density, embedding, evolution, hierarchy, rollup, topic_terms
from presswatch.operators.dedup import drop_missing
from presswatch.operators.distance import topic_distance
from presswatch.operators.skew import number_rows
from presswatch.plans.topic_model import assign_topics, fit_topic_model, load_topic_model, model_exists
from presswatch.session import staged
from presswatch.sources.tables import write_report


@dataclass(frozen=True)
class TopicModel:
    """A fitted model: documents with their topic, vectors, and the word tables."""

    documents: DataFrame
    counts: DataFrame
    scores: DataFrame
    frequency: DataFrame


def fit_topics(df: DataFrame, text: str = "RelevantKeywords", key: str = "ingest_seq",
               vector: str | None = None, settings: Settings = DEFAULTS,
               widths: list[float] | None = None, model_path: str | None = None) -> TopicModel:
    """Embed, reduce, cluster, number by size, weigh words.

    ``vector`` names an existing vector column to use instead of the hashed TF-IDF embedding.
    Minimum cluster size and samples follow the document count. With ``model_path``, the fitted
    embedding, reduction, widths and cell topics are saved there for ``assigned_topic_model``.
    """
    docs = drop_missing(df.withColumn(text, null_if_blank(F.col(text))), text)
    # Rows are told apart by a number of their own, in key order: a key may repeat.
    docs, key = staged(number_rows(docs, [F.col(key).asc()], "_row"), "numbered"), "_row"
    if model_path is not None:
        topics, _ = fit_topic_model(docs, key, model_path, text=None if vector else text, vector=vector,
                                    widths=widths, settings=settings)
        return _labelled_model(docs.join(topics, key).drop(key), text)
    if vector is None:
        texts = staged(docs.select(key, text), "texts")
        vectors = embedding.with_embedding(
            texts, embedding.fit_embedding(texts, text, settings.embedding_size), text, "_embedding")
    else:
        vectors = docs.select(key, F.col(vector).alias("_embedding"))
    # Only the few reduced components are kept, not the wide vectors.
    points = staged(
        embedding.reduced(vectors, settings.reduced_size, "_embedding", "reduced").select(key, "reduced"), "reduced")
    tier = cluster_tier(points.count())
    sizes = widths or density.scott_widths(points, "reduced", settings.reduced_size)
    topics = density.density_topics(points, key, "reduced", sizes, tier, tier)
    return _labelled_model(docs.join(points.join(topics, key), key).drop(key), text)


def _labelled_model(labelled: DataFrame, text: str) -> TopicModel:
    labelled = staged(labelled, "labelled")
    counts = staged(topic_terms.bag_of_words(labelled, text), "counts")
    scores = staged(topic_terms.class_tf_idf(counts), "scores")
    return TopicModel(labelled, counts, scores, topic_terms.topic_frequency(labelled))


def assigned_topic_model(df: DataFrame, model_path: str, text: str = "RelevantKeywords") -> TopicModel:
    """Topics of ``df`` from the model saved under ``model_path``: nothing is fitted again."""
    docs = drop_missing(df.withColumn(text, null_if_blank(F.col(text))), text)
    saved = load_topic_model(df.sparkSession, model_path)
    return _labelled_model(assign_topics(saved, docs, reduced="reduced"), text)


def topic_reports(model: TopicModel, text: str = "RelevantKeywords", settings: Settings = DEFAULTS
                  ) -> dict[str, DataFrame]:
    """All report tables of a fitted model, by name."""
    docs, scores = model.documents, model.scores
    names = staged(topic_terms.topic_names(scores, settings.shown_words), "names")
    merges = hierarchy.linkage(names, topic_distance(scores))
    parents = staged(hierarchy.hierarchical_topics(model.counts, merges, scores, settings.shown_words), "parents")
    over_time = staged(evolution.topics_over_time(
        docs, text, bins=settings.time_bins, words=settings.shown_words), "over-time")
    return {
        "topic_terms": topic_terms.top_terms(scores, settings.stored_words),
        "topic_freq": model.frequency,
        "topic_bars": topic_terms.bar_report(scores, settings.bar_topics, settings.shown_words),
        "topic_map": embedding.topic_map(docs, "reduced"),
        "document_map": embedding.document_map(docs, size=settings.embedding_size),
        "topics_over_time": over_time,
        "topics_by_label": evolution.by_label(over_time),
        "topic_hierarchy": parents,
        "topic_annotations": hierarchy.node_annotations(merges, parents, names),
        "topic_tree": hierarchy.topic_tree(parents, names),
        "tree_map": rollup.tree_map(docs),
    }


def run_topics(df: DataFrame, out: str, text: str = "RelevantKeywords", vector: str | None = None,
               settings: Settings = DEFAULTS, model_path: str | None = None, refit: bool = True) -> dict[str, str]:
    """Fit (or, with ``refit`` off and a model saved under ``model_path``, assign), then write the labelled
    articles and one table per report under ``out``; returns the paths. A fit saves its model there."""
    if model_path is not None and not refit and model_exists(df.sparkSession, model_path):
        model = assigned_topic_model(df, model_path, text)
    else:
        model = fit_topics(df, text, vector=vector, settings=settings, model_path=model_path)
    tables = {
        "articles_with_topics": model.documents.drop("reduced"),
        "class_tf_idf": model.scores,
        **topic_reports(model, text, settings),
    }
    paths = {name: f"{out}/{name}" for name in tables}
    for name, table in tables.items():
        write_report(table, paths[name])
    return paths
