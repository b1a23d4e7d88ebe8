"""Document vectors, reduction, centroids, two-dimensional maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.functions.text import ENGLISH_STOP_WORDS, words
from presswatch.operators.svd import principal_components

def embedding_pipeline(size: int = 512, stop_words: Sequence[str] | None = None) -> Pipeline:
    """Hashed TF-IDF vectors of unit length from a ``_words`` column."""
    stop = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    return Pipeline(stages=[
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=stop, locale="en_US"),
        HashingTF(inputCol="_kept", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ])


def with_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))


def fit_embedding(df: DataFrame, text: str, size: int = 512) -> PipelineModel:
    return embedding_pipeline(size).fit(with_words(df, text))


def with_embedding(df: DataFrame, model: PipelineModel, text: str, name: str = "embedding") -> DataFrame:
    out = model.transform(with_words(df, text)).withColumn(name, vector_to_array("_unit"))
    return out.drop("_words", "_kept", "_tf", "_tfidf", "_unit")


def with_encoder(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
                 text: str, name: str = "embedding") -> DataFrame:
    """Vectors from a user's encoder: made once per task, called once per Arrow batch."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            vectors = encoder(batch.fillna("").tolist())
            yield pd.Series([[float(x) for x in v] for v in vectors])

    return df.withColumn(name, encode(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def reduced(df: DataFrame, size: int = 5, vector: str = "embedding", name: str = "reduced") -> DataFrame:
    """Principal components of the unit vectors, of any width (``svd.principal_components``); rows are
    projected after unit scaling, without centring. A null vector gives a null projection; with fewer than
    two vectors, all projections are zero."""
    components = principal_components(df, vector, size)
    if components.size == 0:
        return df.withColumn(name, F.array_repeat(F.lit(0.0), F.lit(size)))
    v = F.col(vector)
    norm = F.sqrt(dot(v, v))
    parts = [F.when(norm > 0, dot(v, F.array(*[F.lit(float(x)) for x in row])) / norm).otherwise(F.lit(0.0))
             for row in components]
    return df.withColumn(name, F.when(v.isNotNull(), F.array(*parts)))


def projected(df: DataFrame, matrix: Sequence[Sequence[float]], vector: str = "embedding",
              name: str = "reduced") -> DataFrame:
    """Reduce by a given matrix, one row per output component."""
    parts = [dot(F.col(vector), F.array(*[F.lit(float(x)) for x in row])) for row in matrix]
    return df.withColumn(name, F.array(*parts))


def centroids(df: DataFrame, key: str = "topic", vector: str = "embedding") -> DataFrame:
    """Mean vector per key; partial means are merged, never the vectors of a key."""
    vec = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(key).agg(Summarizer.mean(vec).alias("_mean")).select(
        key, vector_to_array("_mean").alias("centroid"))


def topic_map(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Two coordinates and the document count per topic, outliers out."""
    docs = df.filter(F.col("topic") != -1)
    flat = reduced(centroids(docs, "topic", vector), 2, "centroid", "_xy")
    sizes = docs.groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    return flat.join(sizes, "topic").select("topic", *_xy(), "documents")


def document_map(df: DataFrame, title: str = "Title", keep: Sequence[str] = ("ingest_seq", "Title", "topic"),
                 size: int = 512) -> DataFrame:
    """Two coordinates per document, from its title."""
    model = fit_embedding(df, title, size)
    flat = reduced(with_embedding(df, model, title), 2, "embedding", "_xy")
    return flat.select(*keep, *_xy())


def _xy() -> list[Column]:
    return [F.coalesce(F.try_element_at("_xy", F.lit(i + 1)), F.lit(0.0)).alias(axis)
            for i, axis in enumerate("xy")]
