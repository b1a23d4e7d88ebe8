"""Vectors: embedding, reduction, centroids, density clusters, maps, the fitted model."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from presswatch.operators import density, embedding
from presswatch.operators.rules import keyword_table
from presswatch.plans.topic_model import assign_topics, fit_topic_model, load_topic_model
from presswatch.plans.topics import fit_topics
from presswatch.queries.registry import articles, out, query, table
from presswatch.queries.topics import PATTERN, STOP_SQL
from presswatch.session import staged, work_path

# A fixed reduction to five components, the first cosine basis vectors, so that SQL can follow it.
WIDTH, REDUCED = 64, 5
MATRIX = [[math.cos(math.pi * (i + 0.5) * k / WIDTH) * math.sqrt(2.0 / WIDTH) for i in range(WIDTH)]
          for k in range(1, REDUCED + 1)]
CELL, MIN_SIZE, MIN_SAMPLES = 0.08, 3, 5


def _parts_sql() -> str:
    rows = []
    for k, row in enumerate(MATRIX):
        numbers = ", ".join(f"{x:.17e}" for x in row)
        rows.append(f"list_dot_product(CAST(embedding AS DOUBLE[]), [{numbers}]) AS x{k}")
    return ", ".join(rows)


@query("projected_vectors", f"""
SELECT vec_id, {", ".join(f"round(x{k}, 6) AS x{k}" for k in range(REDUCED))}
FROM (SELECT vec_id, {_parts_sql()} FROM embeddings)
""", with_articles=False)
def projected_vectors(spark, sf_dir):
    rows = embedding.projected(table(spark, sf_dir, "embeddings"), MATRIX)
    return rows.select("vec_id", *[F.round(F.get("reduced", F.lit(k)), 6).alias(f"x{k}") for k in range(REDUCED)])


@query("centroids", """
SELECT label, dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean
FROM (SELECT label, unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS INT) AS dim FROM embeddings)
GROUP BY label, dim
""", with_articles=False)
def centroids(spark, sf_dir):
    means = embedding.centroids(table(spark, sf_dir, "embeddings"), "label")
    return means.select("label", F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


_CELLS = ", ".join(f"CAST(floor(x{k} / {CELL}e0) AS BIGINT) AS c{k}" for k in range(REDUCED))
_KEYS = ", ".join(f"c{k}" for k in range(REDUCED))
_FACES = " UNION ALL ".join(
    "SELECT a.id AS u, b.id AS v, a.n AS n_u, b.n AS n_v FROM cell a JOIN cell b ON "
    + " AND ".join(f"b.c{k} = a.c{k}" + (" + 1" if k == axis else "") for k in range(REDUCED))
    for axis in range(REDUCED))


@query("density_topics", f"""
WITH RECURSIVE p AS (SELECT vec_id, {_CELLS} FROM (SELECT vec_id, {_parts_sql()} FROM embeddings)),
cell AS (SELECT {_KEYS}, count(*) AS n, min(vec_id) AS id FROM p GROUP BY {_KEYS}),
ahead AS ({_FACES}),
face AS (SELECT u, v, n_v FROM ahead UNION ALL SELECT v, u, n_u FROM ahead),
core AS (SELECT c.id FROM cell c LEFT JOIN face f ON f.u = c.id GROUP BY c.id, c.n
  HAVING c.n + coalesce(sum(f.n_v), 0) >= {MIN_SAMPLES}),
reach AS (SELECT id, id AS label FROM core
  UNION SELECT f.v, r.label FROM reach r JOIN face f ON f.u = r.id WHERE f.v IN (SELECT id FROM core)),
inner_label AS (SELECT id, min(label) AS label FROM reach GROUP BY id),
border AS (SELECT f.u AS id, min(l.label) AS label FROM face f JOIN inner_label l ON f.v = l.id
  WHERE f.u NOT IN (SELECT id FROM core) GROUP BY f.u),
labelled AS (SELECT * FROM inner_label UNION ALL SELECT * FROM border),
size AS (SELECT label, sum(c.n) AS n_rows, min(c.id) AS first FROM labelled l JOIN cell c ON l.id = c.id GROUP BY label
  HAVING sum(c.n) >= {MIN_SIZE}),
numbered AS (SELECT label, CAST(row_number() OVER (ORDER BY n_rows DESC, first) - 1 AS INT) AS topic FROM size)
SELECT p.vec_id, coalesce(n.topic, -1) AS topic
FROM p JOIN cell c USING ({_KEYS}) LEFT JOIN labelled l ON l.id = c.id LEFT JOIN numbered n ON n.label = l.label
""", with_articles=False)
def density_topics(spark, sf_dir):
    rows = embedding.projected(table(spark, sf_dir, "embeddings"), MATRIX)
    return density.density_topics(rows, "vec_id", "reduced", [CELL] * REDUCED, MIN_SIZE, MIN_SAMPLES)


@query("reduced_vectors")
def reduced_vectors(spark, sf_dir):
    rows = embedding.reduced(table(spark, sf_dir, "embeddings"), REDUCED)
    return rows.select("vec_id", *[F.round(F.get("reduced", F.lit(k)), 6).alias(f"x{k}") for k in range(REDUCED)])


@query("document_vectors", f"""
SELECT doc_id, 256 AS width, CAST(CASE WHEN len(list_filter(regexp_extract_all(lower(text), '{PATTERN}'),
  lambda w: w NOT IN ({STOP_SQL}))) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length FROM documents
""", with_articles=False)
def document_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = embedding.with_embedding(docs, embedding.fit_embedding(docs, "text", 256), "text")
    v = F.col("embedding")
    return rows.select("doc_id", F.size(v).alias("width"), F.round(embedding.dot(v, v), 6).alias("length"))


class LetterEncoder:
    """Deterministic stand-in for a sentence encoder: letter counts of the whole text."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in "aeiou"] for t in texts]


@query("encoded_documents", "SELECT doc_id, " + ", ".join(
    f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS {c}" for c in "aeiou") + " FROM documents",
       with_articles=False)
def encoded_documents(spark, sf_dir):
    rows = embedding.with_encoder(table(spark, sf_dir, "documents"), LetterEncoder, "text")
    return rows.select("doc_id", *[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate("aeiou")])


def keyworded(spark, sf_dir):
    """Articles whose keywords are their highest TF-IDF words."""
    rows = articles(spark, sf_dir).drop("topic", "RelevantKeywords")
    words = keyword_table(rows)
    return rows.join(words, "ingest_seq").withColumn("RelevantKeywords", F.array_join("keywords", ", ")).drop("keywords")


@query("fitted_topics")
def fitted_topics(spark, sf_dir):
    return out(fit_topics(staged(keyworded(spark, sf_dir), "keyworded")).documents, "doc_id", "topic", "keywords")


@query("topic_map")
def topic_map(spark, sf_dir):
    """Vectors are made from the texts of all articles, so that ``documents`` is the size of the topic."""
    rows = staged(articles(spark, sf_dir).select("topic", "Description"), "descriptions")
    vectors = embedding.with_embedding(rows, embedding.fit_embedding(rows, "Description", 256), "Description")
    return embedding.topic_map(vectors).select(
        "topic", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "documents")


@query("document_map")
def document_map(spark, sf_dir):
    rows = staged(articles(spark, sf_dir).select("ingest_seq", "Title", "topic"), "titles")
    return out(embedding.document_map(rows, size=128), "doc_id", "title", "topic",
               F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_DENSITY_CTES = f"""
cell AS (SELECT {_KEYS}, count(*) AS n, min(vec_id) AS id FROM p GROUP BY {_KEYS}),
ahead AS ({_FACES}),
face AS (SELECT u, v, n_v FROM ahead UNION ALL SELECT v, u, n_u FROM ahead),
core AS (SELECT c.id FROM cell c LEFT JOIN face f ON f.u = c.id GROUP BY c.id, c.n
  HAVING c.n + coalesce(sum(f.n_v), 0) >= {MIN_SAMPLES}),
reach AS (SELECT id, id AS label FROM core
  UNION SELECT f.v, r.label FROM reach r JOIN face f ON f.u = r.id WHERE f.v IN (SELECT id FROM core)),
inner_label AS (SELECT id, min(label) AS label FROM reach GROUP BY id),
border AS (SELECT f.u AS id, min(l.label) AS label FROM face f JOIN inner_label l ON f.v = l.id
  WHERE f.u NOT IN (SELECT id FROM core) GROUP BY f.u),
labelled AS (SELECT * FROM inner_label UNION ALL SELECT * FROM border),
size AS (SELECT label, sum(c.n) AS n_rows, min(c.id) AS first FROM labelled l JOIN cell c ON l.id = c.id GROUP BY label
  HAVING sum(c.n) >= {MIN_SIZE}),
numbered AS (SELECT label, CAST(row_number() OVER (ORDER BY n_rows DESC, first) - 1 AS INT) AS topic FROM size)
"""
_OFFSETS = ", ".join(f"range(-1, 2) r{k}(o{k})" for k in range(REDUCED))
_SHIFTED = " AND ".join(f"f.c{k} = u.c{k} + o.o{k}" for k in range(REDUCED))


@query("assigned_topics", f"""
WITH RECURSIVE pa AS (SELECT vec_id, {_CELLS} FROM (SELECT vec_id, {_parts_sql()} FROM embeddings)),
p AS (SELECT * FROM pa WHERE vec_id % 2 = 0),
{_DENSITY_CTES.strip()},
fit AS (SELECT {", ".join(f"c.c{k}" for k in range(REDUCED))}, coalesce(n.topic, -1) AS topic
  FROM cell c LEFT JOIN labelled l ON l.id = c.id LEFT JOIN numbered n ON n.label = l.label),
unseen AS (SELECT DISTINCT {_KEYS} FROM pa EXCEPT SELECT {_KEYS} FROM fit),
off AS (SELECT * FROM {_OFFSETS} WHERE {" OR ".join(f"o{k} <> 0" for k in range(REDUCED))}),
near AS (SELECT {", ".join(f"u.c{k}" for k in range(REDUCED))}, f.topic,
  {" + ".join(f"o.o{k} * o.o{k}" for k in range(REDUCED))} AS d2
  FROM unseen u CROSS JOIN off o JOIN fit f ON {_SHIFTED} WHERE f.topic >= 0),
ring AS (SELECT {_KEYS}, topic FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY d2, topic) AS rn
  FROM near) WHERE rn = 1),
look AS (SELECT * FROM fit UNION ALL SELECT * FROM ring)
SELECT pa.vec_id, coalesce(l.topic, -1) AS topic FROM pa LEFT JOIN look l USING ({_KEYS})
""", with_articles=False)
def assigned_topics(spark, sf_dir):
    """Topics of all vectors from a model fitted and saved on the even half, then loaded: the odd half is new.

    Rows of the other half whose cell the fit never saw take the topic of the nearest cell in the ring around
    it. The split is the feature shown here (assignment without refitting); every row is assigned.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = work_path(spark, "topic-model")
    fit_topic_model(rows.filter(F.col("vec_id") % 2 == 0), "vec_id", path, vector="embedding", matrix=MATRIX,
                    widths=[CELL] * REDUCED, min_size=MIN_SIZE, min_samples=MIN_SAMPLES, rings=1)
    return assign_topics(load_topic_model(spark, path), rows).select("vec_id", "topic")
