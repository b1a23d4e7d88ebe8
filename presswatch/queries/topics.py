"""Topic analytics over whole article texts: words, distances, time, hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswatch.config import cluster_tier
from presswatch.functions.text import ENGLISH_STOP_WORDS, term_rows
from presswatch.operators import distance, evolution, filters, hierarchy, nearest, topic_terms
from presswatch.queries.registry import articles, out, query, table
from presswatch.session import staged

TOPICS = list(range(8))
STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
PATTERN = r"[\p{L}\p{N}_]{2,}"

TF_SQL = f"""
word AS (SELECT topic, ts, unnest(regexp_extract_all(lower(description), '{PATTERN}')) AS term
  FROM articles WHERE description IS NOT NULL AND topic <> -1),
tok AS (SELECT * FROM word WHERE term NOT IN ({STOP_SQL})),
tf AS (SELECT topic, term, count(*) AS n FROM tok GROUP BY topic, term),
cls AS (SELECT topic, sum(n) AS words FROM tf GROUP BY topic),
idf AS (SELECT term, ln(1 + (SELECT avg(words) FROM cls) / CAST(sum(n) AS DOUBLE)) AS idf FROM tf GROUP BY term),
terms AS (SELECT tf.topic, tf.term, tf.n, CAST(tf.n AS DOUBLE) / CAST(cls.words AS DOUBLE) * idf.idf AS score
  FROM tf JOIN cls ON tf.topic = cls.topic JOIN idf ON tf.term = idf.term),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, term) AS INT) AS rank
  FROM terms)
"""


def counts(spark, sf_dir):
    return topic_terms.bag_of_words(articles(spark, sf_dir))


def scores(spark, sf_dir):
    """Counts are read three times by the weighting, so the texts are tokenised once and the counts kept."""
    return topic_terms.class_tf_idf(staged(counts(spark, sf_dir), "counts"))


@query("document_tokens", f"""
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{PATTERN}')) AS term FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM w WHERE term NOT IN ({STOP_SQL})
GROUP BY term
""")
def document_tokens(spark, sf_dir):
    rows = term_rows(table(spark, sf_dir, "documents"), "text", keep=["doc_id"])
    per_doc = rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


@query("bag_of_words", TF_SQL + "SELECT topic, term, n FROM tf")
def bag_of_words(spark, sf_dir):
    return counts(spark, sf_dir)


@query("class_tf_idf", TF_SQL + "SELECT topic, term, n, round(score, 8) AS score FROM terms")
def class_tf_idf(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("score", F.round("score", 8))


@query("top_topic_terms", TF_SQL + "SELECT topic, rank, term, round(score, 8) AS score FROM ranked WHERE rank <= 10")
def top_topic_terms(spark, sf_dir):
    return topic_terms.top_terms(scores(spark, sf_dir), 10).select(
        "topic", "rank", "term", F.round("score", 8).alias("score"))


@query("topic_names", TF_SQL + """
SELECT topic, string_agg(term, '_' ORDER BY rank) AS name FROM ranked WHERE rank <= 5 GROUP BY topic
""")
def topic_names(spark, sf_dir):
    return topic_terms.topic_names(scores(spark, sf_dir))


@query("topic_bars", TF_SQL + """
SELECT topic, rank, term, round(score, 8) AS score FROM ranked WHERE rank <= 5 AND topic BETWEEN 0 AND 15
""")
def topic_bars(spark, sf_dir):
    return topic_terms.bar_report(scores(spark, sf_dir)).withColumn("score", F.round("score", 8))


@query("topic_frequency", "SELECT topic, count(*) AS documents FROM articles WHERE topic <> -1 GROUP BY topic")
def topic_frequency(spark, sf_dir):
    return topic_terms.topic_frequency(articles(spark, sf_dir))


@query("largest_topics", """
f AS (SELECT topic, count(*) AS documents FROM articles WHERE topic <> -1 GROUP BY topic)
SELECT topic, documents FROM f ORDER BY documents DESC, topic LIMIT 5
""")
def largest_topics(spark, sf_dir):
    return topic_terms.most_frequent(topic_terms.topic_frequency(articles(spark, sf_dir)), 5)


@query("largest_topic_vectors", TF_SQL + """,
f AS (SELECT topic FROM articles WHERE topic <> -1 GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 5)
SELECT topic, term, round(score, 8) AS score FROM terms WHERE topic IN (SELECT topic FROM f)
""")
def largest_topic_vectors(spark, sf_dir):
    chosen = topic_terms.most_frequent(topic_terms.topic_frequency(articles(spark, sf_dir)), 5)
    return topic_terms.selected_topics(scores(spark, sf_dir), chosen).select(
        "topic", "term", F.round("score", 8).alias("score"))


@query("cluster_tier", """
SELECT count(*) AS documents, CAST(CASE WHEN count(*) < 100 THEN 2 WHEN count(*) < 300 THEN 3 WHEN count(*) < 400 THEN 6
  ELSE 8 END AS INT) AS min_size FROM documents
""", with_articles=False)
def tier_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    return docs.agg(F.count(F.lit(1)).alias("documents")).withColumn("min_size", F.lit(cluster_tier(n)))


PAIRS_SQL = """,
nrm AS (SELECT topic, sum(score * score) AS sq FROM terms GROUP BY topic),
dot AS (SELECT a.topic AS ta, b.topic AS tb, sum(a.score * b.score) AS dot
  FROM terms a JOIN terms b ON a.term = b.term AND a.topic < b.topic GROUP BY a.topic, b.topic),
pair AS (SELECT x.topic AS ta, y.topic AS tb, coalesce(dot.dot, 0) AS dot, x.sq AS sa, y.sq AS sb
  FROM nrm x JOIN nrm y ON x.topic < y.topic LEFT JOIN dot ON dot.ta = x.topic AND dot.tb = y.topic)
"""


@query("topic_distance", TF_SQL + PAIRS_SQL + "SELECT ta, tb, round(1 - dot / sqrt(sa * sb), 6) AS dist FROM pair")
def topic_distance(spark, sf_dir):
    return distance.topic_distance(staged(scores(spark, sf_dir), "scores")).withColumn("dist", F.round("dist", 6))


@query("topic_distance_euclidean", TF_SQL + PAIRS_SQL + """
SELECT ta, tb, round(sqrt(greatest(0, sa + sb - 2 * dot)), 6) AS dist FROM pair
""")
def topic_distance_euclidean(spark, sf_dir):
    return distance.topic_distance(staged(scores(spark, sf_dir), "scores"), "euclidean").withColumn("dist", F.round("dist", 6))


@query("nearest_topics", TF_SQL + PAIRS_SQL + """,
ends AS (SELECT ta AS topic, tb AS other, greatest(1 - dot / sqrt(sa * sb), 0) AS d FROM pair
  UNION ALL SELECT tb, ta, greatest(1 - dot / sqrt(sa * sb), 0) FROM pair),
r AS (SELECT *, row_number() OVER (PARTITION BY topic
  ORDER BY round(d, 9), least(topic, other), greatest(topic, other)) AS rn FROM ends)
SELECT topic, other AS nearest, round(d, 6) AS dist FROM r WHERE rn = 1
""")
def nearest_topics(spark, sf_dir):
    """Each topic's nearest topic by cosine distance: K rows from a blocked product, no table of pairs kept."""
    return nearest.nearest_topics(staged(scores(spark, sf_dir), "scores")).withColumn("dist", F.round("dist", 6))


@query("distance_problems", """
SELECT CAST(0 AS BIGINT) AS missing_pairs, CAST(0 AS BIGINT) AS misordered, CAST(0 AS BIGINT) AS undefined,
  CAST(0 AS BIGINT) AS negative
""")
def distance_problems(spark, sf_dir):
    vectors = staged(scores(spark, sf_dir), "scores")
    return distance.distance_problems(distance.topic_distance(vectors), vectors)


TIME_SQL = TF_SQL + """,
span AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM articles WHERE topic <> -1),
doc AS (SELECT topic, CAST(greatest(1, least(20, ceil(CAST(epoch_us(ts) - low AS DOUBLE) * 20.0::DOUBLE
  / CAST(high - low AS DOUBLE)))) AS INT) AS bin FROM articles, span WHERE topic <> -1),
btok AS (SELECT topic, CAST(greatest(1, least(20, ceil(CAST(epoch_us(ts) - low AS DOUBLE) * 20.0::DOUBLE
  / CAST(high - low AS DOUBLE)))) AS INT) AS bin, term FROM tok, span),
held AS (SELECT bin, row_number() OVER (ORDER BY bin) AS step FROM (SELECT DISTINCT bin FROM doc)),
present AS (SELECT d.topic, d.bin, h.step FROM (SELECT DISTINCT topic, bin FROM doc) d JOIN held h ON d.bin = h.bin),
bw AS (SELECT b.topic, b.bin, b.term, count(*) * max(i.idf) AS w FROM btok b JOIN idf i ON b.term = i.term
  GROUP BY b.topic, b.bin, b.term),
braw AS (SELECT topic, bin, term, w / sum(w) OVER (PARTITION BY topic, bin) AS share FROM bw),
gw AS (SELECT tf.topic, tf.term, tf.n * i.idf AS w FROM tf JOIN idf i ON tf.term = i.term),
g AS (SELECT topic, term, w / sum(w) OVER (PARTITION BY topic) AS share FROM gw),
grid AS (SELECT p.topic, p.bin, p.step, g.term, g.share AS whole, coalesce(r.share, 0) AS raw
  FROM present p JOIN g ON p.topic = g.topic
  LEFT JOIN braw r ON r.topic = p.topic AND r.bin = p.bin AND r.term = g.term),
tuned AS (SELECT *, lag(raw) OVER (PARTITION BY topic, term ORDER BY step) AS before,
  lag(step) OVER (PARTITION BY topic, term ORDER BY step) AS before_step FROM grid),
weighed AS (SELECT topic, bin, term, (whole + CASE WHEN before_step = step - 1 THEN (raw + before) / 2 ELSE raw END) / 2
  AS score FROM tuned),
chosen AS (SELECT *, row_number() OVER (PARTITION BY topic, bin ORDER BY round(score, 12) DESC, term) AS rank
  FROM weighed),
text_of AS (SELECT topic, bin, string_agg(term, ', ' ORDER BY rank) AS words FROM chosen WHERE rank <= 5
  GROUP BY topic, bin),
freq AS (SELECT topic, bin, count(*) AS frequency FROM doc GROUP BY topic, bin),
ot AS (SELECT f.topic, f.bin, t.words, f.frequency,
  make_timestamp(CAST(low + floor((f.bin - 1) * ((high - low) / 20.0::DOUBLE)) AS BIGINT)) AS bin_start
  FROM freq f JOIN span ON TRUE LEFT JOIN text_of t ON t.topic = f.topic AND t.bin = f.bin)
"""


@query("topics_over_time", TIME_SQL + """
SELECT topic, bin, words, frequency, strftime(bin_start, '%Y-%m-%d %H:%M:%S') AS bin_start FROM ot
""")
def topics_over_time(spark, sf_dir):
    rows = evolution.topics_over_time(articles(spark, sf_dir))
    return out(rows.withColumnRenamed("Timestamp", "bin_start"), "topic", "bin", F.col("Words").alias("words"),
               F.col("Frequency").alias("frequency"), "bin_start")


LABEL_SQL = TIME_SQL + """,
lab AS (SELECT strftime(bin_start, '%d-%I%p') AS label, topic, CAST(sum(frequency) AS BIGINT) AS frequency,
  string_agg(replace(words, ',', ''), ' ' ORDER BY bin) AS words, min(bin_start) AS bin_start
  FROM ot GROUP BY strftime(bin_start, '%d-%I%p'), topic)
"""


def labelled(spark, sf_dir):
    return evolution.by_label(evolution.topics_over_time(articles(spark, sf_dir)))


@query("topics_by_label", LABEL_SQL + """
SELECT label, topic, frequency, words, strftime(bin_start, '%Y-%m-%d %H:%M:%S') AS bin_start FROM lab
""")
def topics_by_label(spark, sf_dir):
    return out(labelled(spark, sf_dir), "label", "topic", F.col("Frequency").alias("frequency"),
               F.col("Words").alias("words"), "bin_start")


def _matrix(expression: str) -> str:
    return ", ".join(f"{expression.format(t)} AS topic_{t}" for t in TOPICS)


@query("topic_time_frequencies", LABEL_SQL + "SELECT label, " + _matrix(
    "CAST(coalesce(sum(frequency) FILTER (topic = {0}), 0) AS BIGINT)") + " FROM lab GROUP BY label")
def topic_time_frequencies(spark, sf_dir):
    wide = evolution.frequency_matrix(labelled(spark, sf_dir), TOPICS)
    return wide.select("label", *[F.col(str(t)).alias(f"topic_{t}") for t in TOPICS])


@query("topic_time_words", LABEL_SQL + "SELECT label, " + _matrix(
    "max(words) FILTER (topic = {0})") + " FROM lab GROUP BY label")
def topic_time_words(spark, sf_dir):
    wide = evolution.words_matrix(labelled(spark, sf_dir), TOPICS)
    return wide.select("label", *[F.col(str(t)).alias(f"topic_{t}") for t in TOPICS])


# One closest pair at a time, as list operations on one state row per step. ``{merged}`` is the distance of
# cluster v to the merged pair, from dx, dy (distances to its parts), nx, ny, nv (sizes) and b.d (pair distance).
TREE_SQL = "RECURSIVE " + (TF_SQL.strip() + PAIRS_SQL).replace("{", "{{").replace("}", "}}") + """,
st AS (
  SELECT 0 AS step, (SELECT list({{'d': 1 - dot / sqrt(sa * sb), 'a': ta, 'b': tb}}) FROM pair) AS dist,
    (SELECT list({{'slot': topic, 'm': [topic]}} ORDER BY topic) FROM nrm) AS nodes,
    CAST(NULL AS DOUBLE) AS d, CAST(NULL AS INT[]) AS lm, CAST(NULL AS INT[]) AS rm
  UNION ALL
  SELECT step + 1,
    list_concat(list_filter(dist, lambda e: e.a NOT IN (b.a, b.b) AND e.b NOT IN (b.a, b.b)),
      list_transform(parts, lambda p: {{'d': {merged}, 'a': least(p.v, b.a), 'b': greatest(p.v, b.a)}})),
    list_concat(others, [{{'slot': b.a, 'm': list_sort(list_concat(l, r))}}]), b.d, l, r
  FROM (SELECT *, list_transform(others, lambda o: {{
      'v': o.slot, 'nv': CAST(len(o.m) AS DOUBLE), 'nx': CAST(len(l) AS DOUBLE), 'ny': CAST(len(r) AS DOUBLE),
      'dx': list_filter(dist, lambda e: e.a = least(o.slot, b.a) AND e.b = greatest(o.slot, b.a))[1].d,
      'dy': list_filter(dist, lambda e: e.a = least(o.slot, b.b) AND e.b = greatest(o.slot, b.b))[1].d}}) AS parts
    FROM (SELECT *, list_filter(nodes, lambda o: o.slot NOT IN (b.a, b.b)) AS others,
        list_filter(nodes, lambda o: o.slot = b.a)[1].m AS l, list_filter(nodes, lambda o: o.slot = b.b)[1].m AS r
      FROM (SELECT *, list_sort(dist)[1] AS b FROM st WHERE len(nodes) > 1)))),
par AS (SELECT CAST((SELECT max(topic) FROM nrm) + step AS INT) AS id, d, lm, rm, list_sort(list_concat(lm, rm)) AS m
  FROM st WHERE step > 0),
psum AS (SELECT p.id, tf.term, sum(tf.n) * max(i.idf) AS score
  FROM (SELECT id, unnest(m) AS topic FROM par) p JOIN tf ON tf.topic = p.topic JOIN idf i ON i.term = tf.term
  GROUP BY p.id, tf.term),
prank AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, term) AS rank FROM psum),
node AS (
  SELECT p.id, p.m, n.name FROM par p
  JOIN (SELECT id, string_agg(term, '_' ORDER BY rank) AS name FROM prank WHERE rank <= 5 GROUP BY id) n ON n.id = p.id
  UNION ALL
  SELECT topic, [topic], string_agg(term, '_' ORDER BY rank) FROM ranked WHERE rank <= 5 GROUP BY topic)
"""
WARD_SQL = TREE_SQL.format(merged="sqrt(((p.nv + p.nx) * p.dx * p.dx + (p.nv + p.ny) * p.dy * p.dy"
                                  " - p.nv * b.d * b.d) / (p.nv + p.nx + p.ny))")
AVERAGE_SQL = TREE_SQL.format(merged="(p.nx * p.dx + p.ny * p.dy) / (p.nx + p.ny)")
PARENTS_SQL = """
SELECT p.id AS parent_id, n.name AS parent_name, array_to_string(p.m, ',') AS topics, l.id AS left_id,
  l.name AS left_name, r.id AS right_id, r.name AS right_name, round(p.d, 6) AS distance
FROM par p JOIN node n ON n.id = p.id JOIN node l ON l.m = p.lm JOIN node r ON r.m = p.rm
"""
_TREES: dict[tuple[str, str, str], tuple] = {}


def _tree(spark, sf_dir, method="ward"):
    """Hierarchy, merges and topic names, worked out once per session and read from their tables after that."""
    key = (spark.sparkContext.applicationId, sf_dir, method)
    if key not in _TREES:
        base = staged(counts(spark, sf_dir), "counts")
        weighed = staged(topic_terms.class_tf_idf(base), "scores")
        if method == "average":  # from cluster sums, no table of pairs (Ward has no such form)
            merges = nearest.average_linkage(weighed)
        else:
            merges = hierarchy.linkage(weighed, distance.topic_distance(weighed), method)
        parents = staged(hierarchy.hierarchical_topics(base, merges, weighed), "parents")
        _TREES[key] = parents, merges, topic_terms.topic_names(weighed)
    return _TREES[key]


def _flat(rows):
    return rows.select(
        F.col("Parent_ID").alias("parent_id"), F.col("Parent_Name").alias("parent_name"),
        F.array_join(F.transform("Topics", lambda t: t.cast("string")), ",").alias("topics"),
        F.col("Child_Left_ID").alias("left_id"), F.col("Child_Left_Name").alias("left_name"),
        F.col("Child_Right_ID").alias("right_id"), F.col("Child_Right_Name").alias("right_name"),
        F.round("Distance", 6).alias("distance"))


@query("topic_hierarchy", WARD_SQL + PARENTS_SQL)
def topic_hierarchy(spark, sf_dir):
    return _flat(_tree(spark, sf_dir)[0])


@query("hierarchy_below_root", WARD_SQL + """
SELECT p.id AS parent_id, n.name AS parent_name FROM par p JOIN node n ON n.id = p.id WHERE n.name <> 'Top'
""")
def hierarchy_below_root(spark, sf_dir):
    return filters.below_root(_tree(spark, sf_dir)[0]).select(
        F.col("Parent_ID").alias("parent_id"), F.col("Parent_Name").alias("parent_name"))


@query("topic_hierarchy_average", AVERAGE_SQL + PARENTS_SQL)
def topic_hierarchy_average(spark, sf_dir):
    return _flat(_tree(spark, sf_dir, "average")[0])


@query("topic_annotations", WARD_SQL + """
SELECT array_to_string(p.m, ',') AS topics, l.name AS left_name, r.name AS right_name, round(p.d, 6) AS distance
FROM par p JOIN node l ON l.m = p.lm JOIN node r ON r.m = p.rm
""")
def topic_annotations(spark, sf_dir):
    parents, merges, names = _tree(spark, sf_dir)
    return hierarchy.node_annotations(merges, parents, names).select(
        F.array_join(F.transform("topics", lambda t: t.cast("string")), ",").alias("topics"),
        "left_name", "right_name", F.round("dist", 6).alias("distance"))


@query("topic_tree", WARD_SQL + """,
up AS (SELECT c.id, p.name, len(p.m) AS size FROM node c JOIN node p
  ON len(p.m) > len(c.m) AND list_contains(p.m, c.m[1])),
way AS (SELECT id, count(*) AS depth, string_agg(name, ' > ' ORDER BY size DESC) AS path FROM up GROUP BY id)
SELECT CAST(coalesce(w.depth, 0) AS INT) AS depth, concat_ws(' > ', w.path, n.name) AS path, n.name,
  CASE WHEN len(n.m) = 1 THEN n.id END AS topic
FROM node n LEFT JOIN way w ON w.id = n.id
""")
def topic_tree(spark, sf_dir):
    parents, _, names = _tree(spark, sf_dir)
    return hierarchy.topic_tree(parents, names)
