"""Words, distances, hierarchy, time, density clusters, against brute force on small tables."""

import math
import sys
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations, product

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from presswatch.operators import density, distance, embedding, evolution, hierarchy, topic_terms

cloudpickle.register_pickle_by_value(sys.modules[__name__])
rng = np.random.default_rng(5)


def brute_ctfidf(docs):
    counts = defaultdict(Counter)
    for topic, text in docs:
        counts[topic].update(w for w in text.split())
    sizes = {t: sum(c.values()) for t, c in counts.items()}
    mean = sum(sizes.values()) / len(sizes)
    f = Counter()
    for c in counts.values():
        f.update(c)
    return {(t, w): n / sizes[t] * math.log(1 + mean / f[w]) for t, c in counts.items() for w, n in c.items()}


DOCS = [(0, "alpha beta beta gamma"), (0, "alpha delta"), (1, "beta epsilon epsilon"), (2, "zeta eta alpha"),
        (-1, "alpha omega")]


def test_class_tf_idf(rows):
    counts = topic_terms.bag_of_words(rows(DOCS, "topic int, Description string"))
    got = {(r.topic, r.term): r.score for r in topic_terms.class_tf_idf(counts).collect()}
    want = brute_ctfidf([d for d in DOCS if d[0] != -1])
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) and got[k] > 0 for k in want)
    everything = topic_terms.bag_of_words(rows(DOCS, "topic int, Description string"), include_outliers=True)
    assert everything.filter("topic = -1").count() == 2


def test_tied_words_go_by_word(rows):
    df = rows([(0, w, 0.5) for w in ("d", "a", "c", "b")] + [(0, "z", 0.7)], "topic int, term string, score double")
    got = topic_terms.topic_names(df, 3).collect()
    assert [(r.topic, r.name) for r in got] == [(0, "z_a_b")]


def test_stop_words_and_scripts(rows):
    df = rows([(0, "The Été été a x1 foo_bar, don't")], "topic int, Description string")
    got = {r.term: r.n for r in topic_terms.bag_of_words(df).collect()}
    assert got == {"été": 2, "x1": 1, "foo_bar": 1}


def vectors(rows, matrix):
    return rows([(t, f"w{i}", float(x)) for t, v in enumerate(matrix) for i, x in enumerate(v) if x],
                "topic int, term string, score double")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [2, 128])
def test_distance_blocks(rows, monkeypatch, metric, block):
    monkeypatch.setattr(distance, "ROWS_PER_SHARD", 10)
    matrix = rng.random((9, 12)) * (rng.random((9, 12)) > 0.6)
    matrix[:, 0] += 0.01 * (np.arange(9) % 2 == 0)
    matrix[np.all(matrix == 0, axis=1), 1] = 1.0
    df = vectors(rows, matrix)
    got = {(r.ta, r.tb): r.dist for r in distance.topic_distance(df, metric, block).collect()}
    assert len(got) == 36
    for (a, b), d in got.items():
        x, y = matrix[a], matrix[b]
        want = 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y) if metric == "cosine" else np.linalg.norm(x - y)
        assert d == pytest.approx(want, abs=1e-9)
    distance.require_valid(distance.topic_distance(df, metric, block), df)


def test_invalid_distances_are_refused(rows):
    topics = rows([(0,), (1,), (2,)], "topic int")
    bad = rows([(0, 1, 0.5), (2, 1, -0.1)], "ta int, tb int, dist double")
    with pytest.raises(ValueError, match="missing_pairs"):
        distance.require_valid(bad, topics)


def greedy(d, n, method):
    """One closest pair at a time on a full matrix."""
    clusters = {i: (frozenset([i]),) for i in range(n)}
    sizes = {i: 1 for i in range(n)}
    dist = {frozenset(p): d[p] for p in combinations(range(n), 2)}
    merges, fresh = [], n
    while len(clusters) > 1:
        pair = min(dist, key=lambda p: (dist[p], sorted(min(clusters[c][0]) for c in p)))
        s, t = pair
        step = dist[pair]
        merges.append((tuple(sorted(clusters[s][0] | clusters[t][0])), step))
        for v in list(clusters):
            if v in pair:
                continue
            a, b = dist[frozenset((v, s))], dist[frozenset((v, t))]
            ns, nt, nv = sizes[s], sizes[t], sizes[v]
            if method == "ward":
                new = math.sqrt(((nv + ns) * a * a + (nv + nt) * b * b - nv * step * step) / (nv + ns + nt))
            elif method == "average":
                new = (ns * a + nt * b) / (ns + nt)
            else:
                new = max(a, b)
            dist[frozenset((v, fresh))] = new
        clusters[fresh] = (clusters[s][0] | clusters[t][0],)
        sizes[fresh] = sizes[s] + sizes[t]
        for c in (s, t):
            del clusters[c], sizes[c]
        dist = {p: x for p, x in dist.items() if not p & {s, t}}
        fresh += 1
    return {m: pytest.approx(x) for m, x in merges}


@pytest.mark.parametrize("method", ["ward", "average", "complete"])
def test_linkage_equals_one_by_one_merging(rows, method):
    n = 12
    points = rng.random((n, 3))
    d = {(i, j): float(np.linalg.norm(points[i] - points[j])) for i, j in combinations(range(n), 2)}
    table = rows([(i, j, x) for (i, j), x in d.items()], "ta int, tb int, dist double")
    topics = rows([(i,) for i in range(n)], "topic int")
    got = {tuple(sorted(r.left_topics + r.right_topics)): r.dist
           for r in hierarchy.linkage(topics, table, method).collect()}
    assert got == greedy(d, n, method)


def test_linkage_with_ties_and_single_topic(rows):
    table = rows([(i, j, 1.0) for i, j in combinations(range(5), 2)], "ta int, tb int, dist double")
    assert hierarchy.linkage(rows([(i,) for i in range(5)], "topic int"), table, "complete").count() == 4
    none = rows([], "ta int, tb int, dist double")
    assert hierarchy.linkage(rows([(0,)], "topic int"), none).count() == 0
    with pytest.raises(ValueError):
        hierarchy.linkage(rows([(0,)], "topic int"), none, "single")


def test_hierarchy_tables(rows):
    docs = rows([(0, "alpha beta"), (1, "alpha beta gamma"), (2, "omega psi"), (3, "omega psi chi phi")],
                "topic int, Description string")
    counts = topic_terms.bag_of_words(docs)
    scores = topic_terms.class_tf_idf(counts)
    merges = hierarchy.linkage(scores, distance.topic_distance(scores))
    parents = hierarchy.hierarchical_topics(counts, merges, scores)
    got = {r.Parent_ID: r for r in parents.collect()}
    assert sorted(got) == [4, 5, 6]
    assert got[6].Topics == [0, 1, 2, 3]
    assert {got[6].Child_Left_ID, got[6].Child_Right_ID} == {4, 5}
    assert {tuple(got[i].Topics) for i in (4, 5)} == {(0, 1), (2, 3)}
    assert all(got[i].Distance <= got[6].Distance for i in (4, 5))
    names = topic_terms.topic_names(scores)
    notes = {tuple(r.topics): (r.left_name, r.right_name)
             for r in hierarchy.node_annotations(merges, parents, names).collect()}
    by_set = {tuple(r.Topics): r.Parent_Name for r in got.values()}
    leaf = {r.topic: r.name for r in names.collect()}
    assert notes[(0, 1, 2, 3)] == (by_set[(0, 1)], by_set[(2, 3)])
    assert notes[(0, 1)] == (leaf[0], leaf[1])
    tree = {r.topic: r for r in hierarchy.topic_tree(parents, names).collect() if r.topic is not None}
    assert sorted(tree) == [0, 1, 2, 3] and {r.depth for r in tree.values()} == {2}
    assert tree[0].path.split(" > ") == [got[6].Parent_Name, by_set[(0, 1)], leaf[0]]


def brute_over_time(docs, bins, words):
    docs = [d for d in docs if d[0] != -1]
    us = [int((t - datetime(1970, 1, 1)).total_seconds() * 1e6) for _, _, t in docs]
    low, high = min(us), max(us)
    place = [min(bins, max(1, math.ceil((u - low) * bins / (high - low)))) for u in us]
    whole, local, freq = defaultdict(Counter), defaultdict(Counter), Counter()
    for (topic, text, _), b in zip(docs, place):
        whole[topic].update(text.split())
        local[topic, b].update(text.split())
        freq[topic, b] += 1
    sizes = {t: sum(c.values()) for t, c in whole.items()}
    f = Counter()
    for c in whole.values():
        f.update(c)
    idf = {w: math.log(1 + sum(sizes.values()) / len(sizes) / n) for w, n in f.items()}

    def share(c):
        total = sum(n * idf[w] for w, n in c.items())
        return {w: n * idf[w] / total for w, n in c.items()}

    held = sorted({b for _, b in freq})
    out = {}
    for topic, b in freq:
        raw, base = share(local[topic, b]), share(whole[topic])
        at = held.index(b)
        before = share(local[topic, held[at - 1]]) if at and (topic, held[at - 1]) in freq else None
        score = {}
        for w in base:
            now = raw.get(w, 0.0)
            if before is not None:
                now = (now + before.get(w, 0.0)) / 2
            score[w] = round((base[w] + now) / 2, 12)
        best = sorted(score, key=lambda w: (-score[w], w))[:words]
        out[topic, b] = (freq[topic, b], ", ".join(best))
    return out


def test_topics_over_time_by_brute_force(rows):
    vocabulary = [f"w{i}" for i in range(30)]
    start = datetime(2024, 1, 1)
    docs = [(int(rng.integers(-1, 3)), " ".join(rng.choice(vocabulary, size=8)),
             start + timedelta(minutes=int(m))) for m in rng.integers(0, 3000, size=60)]
    df = rows(docs, "topic int, Description string, Timestamp timestamp_ntz")
    got = {(r.topic, r.bin): (r.Frequency, r.Words)
           for r in evolution.topics_over_time(df, bins=7, words=4).collect()}
    assert got == brute_over_time(docs, 7, 4)


def test_equal_labels_are_summed(rows):
    df = rows([(0, 1, "a, b", 2, datetime(2024, 1, 5, 15)), (0, 2, "c", 3, datetime(2024, 1, 5, 15, 40)),
               (1, 2, None, 1, datetime(2024, 1, 5, 15, 40)), (0, 3, "d", 4, datetime(2024, 1, 5, 3))],
              "topic int, bin int, Words string, Frequency long, Timestamp timestamp")
    labelled = evolution.by_label(df)
    got = {(r.label, r.topic): (r.Frequency, r.Words) for r in labelled.collect()}
    assert got == {("05-03PM", 0): (5, "a b c"), ("05-03PM", 1): (1, ""), ("05-03AM", 0): (4, "d")}
    wide = {r.label: r for r in evolution.frequency_matrix(labelled, [0, 1]).collect()}
    assert (wide["05-03AM"]["1"], wide["05-03PM"]["0"]) == (0, 5)


def brute_density(points, width, min_size, min_samples):
    cells = defaultdict(list)
    for i, p in points.items():
        cells[tuple(math.floor(x / width) for x in p)].append(i)

    def faces(c):
        for axis, step in product(range(len(c)), (-1, 1)):
            n = c[:axis] + (c[axis] + step,) + c[axis + 1:]
            if n in cells:
                yield n

    core = {c for c in cells if len(cells[c]) + sum(len(cells[n]) for n in faces(c)) >= min_samples}
    label = {}
    for c in sorted(core, key=lambda c: min(cells[c])):
        if c in label:
            continue
        stack, name = [c], min(cells[c])
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = name
                stack += [n for n in faces(x) if n in core]
    border = {c: min(label[n] for n in faces(c) if n in core)
              for c in cells if c not in core and any(n in core for n in faces(c))}
    label.update(border)
    groups = defaultdict(list)
    for c, name in label.items():
        groups[name] += cells[c]
    order = sorted((g for g in groups.values() if len(g) >= min_size), key=lambda g: (-len(g), min(g)))
    topic = {i: t for t, g in enumerate(order) for i in g}
    return {i: topic.get(i, -1) for i in points}


def test_density_by_brute_force(rows):
    points = {i: tuple(map(float, p)) for i, p in enumerate(rng.normal(size=(300, 2)))}
    points.update({300 + i: (9.0, 9.0) for i in range(200)})  # one cell with a large share of the rows
    points[500] = (50.0, 50.0)
    df = rows([(i, list(p)) for i, p in points.items()], "id long, v array<double>")
    got = {r.id: r.topic for r in density.density_topics(df, "id", "v", [0.25, 0.25], 4, 5).collect()}
    assert got == brute_density(points, 0.25, 4, 5)
    assert got[500] == -1 and got[300] in (0, 1) and len(set(got.values())) > 2


def test_components_of_a_long_chain(spark):
    nodes = spark.range(400)
    step = spark.range(399).selectExpr("id AS u", "id + 1 AS v").filter("u != 199")
    edges = step.unionByName(step.selectExpr("v AS u", "u AS v"))
    got = {r.label: r["count"] for r in density.connected_components(nodes, edges).groupBy("label").count().collect()}
    assert got == {0: 200, 200: 200}


def test_repeated_keys_end_and_stay_single_rows(rows):
    df = rows([(i % 30, [float(i % 5), 0.0]) for i in range(40)], "id long, v array<double>")
    assert density.density_topics(df, "id", "v", [1.0, 1.0], 2, 2).count() == 40


def test_all_outliers(rows):
    df = rows([(i, [float(10 * i), 0.0]) for i in range(5)], "id long, v array<double>")
    assert {r.topic for r in density.density_topics(df, "id", "v", [1.0, 1.0], 2, 2).collect()} == {-1}


def test_vectors(rows):
    df = rows([(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [2.0, 2.0])], "id long, topic int, embedding array<double>")
    got = {r.topic: r.centroid for r in embedding.centroids(df).collect()}
    assert got == {1: [0.5, 0.5], 2: [2.0, 2.0]}
    cos = [r.c for r in df.select(embedding.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()]
    assert cos == pytest.approx([1.0, 0.0, math.sqrt(0.5)])
    reduced = embedding.reduced(df, 2).select("reduced").collect()
    assert all(len(r.reduced) == 2 for r in reduced)
    flat = embedding.topic_map(df)
    assert {(r.topic, r.documents) for r in flat.collect()} == {(1, 2), (2, 1)}


def test_topic_map_query_counts_every_article(spark):
    from presswatch.queries.registry import articles
    from presswatch.queries.vectors import topic_map

    sf_dir = "/root/testdata/sf0.01"
    sizes = articles(spark, sf_dir).filter("topic != -1").groupBy("topic").count().collect()
    assert {r.topic: r.documents for r in topic_map(spark, sf_dir).collect()} == {r.topic: r["count"] for r in sizes}


def test_saved_model_assigns_without_refitting(spark, tmp_path, monkeypatch):
    """A fit saves its model; assigning reads it back, and a row of the fit keeps its topic."""
    from presswatch.config import Settings
    from presswatch.plans import topic_model
    from presswatch.plans.topics import assigned_topic_model, fit_topics

    themes = ["nuclear reactor leak coastal plant", "shipping port shortage supply chain", "ransomware breach regulator"]
    rows = [(i, f"{themes[i % 3]} {'extra' if i % 4 else ''}", f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "ingest_seq long, RelevantKeywords string, Title string")
    path = str(tmp_path / "model")
    fitted = fit_topics(df, settings=Settings(embedding_size=64), model_path=path)
    before = {r.ingest_seq: r.topic for r in fitted.documents.collect()}
    assert set(before.values()) - {-1}

    def refuse(*args, **kwargs):
        raise AssertionError("fitted again")

    monkeypatch.setattr(topic_model.embedding, "fit_embedding", refuse)
    monkeypatch.setattr(topic_model, "fit_reducer", refuse)
    again = assigned_topic_model(df, path)
    after = {r.ingest_seq: r.topic for r in again.documents.collect()}
    assert after == before
    assert "reduced" in again.documents.columns
    # Unseen texts: a known theme finds its cell or a ring around it; nonsense stays an outlier or near.
    new = spark.createDataFrame([(100, themes[0], "n"), (101, None, "m")], df.schema)
    got = {r.ingest_seq: r.topic for r in assigned_topic_model(new, path).documents.collect()}
    assert got == {100: before[0]}


def test_ring_offsets():
    from presswatch.plans.topic_model import ring_offsets

    assert len(ring_offsets(5, 1)) == 3 ** 5 - 1
    assert len(ring_offsets(2, 2)) == 5 ** 2 - 1
    assert min(ring_offsets(3, 1))[:2] == (1, 1)


def test_ring_search_of_unseen_cells(spark, tmp_path):
    """Vectors by a fixed matrix: unseen cells next to a topic take it, by ring, offset, then topic; far: -1."""
    from presswatch.plans.topic_model import assign_topics, fit_topic_model

    identity = [[1.0, 0.0], [0.0, 1.0]]
    points = [(i, [0.05 + 0.01 * (i % 5), 0.05]) for i in range(10)] + [(20 + i, [3.05, 3.05]) for i in range(10)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    fitted, saved = fit_topic_model(df, "id", str(tmp_path / "m"), vector="v", matrix=identity, widths=[1.0, 1.0],
                                    min_size=3, min_samples=3, rings=2)
    topic = {r.id: r.topic for r in fitted.collect()}
    new = spark.createDataFrame([(1, [1.5, 0.5]), (2, [2.5, 2.5]), (3, [9.5, 9.5]), (4, [0.5, 0.5]), (5, None)],
                                df.schema)
    got = {r.id: r.topic for r in assign_topics(saved, new).collect()}
    assert got == {1: topic[0], 2: topic[20], 3: -1, 4: topic[0], 5: -1}


def test_linkage_from_sums_equals_pair_table(spark):
    """Average linkage from cluster sums gives the tree of the pair table; nearest topics equal numpy's."""
    from presswatch.operators import nearest

    draw = np.random.default_rng(4)
    rows = [(t, f"w{w}", float(draw.integers(1, 9))) for t in range(30) for w in draw.choice(40, 6, replace=False)]
    scores = spark.createDataFrame(rows, "topic int, term string, score double")
    by_pairs = hierarchy.linkage(scores, distance.topic_distance(scores), "average")
    by_sums = nearest.average_linkage(scores)

    def tree(df):
        return sorted((tuple(r.left_topics), tuple(r.right_topics), round(r.dist, 9)) for r in df.collect())

    assert tree(by_sums) == tree(by_pairs)
    dense = np.zeros((30, 40))
    for t, w, s in rows:
        dense[t, int(w[1:])] += s
    unit = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    got = {r.topic: (r.nearest, round(r.dist, 9)) for r in nearest.nearest_topics(scores).collect()}
    assert got == {t: (int(np.argmin(np.round(d[t], 9))), round(float(d[t].min()), 9)) for t in range(30)}


def test_tree_of_a_deep_chain(spark):
    """A caterpillar of 40 topics: depth and path of every node by pointer doubling equal a walk up the parents."""
    k = 40
    rows, left, left_name = [], 0, "t0"
    for i in range(1, k):
        parent = k - 1 + i
        rows.append((parent, f"p{parent}", list(range(i + 1)), left, left_name, i, f"t{i}", float(i)))
        left, left_name = parent, f"p{parent}"
    hier = spark.createDataFrame(rows, "Parent_ID int, Parent_Name string, Topics array<int>, Child_Left_ID int, "
                                       "Child_Left_Name string, Child_Right_ID int, Child_Right_Name string, "
                                       "Distance double")
    names = spark.createDataFrame([(t, f"t{t}") for t in range(k)], "topic int, name string")
    up = {c: p for p, _, _, a, _, b, _, _ in rows for c in (a, b)}
    label = {t: f"t{t}" for t in range(k)} | {p: n for p, n, *_ in rows}

    def walk(node):
        chain = []
        while node in up:
            node = up[node]
            chain.append(label[node])
        return len(chain), " > ".join(reversed(chain))

    got = {r.name: (r.depth, r.path) for r in hierarchy.topic_tree(hier, names).collect()}
    want = {}
    for node, name in label.items():
        depth, above = walk(node)
        want[name] = (depth, f"{above} > {name}" if above else name)
    assert got == want
    assert got["t0"][0] == k - 1


def test_components_of_any_width(spark):
    """Block power iteration equals numpy's eigenvectors of the covariance of the unit rows (up to the sign
    rule), for a width beyond the old limit of 2,000; null rows project to null."""
    from presswatch.operators.svd import principal_components

    draw = np.random.default_rng(9)
    basis = draw.standard_normal((3, 2100))
    x = draw.standard_normal((60, 3)) * [5.0, 3.0, 1.5] @ basis + 0.01 * draw.standard_normal((60, 2100))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, None)],
                               "id long, embedding array<double>")
    got = principal_components(df, "embedding", 2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    w, v = np.linalg.eigh(np.cov(unit.T))
    want = v[:, np.argsort(w)[::-1][:2]].T
    want *= np.sign(want[np.arange(2), np.argmax(np.abs(want), axis=1)])[:, None]
    assert np.abs(got - want).max() < 1e-8
    rows = {r.id: r.reduced for r in embedding.reduced(df, 2).collect()}
    assert rows[99] is None and np.allclose(rows[0], unit[0] @ want.T, atol=1e-8)
